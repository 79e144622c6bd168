"""A factorisation machine that scores the quality of texts.

Inputs are hashed words, structure statistics of the text and the recorded length. The machine adds a
weight per input and, for each pair of inputs, the inner product of their factors. The sum over pairs is
half the square of the summed factors less the summed squares: a text is scored in time linear in its
inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.common import extended, slices, uniform, words_of

#: Labelled rows learned from at most (the bound of the sample), buckets of words, factors per input.
SAMPLE_ROWS, WORD_BUCKETS, FACTORS = 8192, 1 << 14, 8
#: Passes over the sample, rows per step, step size and penalty of the training.
EPOCHS, BATCH, STEP, PENALTY = 8, 128, 0.1, 1e-4

#: Statistics of a text, each about 0 to 1. ``recorded`` is the length that the table states, the metadata.
STATISTICS = (
    "words", "word length", "distinct words", "most frequent word", "repeated neighbours", "upper case", "digits",
    "symbols", "beyond ASCII", "lines", "repeated lines", "lone symbols", "recorded", "recorded differs", "not recorded",
)
INPUTS = WORD_BUCKETS + len(STATISTICS)

_UPPER, _DIGIT, _SYMBOL, _OTHER, _BLANK = 1, 2, 3, 4, 5
_CLASSES = np.zeros(256, np.uint8)
for _byte in range(256):
    _char = chr(_byte)
    if _byte >= 128:
        _CLASSES[_byte] = _OTHER
    elif _char.isupper():
        _CLASSES[_byte] = _UPPER
    elif _char.isdigit():
        _CLASSES[_byte] = _DIGIT
    elif _byte == 32 or 9 <= _byte <= 13:
        _CLASSES[_byte] = _BLANK
    elif not _char.isalpha() and _char not in ".,'":
        _CLASSES[_byte] = _SYMBOL


@dataclass(frozen=True)
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def inputs_of(texts: pa.Array, recorded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, input and value of each input that is not 0, in order of rows."""
    count = len(texts)
    texts = pc.fill_null(texts.cast(pa.string()), "")
    hashes, rows = words_of(texts)
    n_words = np.bincount(rows, minlength=count)
    per_word = np.maximum(n_words, 1)
    joint = rows * WORD_BUCKETS + (hashes >> np.uint64(50)).astype(np.int64) % WORD_BUCKETS
    used, times = np.unique(joint, return_counts=True)
    word_rows, word_inputs = used // WORD_BUCKETS, used % WORD_BUCKETS
    # Logarithmic counts, as a vector of length 1: long and short texts weigh alike.
    values = np.log1p(times)
    values = values / np.sqrt(np.bincount(word_rows, values * values, minlength=count))[word_rows]

    stats = np.zeros((count, len(STATISTICS)))
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(t.encode() for t in texts.to_pylist()), np.uint8)
    classes = _CLASSES[raw]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    shares = {}
    for kind in (_UPPER, _DIGIT, _SYMBOL, _OTHER, _BLANK):
        sums = np.concatenate([[0], np.cumsum(classes == kind)])
        shares[kind] = (sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(sizes, 1)
    neighbours = np.bincount(rows[1:][(hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])], minlength=count)
    most = np.zeros(count)
    np.maximum.at(most, word_rows, times)
    lines = [t.split("\n") for t in texts.to_pylist()]
    alone = pc.count_substring_regex(texts, r"(^|\s)[^\pL\pN\s]+(\s|$)").to_numpy(zero_copy_only=False)
    stats[:, 0] = np.log1p(n_words) / 10
    stats[:, 1] = np.minimum(sizes * (1 - shares[_BLANK]) / per_word / 20, 2)
    stats[:, 2] = np.bincount(word_rows, minlength=count) / per_word
    stats[:, 3] = most / per_word
    stats[:, 4] = neighbours / per_word
    stats[:, 5:9] = np.stack([shares[_UPPER], shares[_DIGIT], shares[_SYMBOL] * 4, shares[_OTHER] * 4], axis=1)
    stats[:, 9] = np.log1p([len(x) for x in lines]) / 5
    stats[:, 10] = [1 - len(set(x)) / len(x) for x in lines]
    stats[:, 11] = alone / per_word
    known = ~np.isnan(recorded)
    length = np.array([len(t) for t in texts.to_pylist()])
    stats[known, 12] = np.log1p(np.maximum(recorded[known], 0)) / 12
    stats[known, 13] = np.minimum(np.abs(recorded[known] - length[known]) / np.maximum(length[known], 1), 1)
    stats[~known, 14] = 1
    stat_rows, stat_inputs = np.nonzero(stats)
    out_rows = np.concatenate([word_rows, stat_rows])
    order = np.argsort(out_rows, kind="stable")
    inputs = np.concatenate([word_inputs, stat_inputs + WORD_BUCKETS])[order]
    return out_rows[order], inputs, np.concatenate([values, stats[stat_rows, stat_inputs]])[order]


def margins(machine: Machine, rows: np.ndarray, inputs: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Bias, weights and pairwise terms, by the identity of sums and squares."""
    out = machine.bias + np.bincount(rows, machine.weights[inputs] * values, minlength=count)
    for factor in machine.factors.T:
        terms = factor[inputs] * values
        sums = np.bincount(rows, terms, minlength=count)
        out += 0.5 * (sums * sums - np.bincount(rows, terms * terms, minlength=count))
    return out


def train(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 2) -> Machine:
    """Fit by steps of adaptive size on the logistic loss; the same sample gives the same machine."""
    rng = np.random.default_rng(seed)
    weights, factors = np.zeros(INPUTS), rng.normal(0, 0.01, (INPUTS, FACTORS))
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(share / (1 - share)))
    seen_w, seen_f, seen_b = np.full(INPUTS, 1e-3), np.full((INPUTS, FACTORS), 1e-3), 1e-3
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // BATCH)):
            inputs = np.concatenate([samples[i][0] for i in part])
            values = np.concatenate([samples[i][1] for i in part])
            rows = np.repeat(np.arange(len(part)), [len(samples[i][0]) for i in part])
            own, place = np.unique(inputs, return_inverse=True)
            terms = factors[inputs] * values[:, None]
            sums = np.zeros((len(part), FACTORS))
            np.add.at(sums, rows, terms)
            squares = np.bincount(rows, (terms * terms).sum(axis=1), minlength=len(part))
            linear = np.bincount(rows, weights[inputs] * values, minlength=len(part))
            margin = bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]) / len(part)
            slope = error[rows] * values
            grad_w = np.bincount(place, slope, minlength=len(own)) + PENALTY * weights[own]
            push = slope[:, None] * (sums[rows] - terms)
            grad_f = np.stack([np.bincount(place, c, minlength=len(own)) for c in push.T], axis=1)
            grad_f += PENALTY * factors[own]
            seen_w[own] += grad_w**2
            seen_f[own] += grad_f**2
            seen_b += error.sum() ** 2
            weights[own] -= STEP * grad_w / np.sqrt(seen_w[own])
            factors[own] -= STEP * grad_f / np.sqrt(seen_f[own])
            bias -= STEP * error.sum() / np.sqrt(seen_b)
    return Machine(bias, weights, factors)


def _recorded(docs: DataFrame, length: str | None) -> Column:
    known = length is not None and length in docs.columns
    return (F.col(length) if known else F.lit(None)).cast("double").alias("recorded")


def _recorded_values(batch: pa.RecordBatch, column: str = "recorded") -> np.ndarray:
    return pc.fill_null(batch.column(column), float("nan")).to_numpy(zero_copy_only=False)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
    length: str | None = "n_chars",
) -> Machine:
    """Learn from documents drawn by a hash of ``key`` among the labelled ones, about SAMPLE_ROWS of them.

    Null labels and labels of unknown documents are left out; a key with several labels has their mean,
    rounded, and one with several documents is learned from the first of them by a hash of the text. The driver gets the inputs of the sample, never a text. Without labelled rows the machine
    scores 0.5; with one label only, it leans to that.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(
        F.round(F.avg(label)).cast("int").alias("label"))
    total = marked.count()
    drawn = marked.where(uniform(F.col("__key"), seed=2) < SAMPLE_ROWS / max(total, 1)).limit(2 * SAMPLE_ROWS)
    chosen = docs.select(F.col(key).alias("__key"), F.col(text).alias("text"), _recorded(docs, length))
    # At most 2 * SAMPLE_ROWS pairs of numbers, whatever the input.
    chosen = chosen.join(F.broadcast(drawn), "__key").select("__key", "label", "text", "recorded")
    # One document per key, chosen before the shuffle, so that rows of one key are one row per task.
    first = F.min(F.struct(F.xxhash64("text").alias("order"), "text", "recorded")).alias("first")
    chosen = chosen.groupBy("__key", "label").agg(first).select("__key", "label", "first.text", "first.recorded")
    schema = T.StructType([
        T.StructField("key", T.StringType()), T.StructField("label", T.IntegerType()),
        T.StructField("inputs", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.FloatType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, inputs, values = inputs_of(batch.column("text"), _recorded_values(batch))
            ends = pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("__key").cast(pa.string()), batch.column("label"),
                pa.ListArray.from_arrays(ends, pa.array(inputs.astype(np.int32))),
                pa.ListArray.from_arrays(ends, pa.array(values.astype(np.float32))),
            ], names=schema.names)

    sample = chosen.mapInArrow(run, schema).toPandas().sort_values("key", kind="stable")
    if not len(sample):
        return Machine(0.0, np.zeros(INPUTS), np.zeros((INPUTS, FACTORS)))
    pairs = [(np.asarray(i), np.asarray(v, float)) for i, v in zip(sample["inputs"], sample["values"])]
    return train(pairs, sample["label"].to_numpy(float))


def score(docs: DataFrame, machine: Machine, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """Add ``score`` (0 to 1, higher: better) and ``predicted`` (1 from a score of 0.5) per document.

    Whole texts of any length are scored; a null text as an empty one. Columns of these names are replaced.
    """
    schema = extended(docs, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()))
    kept = [f.name for f in schema.fields[:-2]]
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # INPUTS * (FACTORS + 1) numbers
    known = docs.select(*kept, _recorded(docs, length).alias("__recorded"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows, inputs, values = inputs_of(batch.column(text), _recorded_values(batch, "__recorded"))
            margin = margins(shared.value, rows, inputs, values, batch.num_rows)
            chance = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            columns = [*(batch.column(c) for c in kept), pa.array(chance), pa.array((chance >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "score", "predicted"])

    return known.mapInArrow(run, schema)


def training_rows(key: str = "doc_id", folds: int = 3, held_out: int = 1) -> Column:
    """Documents to learn labels of: those outside the fold that is held out, by crc32 of the key as text."""
    return F.crc32(F.col(key).cast("string")) % folds != held_out
