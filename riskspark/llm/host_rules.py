"""Quality rules of documents and of the hosts that they come from.

Rules judge each text by its own measures. Failures are then added up by host, and a host's rate of
failure is shrunk towards that of all hosts: a beta prior is fitted to the rates of the hosts themselves,
so that a host of few documents says little and one of many speaks for itself. A host most of whose documents
fail takes its other documents with it.
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

from riskspark.llm.common import extended, slices
from riskspark.llm.factors import Words, levels, numbers, split_words

#: Words of the window whose repetition counts; a power of two.
WINDOW = 8
#: Limits of the rules: words, and shares in percent of repeated words, symbols per word and repeated lines per word.
LEAST_WORDS, MOST_REPEATED, MOST_SYMBOLS, MOST_LINES = 20, 30, 10, 10
#: Mean code points of a word.
WORD_LENGTHS = (2, 20)
#: A host is refused from this shrunk rate of failing documents on.
REFUSED_RATE = 0.5
#: Documents that the prior weighs at least and at most.
PRIOR_WEIGHTS = (2.0, 1000.0)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("short", "repeats", "symbols", "lines", "word_length")


def _repeated_words(words: Words, window: int) -> np.ndarray:
    """Words per text that a window of this many words covers that stands in the text more than once."""
    edges = np.zeros(len(words.words) + 1, np.int64)
    for level in levels(words):
        if level.length == window:
            np.add.at(edges, level.places, 1)
            np.add.at(edges, level.places + window, -1)
            break
    return np.diff(np.append(0, np.cumsum(np.cumsum(edges[:-1]) > 0))[words.starts])


def _repeated_lines(texts: pa.Array) -> np.ndarray:
    """Lines per text that hold a word and are equal to an earlier line."""
    split = pc.split_pattern(texts, "\n")
    rows, lines = pc.list_parent_indices(split), pc.list_flatten(split)
    filled = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]")
    rows, lines = pc.filter(rows, filled).to_numpy(zero_copy_only=False).astype(np.int64), pc.filter(lines, filled)
    total = np.bincount(rows, minlength=len(texts))
    if not len(lines):
        return total
    codes = numbers(lines)
    distinct = np.unique(rows * (codes.max() + 1) + codes) // (codes.max() + 1)
    return total - np.bincount(distinct, minlength=len(texts))


def measures_of(texts: pa.Array, window: int = WINDOW) -> list[np.ndarray]:
    """The MEASURES of a batch of texts; null texts count as empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    words = split_words(texts)
    chars = np.append(0, np.cumsum(pc.utf8_length(words.words).to_numpy(zero_copy_only=False).astype(np.int64)))
    symbols = pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy(zero_copy_only=False)
    return [
        np.diff(words.starts), np.diff(chars[words.starts]), symbols, _repeated_lines(texts), _repeated_words(words, window),
    ]


def measure(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add the measures of every whole text.

    ``n_words`` (what stands between ASCII white space), ``word_chars`` (their code points), ``n_symbols`` (characters
    of ``#*$%&|<>``), ``n_dup_lines`` (lines with a word that equal an earlier line) and ``n_repeat_words``
    (words in windows of ``window`` words that stand in the text more than once, the first time included). Null and
    empty texts have 0 of all. Repeated rows stay; columns of these names are replaced. A text is worked on
    as a whole in one task, in memory proportional to it.
    """
    if window < 1 or window & (window - 1):
        raise ValueError(f"The window must be a power of two, not {window}.")
    schema = extended(docs, *(T.StructField(name, T.LongType()) for name in MEASURES))
    kept = [f.name for f in schema.fields[: -len(MEASURES)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [pa.array(x.astype(np.int64)) for x in measures_of(batch.column(text), window)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], names=schema.names)

    return docs.mapInArrow(run, schema)


def failures() -> dict[str, Column]:
    """Whether a measured document fails each of the RULES, in whole numbers."""
    n, c = F.col("n_words"), F.col("word_chars")
    return {
        "short": n < LEAST_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MOST_REPEATED * n,
        "symbols": 100 * F.col("n_symbols") > MOST_SYMBOLS * n,
        "lines": 100 * F.col("n_dup_lines") > MOST_LINES * n,
        "word_length": (n > 0) & ((c < WORD_LENGTHS[0] * n) | (c > WORD_LENGTHS[1] * n)),
    }


def base_failed() -> Column:
    """The two rules that refuse a document whatever its host."""
    rules = failures()
    return rules["short"] | rules["repeats"]


@dataclass(frozen=True)
class Prior:
    """A beta distribution of hosts' rates: its mean, and the documents that it weighs."""

    mean: float
    weight: float


def fit_prior(hosts: DataFrame) -> Prior:
    """The beta prior of the rates ``failed / documents`` of a table of hosts, by its moments.

    Each host counts by its documents. What the rates spread beyond what chance gives hosts of their
    sizes is the spread of the prior; without any, the prior has its greatest weight. Seven sums go to the driver.
    """
    n, f = F.col("documents").cast("double"), F.col("failed").cast("double")
    sums = hosts.agg(
        F.count("*").alias("hosts"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(n * n).alias("nn"),
        F.sum(f * f / n).alias("ff"),
    ).first()
    if not sums["hosts"]:
        return Prior(0.0, PRIOR_WEIGHTS[1])
    mean = sums["f"] / sums["n"]
    between, within = sums["ff"] - sums["n"] * mean**2, mean * (1 - mean)
    # E[between] = within * (hosts - 1) if all hosts have one rate; else more by spread * (n - nn / n).
    room = sums["n"] - sums["nn"] / sums["n"]
    # For one host, or if all or none fail, nothing is known of the spread.
    spread = (between - within * (sums["hosts"] - 1)) / (room - (sums["hosts"] - 1)) if room > sums["hosts"] - 1 else 0.0
    weight = within / spread - 1 if spread > 0 else PRIOR_WEIGHTS[1]
    return Prior(mean, min(max(weight, PRIOR_WEIGHTS[0]), PRIOR_WEIGHTS[1]))


def host_verdicts(measured: DataFrame, host: str = "source", limit: float = REFUSED_RATE) -> DataFrame:
    """A row per host: documents, failures of each rule, documents that fail any, shrunk rate, verdict.

    A host is refused if its shrunk rate is ``limit`` or more. Documents without a host (null) have no row. The
    counts are combined before the shuffle, so that a host of a third of all documents is one row per task.
    """
    rules = failures()
    any_rule = F.greatest(*(r.cast("int") for r in rules.values()))
    hosts = measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("documents"), F.sum(any_rule).alias("failed"),
        *(F.count_if(r).alias(f"failed_{name}") for name, r in rules.items()))
    prior = fit_prior(hosts)
    rate = (F.col("failed") + prior.mean * prior.weight) / (F.col("documents") + prior.weight)
    return hosts.withColumn("shrunk_rate", rate).withColumn("refused", F.col("shrunk_rate") >= limit)


def judge(measured: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """Add ``base_failed``, ``host_refused`` and ``kept`` (neither) to measured documents.

    A document without a host is judged by its own rules alone. Columns of these names are replaced.
    """
    known = verdicts.select(F.col("host").alias("__host"), F.col("refused").alias("__refused"))
    marked = measured.drop("base_failed", "host_refused", "kept").join(known, F.col(host) == F.col("__host"), "left")
    refused = F.coalesce("__refused", F.lit(False))
    return marked.withColumns(
        {"base_failed": base_failed(), "host_refused": refused, "kept": ~base_failed() & ~refused}
    ).drop("__host", "__refused")
