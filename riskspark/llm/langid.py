"""Language identification by cross-parsing entropy.

A suffix automaton over labelled text of a language accepts exactly the strings that occur in it. A text
is parsed greedily into longest matches, its phrases; the language whose automaton needs the fewest
phrases, each weighted by the bits that name a place in the learned text, wins.

The automata are laid out as one table of transitions: a step that leaves the automaton closes the
phrase and starts the next one. Blocks of many texts take their steps together, for all languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.common import extended, held, slices, uniform

#: Labelled documents looked at per language, and the bytes of them that are learned (bounds of the sample).
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_TOTAL = 400, 32_768, 1 << 20
#: A document of more characters would be most of a language's sample; it is learned from only if shorter ones do not
#: fill the bytes, and then a language's LONG_ROWS shortest such are looked at.
SAMPLE_CHARS, LONG_ROWS = 8_192, 4
#: Languages learned, the most frequent first.
LANGUAGES = 256
#: Bytes in a block; phrases end at its edges for every language alike.
BLOCK = 256
UNDETERMINED = "und"
#: Bits that a byte takes as it is. A text that needs as many in every language is in none of them.
PLAIN_BITS = 8

_OUTSIDE, _UNKNOWN, _SPACE = 0, 1, 2


@dataclass(frozen=True)
class LanguageModel:
    """Learned text per language, in order of the languages' names."""

    languages: tuple[str, ...]
    texts: tuple[bytes, ...]

    def tables(self) -> Tables:
        return held(self, lambda: _tables(self))


@dataclass
class Tables:
    symbols: np.ndarray
    steps: np.ndarray
    roots: np.ndarray
    bits: np.ndarray


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Learn from whole documents drawn by a hash of ``key``, SAMPLE_BYTES of them per language at most.

    Rows whose text or label is null are not learned from. The sample is bounded by SAMPLE_ROWS documents
    of SAMPLE_CHARS characters per language, whatever the size of the table. A language whose documents of
    that length do not fill its bytes also takes its shortest longer ones that fit; if it has only longer ones
    and none fits, it takes the start of the shortest.
    """
    rows = docs.select(F.col(label).alias("lang"), F.col(text).alias("text"), uniform(F.col(key), seed=10).alias("u"))
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text") >= 1))
    rows = rows.withColumn("short", F.length("text") <= SAMPLE_CHARS)
    size = F.octet_length("text").cast("long") + 1
    counts = rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if("short").alias("n_short"), F.sum(F.when(F.col("short"), size)).alias("bytes"),
        F.min(F.when(F.col("short"), F.col("u"))).alias("least"))
    counts = counts.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return LanguageModel((), ())
    share = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(SAMPLE_ROWS / max(r["n_short"], 1)))))
    # The least draw of a language is always in, so that one of few, often repeated keys is learned as well.
    least = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(1.0 if r["least"] is None else r["least"]))))
    inside = (F.col("u") < share[F.col("lang")]) | (F.col("u") <= least[F.col("lang")])
    drawn = rows.where(F.col("short") & inside).select("lang", "text", "u")
    # Rows of one key are drawn together: each language has its own bound, and the order decides which rows stay.
    order = Window.partitionBy("lang").orderBy("u", "text")
    drawn = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 2 * SAMPLE_ROWS)
    learned: dict[str, list[bytes]] = {r["lang"]: [] for r in counts}
    budget = min(SAMPLE_BYTES, SAMPLE_TOTAL // len(counts))
    room = dict.fromkeys(learned, budget)
    for row in sorted(drawn.collect(), key=lambda r: (r["u"], r["text"])):
        part = row["text"].lower().encode()
        if not learned[row["lang"]] or len(part) < room[row["lang"]]:
            learned[row["lang"]].append(part)
            room[row["lang"]] -= len(part) + 1
    lacking = [r["lang"] for r in counts if r["n_short"] < r["n"] and (r["bytes"] or 0) < budget]
    for row in _shortest_long(rows, lacking) if lacking else []:
        part = row["text"].lower().encode()
        if not learned[row["lang"]]:
            part = part[:budget].decode(errors="ignore").encode()
        elif row["size"] > budget or len(part) >= room[row["lang"]]:
            continue
        learned[row["lang"]].append(part)
        room[row["lang"]] -= len(part) + 1
    names = sorted(name for name, parts in learned.items() if parts)
    return LanguageModel(tuple(names), tuple(b"\n".join(learned[n]) for n in names))


def _shortest_long(rows: DataFrame, languages: list[str]) -> list:
    """The LONG_ROWS shortest long documents of each language, shortest first, up to SAMPLE_BYTES characters of each."""
    long = rows.where(~F.col("short") & F.col("lang").isin(languages)).select(
        "lang", "u", F.octet_length("text").alias("size"), F.substring("text", 1, SAMPLE_BYTES).alias("text"))
    order = Window.partitionBy("lang").orderBy("size", "u", "text")
    found = long.withColumn("place", F.row_number().over(order)).where(F.col("place") <= LONG_ROWS).collect()
    return sorted(found, key=lambda r: (r["lang"], r["place"]))


def _alphabet(texts: tuple[bytes, ...]) -> np.ndarray:
    """A symbol per byte: white space, digits and ASCII punctuation are one, bytes never learned another."""
    symbols = np.full(256, _UNKNOWN, np.uint8)
    plain = [b for b in range(128) if not chr(b).isalpha()]
    symbols[plain] = _SPACE
    seen = sorted(set(b"".join(texts)) - set(plain))
    for symbol, byte in enumerate(seen, _SPACE + 1):
        symbols[byte] = symbol
    return symbols


def _automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a string, state 0 being the root."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in symbols.tolist():
        state = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in following[at]:
            following[at][symbol] = state
            at = link[at]
        if at >= 0:
            target = following[at][symbol]
            if length[target] == length[at] + 1:
                link[state] = target
            else:
                copy = len(following)
                following.append(dict(following[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and following[at].get(symbol) == target:
                    following[at][symbol] = copy
                    at = link[at]
                link[target] = link[state] = copy
        last = state
    return following


def _tables(model: LanguageModel) -> Tables:
    """The automata of all languages as one table.

    An entry is twice the place of the next state's row, plus one if the step starts a new phrase.
    """
    symbols = _alphabet(model.texts)
    width = int(symbols.max()) + 1
    # A suffix automaton has at most twice as many states as its string has symbols.
    kind = np.int32 if 4 * width * sum(len(t) + 1 for t in model.texts) < 1 << 31 else np.int64
    parts, roots, first = [], [], 0
    for text in model.texts:
        following = _automaton(symbols[np.frombuffer(text, np.uint8)])
        root = first * width
        fresh = np.full(width, 2 * root + 1, kind)
        fresh[_OUTSIDE] = 2 * root
        for symbol, state in following[0].items():
            fresh[symbol] = 2 * (first + state) * width + 1
        steps = np.tile(fresh, (len(following), 1))
        for state, row in enumerate(following):
            if state and row:
                steps[state, list(row)] = [2 * (first + s) * width for s in row.values()]
        parts.append(steps.ravel())
        roots.append(root)
        first += len(following)
        del following, row
    steps = np.concatenate(parts)
    del parts
    sizes = np.array([len(t) for t in model.texts], float)
    return Tables(symbols, steps, np.array(roots, steps.dtype), np.log2(np.maximum(sizes, 2)))


def phrases(tables: Tables, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases per text and language, and bytes per text. Every block of every text is parsed."""
    raw = [t.lower().encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    starts = np.concatenate([[0], np.cumsum(blocks)])
    padded = np.zeros(int(starts[-1]) * BLOCK, np.uint8)
    for r, start in zip(raw, starts[:-1].tolist()):
        padded[start * BLOCK : start * BLOCK + len(r)] = np.frombuffer(r, np.uint8)
    symbols = tables.symbols[padded].reshape(-1, BLOCK)
    inside = np.arange(BLOCK)[None, :] < (np.repeat(sizes, blocks) - (np.arange(len(symbols)) - np.repeat(starts[:-1], blocks)) * BLOCK)[:, None]
    symbols = np.ascontiguousarray(np.where(inside, symbols, _OUTSIDE).T)
    counts = np.zeros((len(tables.roots), symbols.shape[1]), tables.steps.dtype)
    state = np.repeat(tables.roots[:, None], symbols.shape[1], axis=1)
    for column in symbols:
        step = tables.steps[state + column]
        counts += step & 1
        state = step >> 1
    return np.add.reduceat(counts, starts[:-1], axis=1).T.astype(float), sizes


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``explained`` per document; columns of these names are replaced.

    The prediction depends on the text alone. A text that is null or has no letter is ``und`` with score 0, as
    is every text if no language was learned. Languages that need equally many bits: the first by name wins.
    The score is the winner's share of 2^-bits, bits per byte being counted for 64 bytes at most.
    A text is not explained if it is ``und``, or if its phrases but the first one need PLAIN_BITS a byte or more
    even in the winner's language: that language's text then says nothing about it.
    """
    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("explained", T.BooleanType())]
    schema = extended(docs, *(T.StructField(name, kind) for name, kind in added))
    kept = [f.name for f in schema.fields[: -len(added)]]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SAMPLE_TOTAL bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        letter = regex.compile(r"\p{L}").search
        for batch in slices(batches, text):
            texts = batch.column(text).to_pylist()
            rows = [i for i, t in enumerate(texts) if t and letter(t)] if learned.languages else []
            lang = np.full(len(texts), UNDETERMINED, object)
            score, explained = np.zeros(len(texts)), np.zeros(len(texts), bool)
            if rows:
                tables = learned.tables()
                counts, sizes = phrases(tables, [texts[i] for i in rows])
                bits = counts * tables.bits / sizes[:, None]
                best = bits.argmin(axis=1)
                lang[rows] = np.array(learned.languages, object)[best]
                own = np.arange(len(rows)), best
                explained[rows] = (counts[own] - 1) * tables.bits[best] < PLAIN_BITS * sizes
                over = (bits - bits.min(axis=1)[:, None]) * np.minimum(sizes, 64)[:, None]
                score[rows] = 1 / np.exp2(-np.minimum(over, 1000)).sum(axis=1)
            columns = [*(batch.column(c) for c in kept), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(explained)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def training_rows(key: str = "doc_id", folds: int = 5, held_out: int = 0) -> Column:
    """Documents to learn from: those outside the fold that is held out, by crc32 of the key as text."""
    return F.crc32(F.col(key).cast("string")) % folds != held_out
