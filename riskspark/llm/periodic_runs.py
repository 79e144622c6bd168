"""Runs of words that repeat with a period, found in a dictionary of basic factors.

Where a factor stands again at most its own length later, both places lie within twice that length, and
places side by side that step by the same distance belong to one arithmetic progression: the distance is
a period of all the words they cover. Each period is proposed by one length only, the least power of two
that is not smaller, and there the places of a run side by side are all that repeat a period later. The stretch
they cover cannot be extended, since the places before and after it do not repeat, and no run is proposed twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.common import WORD, extended, slices
from riskspark.llm.factors import Words, levels, split_words

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4

RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
FIELDS = (
    T.StructField("n_runs", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("period", T.LongType()), T.StructField("exponent_milli", T.LongType()),
    T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType()),
)


def find_runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start in the text, length and period of each run, in order of text, start and period."""
    found = [np.zeros((3, 0), np.int64)]
    for level in levels(words):
        near = (2 * level.steps > level.length) & (level.steps <= level.length)
        places, steps = level.places[near], level.steps[near]
        if not len(places):
            continue
        new = np.append(True, (np.diff(places) != 1) | (np.diff(steps) != 0))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(places)) - 1
        start, period = places[first], steps[first]
        length = places[last] + period + level.length - start
        long = length >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
        found.append(np.stack([start, length, period])[:, long])
    start, length, period = np.concatenate(found, axis=1)
    text = np.searchsorted(words.starts, start, side="right") - 1
    start = start - words.starts[text]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def _collapsed(words: Words, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> pa.Array:
    """Each text without what its runs repeat after their first period, words joined by one space."""
    edges = np.zeros(len(words.words) + 1, np.int64)
    np.add.at(edges, words.starts[text] + start + period, 1)
    np.add.at(edges, words.starts[text] + start + length, -1)
    kept = np.cumsum(edges[:-1]) == 0
    ends = np.append(0, np.cumsum(kept))[words.starts]
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words.words.filter(pa.array(kept)))
    return pc.binary_join(lists, " ")


def runs_of(texts: pa.Array) -> list[pa.Array]:
    """The columns of FIELDS for a batch of texts."""
    words = split_words(texts)
    text, start, length, period = find_runs(words)
    count = len(texts)
    # Extended precision tells any two quotients of numbers below 2^31 apart.
    power = length.astype(np.longdouble) / period
    order = np.lexsort((period, start, -power, text))
    best = order[np.append(True, text[order][1:] != text[order][:-1])] if len(order) else order
    columns = []
    for values in (start, length, period, 1000 * length // np.maximum(period, 1)):
        out, known = np.zeros(count, np.int64), np.zeros(count, bool)
        out[text[best]], known[text[best]] = values[best], True
        columns.append(pa.array(out, mask=~known))
    ends = pa.array(np.searchsorted(text, np.arange(count + 1)).astype(np.int32))
    runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], [f.name for f in RUN.fields])
    return [
        pa.array(np.bincount(text, minlength=count).astype(np.int64)), *columns, pa.ListArray.from_arrays(ends, runs),
        _collapsed(words, text, start, length, period),
    ]


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the runs of every whole text, the strongest one, and the text without repetitions.

    A run is a stretch of consecutive words with a smallest period q (words q apart are the same), at least
    LEAST_WORDS words and LEAST_TIMES * q long, that no neighbouring word extends. ``start`` (a word number from 0),
    ``length``, ``period`` and ``exponent_milli`` are those of the run with the greatest length per period, the
    first of equal ones, then that of the smallest period; null where there is no run. ``runs`` has them all,
    by start and period. ``collapsed`` leaves out words that any run contains after its first period.

    Null and empty texts have no runs and collapse to an empty text. Repeated rows stay; columns of these names
    are replaced. A text is worked on as a whole in one task, in memory proportional to it.
    """
    schema = extended(docs, *FIELDS)
    kept = [f.name for f in schema.fields[: -len(FIELDS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            columns = [*(batch.column(c) for c in kept), *runs_of(batch.column(text))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def looped(key: Column, text: Column) -> Column:
    """The text, made periodic from some word on where the key's checksum says so (one key in ten).

    Words are joined by one space there. Documents without a key or words stay as they are.
    """
    check = F.crc32(key.cast("string"))
    g = F.floor(check / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        first = (g % n).cast("int")
        period = F.lit(1) + F.floor((n - first) / (F.lit(3) + g % 8)).cast("int")
        at = F.sequence(F.lit(0), n - 1)
        return F.array_join(
            F.transform(at, lambda i: F.get(words, F.when(i < first, i).otherwise(first + (i - first) % period))), " ")

    # The list of words is bound once, as an element, so that it is not cut again for each word.
    words = F.filter(F.array(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), lambda w: F.size(w) > 0)
    return F.when(check % 10 == 0, F.coalesce(F.get(F.transform(words, repeat), F.lit(0)), text)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """SHA-256 of the listed runs and of the collapsed text, in lower-case hexadecimal digits."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("runs_sha256", F.sha2(F.array_join(lines, ""), 256)).withColumn(
        "collapsed_sha256", F.sha2("collapsed", 256))
