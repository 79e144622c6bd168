"""Removal of boilerplate lines by the number of distinct sites they spread over.

One HyperLogLog sketch of sites per line hash is merged by aggregation. Lines whose estimate lies near the
threshold get an exact distinct count. A line on ``min_sites`` sites or more is boilerplate; it stays where
it stands first and goes from everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.session import cut_lineage

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 4
#: A shorter line, in characters without outer white space, is never boilerplate.
MIN_CHARS = 10
#: Base-2 logarithm of the sketches' size, and how far from the threshold an estimate is trusted: four
#: standard errors of 1.04 / sqrt(2 ** LOG_SIZE).
LOG_SIZE, MARGIN = 10, 4 * 1.04 / 32


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def _hash(line: Column) -> list[Column]:
    """Two independent 64-bit hashes of a line: together they tell all lines apart."""
    return [F.xxhash64(F.lit(seed), _trimmed(line)) for seed in (1, 2)]


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """One row per line that may be boilerplate: ``doc``, ``whole``, ``place`` (from 0), ``h1``, ``h2``, ``site``.

    ``whole`` is a hash of the text, which tells rows of one key apart.
    """
    lines = docs.select(
        F.col(key).alias("doc"), F.xxhash64(text).alias("whole"), F.col(site).cast("string").alias("site"),
        F.posexplode(F.split(F.col(text), "\n")).alias("place", "line"),
    ).where(F.length(_trimmed(F.col("line"))) >= MIN_CHARS)
    first, second = _hash(F.col("line"))
    # The key's type decides nothing; a site that is null is a site of its own.
    site_name = F.coalesce(F.concat(F.lit("s"), "site"), F.lit("-"))
    return lines.select("doc", "whole", "place", first.alias("h1"), second.alias("h2"), site_name.alias("site"))


def spread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """Hashes of the lines on ``min_sites`` distinct sites or more, and ``first``: the least doc and place of each."""
    # Each task sketches the sites of its own lines; a line that stands everywhere is one sketch a task.
    first = F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "place"))).alias("first")
    if min_sites <= 1:
        return lines.groupBy("h1", "h2").agg(first)
    sketched = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_SIZE))).alias("about"), first)
    sketched = cut_lineage(sketched.where(F.col("about") >= min_sites * (1 - MARGIN)), "spread")
    sure = sketched.where(F.col("about") > min_sites * (1 + MARGIN)).drop("about")
    near = sketched.where(F.col("about") <= min_sites * (1 + MARGIN)).drop("about")
    exact = lines.join(near.select("h1", "h2"), ["h1", "h2"]).select("h1", "h2", "site").distinct()
    exact = exact.groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.unionByName(near.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi"))


def remove_boilerplate(
    docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES
) -> DataFrame:
    """Rewrite ``text`` without boilerplate lines; add ``n_lines`` and ``n_removed``.

    A line is what stands between line feeds, compared without outer blanks. A boilerplate line stays at
    its first place: in the document with the smallest key, there where it stands first. Null texts stay
    null (0 lines); an empty text has one empty line. Rows without a key are counted for the spread of
    their lines and left as they are. Rows that repeat a key lose the same lines at the same places. The work
    on a text grows with its lines, not with their square.
    """
    lines = cut_lineage(line_table(docs, key, text, site), "lines")
    spread = cut_lineage(spread_lines(lines, min_sites), "boilerplate")
    gone = lines.where("doc IS NOT NULL").join(spread, ["h1", "h2"]).where(F.struct("doc", "place") != F.col("first"))
    gone = gone.groupBy(F.col("doc").alias("__doc"), F.col("whole").alias("__whole")).agg(
        F.collect_set("place").alias("__gone"))

    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    same = (F.col(key) == F.col("__doc")) & (F.xxhash64(text) == F.col("__whole"))
    joined = docs.select(*kept).join(gone, same, "left")
    # Stored as a column of its own, so that a text is split once and not for each line that is looked up.
    split = joined.withColumn("__lines", F.split(F.col(text), "\n"))
    n_lines = F.coalesce(F.size("__lines"), F.lit(0))
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    left = F.transform(places, lambda place: F.get("__lines", place))
    out = split.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n")))
    counts = {
        "n_lines": F.when(F.col("__lines").isNull(), 0).otherwise(n_lines).cast("long"),
        "n_removed": F.coalesce(F.array_size("__gone"), F.lit(0)).cast("long"),
    }
    return out.withColumns(counts).select(*kept, *counts)
