"""Exact quantiles at any size.

The built-in ``median`` keeps every distinct value of a column in one task. It is used for
tables of checked size; beyond that the quantile is bracketed by approximate quantiles, the
bracket is checked by counting, and only the distinct values inside it are ranked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskspark.functions.columns import finite
from riskspark.operators.marks import RANK_ERROR, quantile_marks

DIRECT_ROWS = 200_000
KEEP_INSIDE = 100_000
MARKS = 1000
#: Stands for the rows below a bracket whose ends are the two middle values.
NEIGHBOURS = -1
SHARES = [(i + 0.5) / MARKS for i in range(MARKS)]


def exact_medians(
    df: DataFrame,
    columns: Sequence[str],
    sizes: Mapping[str, int] | None = None,
    direct_rows: int = DIRECT_ROWS,
    keep_inside: int = KEEP_INSIDE,
) -> dict[str, float | None]:
    """The median of each column, between the two middle values if their number is even.

    Missing and infinite values are left out. ``sizes`` are the non-missing rows per column;
    they are counted if not given.
    """
    columns = list(columns)
    if not columns:
        return {}
    values = {c: finite(df, c) for c in columns}
    if sizes is None:
        sizes = df.agg(*[F.count(values[c]).alias(c) for c in columns]).first().asDict()
    if max(sizes.values()) <= direct_rows:
        small = df.agg(*[F.median(values[c]).alias(c) for c in columns]).first()
        return {c: small[c] for c in columns}

    # 0-based positions of the two middle values in sorted order.
    middle = {c: ((sizes[c] - 1) // 2, sizes[c] // 2) for c in columns if sizes[c]}
    brackets = _brackets(df, middle, {c: sizes[c] for c in middle}, keep_inside)
    medians: dict[str, float | None] = dict.fromkeys(columns)
    medians.update(_ranked(df, middle, brackets))
    return medians


def _brackets(
    df: DataFrame, middle: dict[str, tuple[int, int]], sizes: dict[str, int], keep_inside: int
) -> dict[str, tuple[float, float, int]]:
    """Per column (low, high, rows below low), proven by counting to hold both middle values.

    Every pass over the table counts the proposed brackets and takes quantiles inside them. A
    column is done when few rows are left inside. When a closer bracket has as many rows, the edge
    values themselves hold them; these are counted apart, and the search goes on between them.
    """
    everything = (float("-inf"), float("inf"))
    proven = {c: (*everything, 0) for c in middle}
    held = dict(sizes)
    margin = dict.fromkeys(middle, RANK_ERROR)
    proposal = dict.fromkeys(middle, everything)
    repeated = set(middle)
    active = sorted(middle)
    while active:
        values = {c: finite(df, c) for c in active}
        inside = {
            c: F.when(values[c].between(F.lit(proposal[c][0]), F.lit(proposal[c][1])), values[c])
            for c in active
        }
        lower = {c: values[c] < F.lit(proposal[c][0]) for c in active if proposal[c] != everything}
        marks, counted, smaller = quantile_marks(df, inside, SHARES, lower)
        going_on, crowded = [], []
        for c in active:
            under, within = smaller.get(c, 0), counted[c]
            if not (under <= middle[c][0] and under + within > middle[c][1]):
                # The quantiles were off by more than the margin: propose again, wider.
                if proposal[c] == everything:
                    raise ValueError(f"{c} has fewer values than its size says.")
                margin[c] *= 8
                proposal[c] = proven[c][:2]
                repeated.add(c)
                going_on.append(c)
                continue
            no_progress = within == held[c] and c not in repeated
            repeated.discard(c)
            proven[c], held[c] = (*proposal[c], under), within
            if within <= keep_inside or proposal[c][0] == proposal[c][1]:
                continue
            if no_progress:
                crowded.append(c)
                continue
            first = (middle[c][0] - under) / within - margin[c]
            last = (middle[c][1] - under + 1) / within + margin[c]
            proposal[c] = (
                marks[c][int(first * MARKS)] if first > 0 else proposal[c][0],
                marks[c][int(last * MARKS)] if last < 1 else proposal[c][1],
            )
            going_on.append(c)
        # The edge values hold nearly all rows of these: take them out, of all in one pass, and go on between them.
        for c, (bracket, rows, done) in _without_edges(df, {c: proven[c] for c in crowded}, middle).items():
            proven[c], held[c] = bracket, rows
            if not done:
                proposal[c] = bracket[:2]
                repeated.add(c)
                going_on.append(c)
        active = going_on
    return proven


def _without_edges(
    df: DataFrame, brackets: Mapping[str, tuple[float, float, int]], middle: Mapping[str, tuple[int, int]]
) -> dict[str, tuple[tuple[float, float, int], int, bool]]:
    """Per column the bracket strictly between the edge values of its bracket, the rows in it, and whether it is final.

    If a middle value is an edge value, or next to one, the bracket ends at the middle values themselves. One pass
    over the table, whatever the number of columns.
    """
    if not brackets:
        return {}
    exprs = []
    for i, (c, (low, high, _)) in enumerate(brackets.items()):
        value = finite(df, c)
        inner = F.when((value > F.lit(low)) & (value < F.lit(high)), value)
        exprs += [
            F.count_if(value == F.lit(low)).alias(f"low{i}"), F.count(inner).alias(f"inner{i}"),
            F.min(inner).alias(f"first{i}"), F.max(inner).alias(f"last{i}"),
        ]
    row = df.agg(*exprs).first()
    return {
        c: _between_edges(bracket, middle[c], *(row[f"{kind}{i}"] for kind in ("low", "inner", "first", "last")))
        for i, (c, bracket) in enumerate(brackets.items())
    }


def _between_edges(
    bracket: tuple[float, float, int], middle: tuple[int, int], at_low: int, inside: int, first: float | None, last: float | None
) -> tuple[tuple[float, float, int], int, bool]:
    """The new bracket of one column, from the rows at its lower edge and those between its edges."""
    low, high, under = bracket
    start = under + at_low
    stop = start + inside
    if start <= middle[0] and middle[1] < stop:
        return (first, last, start), inside, first == last

    def at(place: int) -> float:
        if place < start:
            return low
        if place >= stop:
            return high
        return first if place == start else last

    # The two places are neighbours and one of them is outside, so the other one is an end of the inside.
    return (at(middle[0]), at(middle[1]), NEIGHBOURS), 0, True


def _ranked(
    df: DataFrame, middle: dict[str, tuple[int, int]], brackets: dict[str, tuple[float, float, int]]
) -> dict[str, float]:
    """Find the middle values among the distinct values of each bracket."""
    # A bracket of one value is the answer already.
    known = {c: low for c, (low, high, _) in brackets.items() if low == high}
    # Between two neighbours the middle is half way.
    known |= {c: low + (high - low) * 0.5 for c, (low, high, below) in brackets.items() if below == NEIGHBOURS}
    open_columns = [c for c in middle if c not in known]
    if not open_columns:
        return known
    entries, wanted = [], F.lit(False)
    for c in open_columns:
        low, high, below = brackets[c]
        value = finite(df, c)
        inside = value.between(F.lit(low), F.lit(high))
        wanted = wanted | F.coalesce(inside, F.lit(False))
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.when(inside, value).alias("value"),
                F.lit(middle[c][0] - below).cast("long").alias("first"),
                F.lit(middle[c][1] - below).cast("long").alias("last"),
            )
        )
    counts = (
        df.filter(wanted)
        .select(F.inline(F.array(*entries)))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "first", "last", "value")
        .agg(F.count("*").alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy("column").orderBy("value"))
    ranked = counts.withColumn("end", upto - 1).withColumn("start", F.col("end") - F.col("n") + 1)

    def at(position: str):
        return F.max(F.when(F.col(position).between(F.col("start"), F.col("end")), F.col("value")))

    rows = ranked.groupBy("column").agg(at("first").alias("a"), at("last").alias("b")).collect()
    return known | {r["column"]: r["a"] + (r["b"] - r["a"]) * 0.5 for r in rows}
