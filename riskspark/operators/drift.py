"""Drift of a current table against a reference table, column by column.

Both tables are tagged and stacked, so each column is compared with grouped counts instead of
a join of two frequency tables. Columns are compared by distances (normed Wasserstein, Jensen-Shannon) or,
where a caller asks for them, by hypothesis tests (Kolmogorov-Smirnov, chi-square, two-proportion z).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark import config
from riskspark.functions.columns import finite, present
from riskspark.functions.pvalues import chi_square, kolmogorov, normal_two_sided
from riskspark.operators.bounds import INTERVALS, bounded_distances
from riskspark.operators.prefix import add_buckets, cut_points, running_totals
from riskspark.session import cut_lineage

METHODS = ("distance", "test", "by_size", "bounded")
#: Doubles added up in another order differ by less; a bound that is nearer to the limit settles nothing.
ROUNDING = 1e-9
RESULT = (
    "feature string, kind string, test string, statistic double, p_value double, drifted boolean"
)


def require_reference(reference: DataFrame | None) -> DataFrame:
    if reference is None:
        raise ValueError("Drift needs a reference table; none was given.")
    return reference


@dataclass(frozen=True)
class ColumnProfile:
    """What decides a column's test: one row per column on the driver."""

    name: str
    numeric: bool
    reference_rows: int
    current_rows: int
    reference_std: float | None
    distinct: int  # numeric columns only


def stack(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both tables with a tag. Columns that are numeric on both sides become doubles, others text."""
    def side(df: DataFrame, tag: bool) -> DataFrame:
        chosen = []
        for c in columns:
            if _numeric(reference, c) and _numeric(current, c):
                chosen.append(finite(df, c).alias(c))
            else:
                chosen.append(present(df, c).cast("string").alias(c))
        return df.select(*chosen, F.lit(tag).alias("__reference"))

    return side(reference, True).unionByName(side(current, False))


def _numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def comparable_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    """Columns of both tables that hold numbers, text or booleans."""
    kinds = (T.NumericType, T.StringType, T.BooleanType)
    return [
        f.name
        for f in reference.schema
        if f.name in current.columns
        and isinstance(f.dataType, kinds)
        and isinstance(current.schema[f.name].dataType, kinds)
    ]


def _profile(stacked: DataFrame, columns: Sequence[str], few: int) -> tuple[int, list[ColumnProfile]]:
    """Sizes, spread and number of values of every column.

    A sketch settles which numeric columns have many values; only the others are counted
    exactly, so the exact count never shuffles a column with many values.
    """
    ref = F.col("__reference")
    exprs = [F.count_if(ref).alias("__n")]
    for c in columns:
        exprs += [
            F.count(F.when(ref, F.col(c))).alias(f"{c}__ref"),
            F.count(F.when(~ref, F.col(c))).alias(f"{c}__cur"),
        ]
        if _numeric(stacked, c):
            exprs += [
                F.approx_count_distinct(c).alias(f"{c}__values"),
                F.stddev_pop(F.when(ref, F.col(c))).alias(f"{c}__std"),
            ]
    row = stacked.agg(*exprs).first().asDict()
    distinct = {c: row.get(f"{c}__values", 0) for c in columns}
    unsure = [c for c in columns if 0 < distinct[c] <= 10 * few]
    if unsure:
        exact = stacked.agg(*[F.count_distinct(c).alias(c) for c in unsure]).first()
        distinct |= {c: exact[c] for c in unsure}
    return row["__n"], [
        ColumnProfile(
            c, _numeric(stacked, c), row[f"{c}__ref"], row[f"{c}__cur"], row.get(f"{c}__std"), distinct[c]
        )
        for c in columns
    ]


def profile(stacked: DataFrame, columns: Sequence[str], few: int = config.DRIFT_CATEGORICAL_UP_TO) -> list[ColumnProfile]:
    """The profiles of the columns of a stacked table."""
    return _profile(stacked, columns, few)[1]


def _sizes_table(stacked: DataFrame, profiles: Sequence[ColumnProfile]) -> DataFrame:
    """One row per compared column, safe to broadcast."""
    rows = [
        (i, p.name, p.reference_rows, p.current_rows, p.reference_std) for i, p in enumerate(profiles)
    ]
    schema = "at int, feature string, n_ref long, n_cur long, std_ref double"
    return F.broadcast(stacked.sparkSession.createDataFrame(rows, schema))


def numeric_distances(
    stacked: DataFrame, profiles: Sequence[ColumnProfile], buckets: int | None = None
) -> DataFrame:
    """Per numeric column: ``ks`` and ``wasserstein`` (divided by the reference deviation).

    The two distribution functions are running counts over the sorted values, spread over
    buckets of the value.
    """
    names = [p.name for p in profiles]
    bucketed = add_buckets(
        stacked.select(*names, "__reference").fillna(float("-inf"), names),
        cut_points(stacked, names, buckets),
    )
    counts = (
        bucketed.select("__reference", F.inline(_entries(names)))
        .filter(F.col("value") > float("-inf"))
        .groupBy("at", "bucket", "value")
        .agg(F.count_if("__reference").alias("ref"), F.count_if(~F.col("__reference")).alias("cur"))
    )
    return distances_of_counts(counts, profiles)


def _entries(names: Sequence[str]) -> Column:
    """A row's values with their buckets. A column travels as its position: one row per distinct value is shuffled."""
    return F.array(*[
        F.struct(F.lit(i).alias("at"), F.col(f"{c}__bucket").alias("bucket"), F.col(c).alias("value"))
        for i, c in enumerate(names)
    ])


def distances_of_counts(counts: DataFrame, profiles: Sequence[ColumnProfile]) -> DataFrame:
    """``numeric_distances`` from ``ref`` and ``cur`` rows of each (at, bucket, value), ``at`` being a profile's place."""
    steps = running_totals(counts, ["at"], "bucket", "value", ["ref", "cur"]).join(
        _sizes_table(counts, profiles), "at"
    )
    upto_ref = (F.col("ref_before") + F.col("ref")).cast("double") / F.nullif(F.col("n_ref"), F.lit(0))
    upto_cur = (F.col("cur_before") + F.col("cur")).cast("double") / F.nullif(F.col("n_cur"), F.lit(0))
    gap = F.abs(upto_ref - upto_cur)
    area = gap * (F.col("next_value") - F.col("value"))
    return (
        steps.groupBy("at", "feature", "n_ref", "n_cur", "std_ref")
        .agg(F.max(gap).alias("ks"), F.sum(F.coalesce(area, F.lit(0.0))).alias("area"))
        .select(
            "feature",
            "n_ref",
            "n_cur",
            "ks",
            # Fixed value: the smallest deviation the distance is divided by.
            F.when(
                F.col("ks").isNotNull(), F.col("area") / F.greatest(F.col("std_ref"), F.lit(0.001))
            ).alias("wasserstein"),
        )
    )


def category_frequencies(stacked: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, value, ref, cur``: rows per category on each side, 0 where it does not occur."""
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    return (
        stacked.select("__reference", F.inline(entries))
        .filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count_if("__reference").alias("ref"), F.count_if(~F.col("__reference")).alias("cur"))
    )


def categorical_distances(
    frequencies: DataFrame, profiles: Sequence[ColumnProfile]
) -> DataFrame:
    """Per column: ``chi2`` with its ``degrees``, ``z`` and ``jensen_shannon``."""
    known = frequencies.join(_sizes_table(frequencies, profiles).drop("at"), "feature")
    n_ref, n_cur = (F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in ("n_ref", "n_cur"))
    expected = F.col("ref") * n_cur / n_ref
    term = F.when(F.col("ref") == 0, F.lit(float("inf"))).otherwise(
        F.try_divide((F.col("cur") - expected) * (F.col("cur") - expected), expected)
    )
    p, q = F.col("ref") / n_ref, F.col("cur") / n_cur
    middle = (p + q) / 2
    divergence = (
        F.when(F.col("ref") > 0, p * F.ln(p / middle)).otherwise(0.0)
        + F.when(F.col("cur") > 0, q * F.ln(q / middle)).otherwise(0.0)
    ) / 2
    pooled = (F.col("ref") + F.col("cur")) / (n_ref + n_cur)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n_ref + 1 / n_cur))
    sums = known.groupBy("feature", "n_ref", "n_cur").agg(
        F.sum(term).alias("chi2"),
        (F.count("*") - 1).alias("degrees"),
        F.max(F.coalesce(F.abs(F.try_divide(p - q, error)), F.lit(0.0))).alias("z"),
        F.sqrt(F.greatest(F.sum(divergence), F.lit(0.0))).alias("jensen_shannon"),
    )
    two_sided = (F.col("n_ref") > 0) & (F.col("n_cur") > 0)
    return sums.withColumns(
        {c: F.when(two_sided, F.col(c)) for c in ("chi2", "z", "jensen_shannon")}
    )


def _small(method: str, rows: int, small_reference: int) -> bool:
    """Whether columns are compared by hypothesis tests."""
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}, not {method}")
    return rows <= small_reference if method == "by_size" else method == "test"


def drift_report(
    reference: DataFrame | None,
    current: DataFrame,
    columns: Sequence[str] | None = None,
    p_value: float = config.DRIFT_P_VALUE,
    distance: float = config.DRIFT_DISTANCE,
    small_reference: int = config.DRIFT_SMALL_REFERENCE,
    few_values: int = config.DRIFT_CATEGORICAL_UP_TO,
    buckets: int | None = None,
    method: str = "distance",
) -> DataFrame:
    """One row per column: its kind, the test, its statistic, the p-value if any, and the verdict.

    ``method`` is ``distance`` (distances between the distributions), ``test`` (hypothesis tests) or, by name only,
    ``by_size``: tests up to ``small_reference`` reference rows, distances above. ``bounded`` gives the verdicts of ``distance``
    without shuffling the values of numeric columns: their statistic is an estimate with a proven error
    (test ``wasserstein_bounded``), and only columns whose error reaches over the limit are measured exactly.

    Missing and infinite values are left out. A column without values on one side has no
    statistic and does not count as drifted.
    """
    reference = require_reference(reference)
    names = list(columns) if columns else comparable_columns(reference, current)
    spark = current.sparkSession
    if not names:
        return spark.createDataFrame([], RESULT)
    stacked = stack(reference, current, names)
    rows, profiles = _profile(stacked, names, few_values)
    small = _small(method, rows, small_reference)
    many = [p for p in profiles if p.numeric and p.distinct > few_values]
    few = [p for p in profiles if p not in many]
    numeric = None
    if many:
        numeric = settled_distances(stacked, many, distance, buckets) if method == "bounded" else numeric_distances(stacked, many, buckets)
    return _judged(
        spark, profiles, numeric,
        categorical_distances(category_frequencies(stacked, [p.name for p in few]), few) if few else None,
        small, p_value, distance,
    )


def distance_bounds(stacked: DataFrame, profiles: Sequence[ColumnProfile], intervals: int = INTERVALS) -> DataFrame:
    """``numeric_distances`` as estimates, with ``ks_error`` and ``wasserstein_error`` that the exact ones keep to."""
    return bounded_distances(stacked, [p.name for p in profiles], "__reference", _sizes_table(stacked, profiles), intervals)


def settled_distances(
    stacked: DataFrame, profiles: Sequence[ColumnProfile], limit: float, buckets: int | None = None, intervals: int = INTERVALS
) -> DataFrame:
    """``feature, n_ref, n_cur, ks, wasserstein, exact``: estimates that lie on the right side of ``limit``, exact where these can't tell.

    One row per column goes through the driver.
    """
    fields = ["feature", "n_ref", "n_cur", "ks", "wasserstein"]
    open_columns, known = set(), []
    for r in distance_bounds(stacked, profiles, intervals).collect():
        error = (r["wasserstein_error"] or 0.0) + ROUNDING
        # Written so that an overflow, which is no number, counts as open.
        settled = r["wasserstein"] is None or abs(r["wasserstein"] - limit) > error
        if settled:
            known.append((*(r[f] for f in fields), False))
        else:
            open_columns.add(r["feature"])
    schema = "feature string, n_ref long, n_cur long, ks double, wasserstein double, exact boolean"
    estimates = stacked.sparkSession.createDataFrame(known, schema)
    if not open_columns:
        return estimates
    exact = numeric_distances(stacked, [p for p in profiles if p.name in open_columns], buckets)
    return estimates.unionByName(exact.select(*fields, F.lit(True).alias("exact")))


def _judged(
    spark: SparkSession, profiles: Sequence[ColumnProfile], numeric: DataFrame | None, categorical: DataFrame | None,
    small: bool, p_value: float, distance: float,
) -> DataFrame:
    """The report from what was measured of numeric columns and of those with categories."""
    kinds = F.broadcast(
        spark.createDataFrame(
            [(p.name, "numeric" if p.numeric else "categorical") for p in profiles],
            "feature string, kind string",
        )
    )
    parts = []
    none = F.lit(None).cast("double")
    if numeric is not None:
        measured = numeric
        if small:
            tail = kolmogorov(F.col("ks"), F.col("n_ref"), F.col("n_cur"))
            parts.append(measured.select("feature", F.lit("ks").alias("test"), F.col("ks").alias("statistic"), tail.alias("p_value")))
        else:
            test = F.when(F.col("exact"), "wasserstein").otherwise("wasserstein_bounded") if "exact" in measured.columns else F.lit("wasserstein")
            parts.append(measured.select("feature", test.alias("test"), F.col("wasserstein").alias("statistic"), none.alias("p_value")))
    if categorical is not None:
        measured = categorical
        if small:
            two = F.col("degrees") <= 1
            parts.append(
                measured.withColumn("__chi", chi_square("chi2", F.col("degrees").cast("double")))
                .withColumn("__z", normal_two_sided("z"))
                .select(
                    "feature",
                    F.when(two, "z").otherwise("chi_square").alias("test"),
                    F.when(two, F.col("z")).otherwise(F.col("chi2")).alias("statistic"),
                    F.when(two, F.col("__z")).otherwise(F.col("__chi")).alias("p_value"),
                )
            )
        else:
            parts.append(measured.select("feature", F.lit("jensen_shannon").alias("test"), F.col("jensen_shannon").alias("statistic"), none.alias("p_value")))
    results = parts[0]
    for part in parts[1:]:
        results = results.unionByName(part)
    drifted = F.when(F.col("test").isin("ks", "chi_square", "z"), F.col("p_value") < p_value).otherwise(
        F.col("statistic") >= distance
    )
    return kinds.join(results, "feature", "left").select(
        "feature", "kind", "test", "statistic", "p_value", F.coalesce(drifted, F.lit(False)).alias("drifted")
    )


@dataclass(frozen=True)
class PreparedReference:
    """A drift reference as counts: what a comparison needs of it, without its rows.

    ``counts`` is stored and has ``ref`` rows per column (``at``) and distinct value: of numeric columns by ``bucket``
    and ``value``, of all by ``text``.
    """

    columns: tuple[str, ...]
    numeric: tuple[str, ...]
    rows: int
    filled: dict[str, int]
    deviation: dict[str, float | None]
    distinct: dict[str, int]
    cuts: dict[str, list[float]]
    counts: DataFrame


def _value_counts(df: DataFrame, columns: Sequence[str], numeric: Sequence[str], cuts: dict[str, list[float]], name: str) -> DataFrame:
    """Rows per column and distinct value of a cleaned table, in one pass; stored."""
    bucketed = add_buckets(df.fillna(float("-inf"), list(numeric)), cuts)
    nothing, none = F.lit(None).cast("double"), F.lit(None).cast("string")
    entries = [
        F.struct(F.lit(i).alias("at"), F.col(f"{c}__bucket").alias("bucket"), F.col(c).alias("value"), none.alias("text"))
        if c in numeric else
        F.struct(F.lit(i).alias("at"), F.lit(0).alias("bucket"), nothing.alias("value"), F.col(c).alias("text"))
        for i, c in enumerate(columns)
    ]
    rows = bucketed.select(F.inline(F.array(*entries))).filter((F.col("value") > float("-inf")) | F.col("text").isNotNull())
    counted = rows.groupBy("at", "bucket", "value", "text").agg(F.count("*").alias(name))
    return cut_lineage(counted, "drift-counts")


def _cleaned(df: DataFrame, columns: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    return df.select(*(finite(df, c).alias(c) if c in numeric else present(df, c).cast("string").alias(c) for c in columns))


def prepare_reference(
    reference: DataFrame | None, columns: Sequence[str] | None = None, numeric: Sequence[str] | None = None,
    buckets: int | None = None,
) -> PreparedReference:
    """Count the values of a reference once, for any number of comparisons.

    ``numeric`` columns are compared as numbers if the current table has numbers there as well (the default: those that are
    numeric in the reference). Edges of buckets, sizes and deviations reach the driver; the counts are stored.
    """
    reference = require_reference(reference)
    names = tuple(columns or comparable_columns(reference, reference))
    numbers = tuple(c for c in names if _numeric(reference, c) and (numeric is None or c in numeric))
    rows = _cleaned(reference, names, numbers)
    cuts = cut_points(rows, list(numbers), buckets) if numbers else {}
    sizes = rows.agg(
        F.count("*").alias("__n"), *(F.count(c).alias(f"{c}__filled") for c in names),
        *(F.stddev_pop(c).alias(f"{c}__std") for c in numbers)).first()
    counts = _value_counts(rows, names, numbers, cuts, "ref")
    distinct = {names[r["at"]]: r["n"] for r in counts.groupBy("at").agg(F.count("*").alias("n")).collect()}
    return PreparedReference(
        names, numbers, sizes["__n"], {c: sizes[f"{c}__filled"] for c in names},
        {c: sizes[f"{c}__std"] for c in numbers}, distinct, cuts, counts)


def drift_report_against(
    prepared: PreparedReference,
    current: DataFrame,
    p_value: float = config.DRIFT_P_VALUE,
    distance: float = config.DRIFT_DISTANCE,
    small_reference: int = config.DRIFT_SMALL_REFERENCE,
    few_values: int = config.DRIFT_CATEGORICAL_UP_TO,
    method: str = "distance",
) -> DataFrame:
    """``drift_report`` against a prepared reference: the current rows are counted, and the counts of both sides meet."""
    spark, names = current.sparkSession, prepared.columns
    if not names:
        return spark.createDataFrame([], RESULT)
    text = [c for c in prepared.numeric if not _numeric(current, c)]
    if method == "bounded":
        raise ValueError("Counts of a prepared reference are compared exactly; method bounded is for two tables.")
    if text:
        raise ValueError(f"The reference holds numbers where the current table does not: {text}")
    own = _value_counts(_cleaned(current, names, prepared.numeric), names, prepared.numeric, prepared.cuts, "cur")
    filled = {r["at"]: r["n"] for r in own.groupBy("at").agg(F.sum("cur").alias("n")).collect()}
    zero = F.lit(0).cast("long")
    merged = (
        prepared.counts.withColumn("cur", zero).unionByName(own.withColumn("ref", zero))
        .groupBy("at", "bucket", "value", "text").agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    )
    # Values of both sides are counted for columns of few values in the reference; the others have many whatever comes.
    unsure = [i for i, c in enumerate(names) if c in prepared.numeric and prepared.distinct.get(c, 0) <= few_values]
    values = {r["at"]: r["n"] for r in merged.where(F.col("at").isin(unsure)).groupBy("at").agg(
        F.count("*").alias("n")).collect()} if unsure else {}
    profiles = [
        ColumnProfile(c, c in prepared.numeric, prepared.filled[c], filled.get(i, 0), prepared.deviation.get(c),
                      values.get(i, 0) if i in unsure else prepared.distinct.get(c, 0))
        for i, c in enumerate(names)
    ]
    many = [p for p in profiles if p.numeric and p.distinct > few_values]
    few = [p for p in profiles if p not in many]

    def chosen(some: Sequence[ColumnProfile]) -> DataFrame:
        """The counts of these columns, with the place of each among them."""
        at = F.create_map(*(x for i, p in enumerate(some) for x in (F.lit(names.index(p.name)), F.lit(i))))
        return merged.where(F.col("at").isin([names.index(p.name) for p in some])).withColumn("at", at[F.col("at")])

    frequencies = None
    if few:
        labels = F.array(*(F.lit(p.name) for p in few))
        value = F.coalesce("text", F.col("value").cast("string"))
        frequencies = chosen(few).select(F.get(labels, F.col("at")).alias("feature"), value.alias("value"), "ref", "cur")
    return _judged(
        spark, profiles, distances_of_counts(chosen(many).select("at", "bucket", "value", "ref", "cur"), many) if many else None,
        categorical_distances(frequencies, few) if few else None, _small(method, prepared.rows, small_reference), p_value, distance,
    )


def drift_summary(report: DataFrame, dataset_share: float = config.DRIFT_DATASET_SHARE) -> DataFrame:
    """One row: ``drift_detected, drifted_features, drift_share, total_features``."""
    return report.agg(
        F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("feature")))).alias("drifted_features"),
        F.coalesce(F.avg(F.col("drifted").cast("double")), F.lit(0.0)).alias("drift_share"),
        F.count("*").alias("total_features"),
    ).select(
        ((F.col("total_features") > 0) & (F.col("drift_share") >= dataset_share)).alias("drift_detected"),
        "drifted_features",
        "drift_share",
        "total_features",
    )


def drift_tests(report: DataFrame, share_limit: float = config.DRIFT_DATASET_SHARE) -> DataFrame:
    """Pass or fail per column, and one row for the share of drifted columns."""
    verdict = F.when(F.col("drifted"), "FAIL").otherwise("SUCCESS")
    per_column = report.select(
        F.concat(F.lit("drift:"), F.col("feature")).alias("name"), verdict.alias("status")
    )
    share = F.coalesce(F.avg(F.col("drifted").cast("double")), F.lit(0.0))
    overall = report.agg(share.alias("share")).select(
        F.lit("share_of_drifted_columns").alias("name"),
        F.when(F.col("share") < share_limit, "SUCCESS").otherwise("FAIL").alias("status"),
    )
    return per_column.unionByName(overall)


def prediction_drift(
    reference: DataFrame, current: DataFrame, column: str = "prediction", **limits
) -> DataFrame:
    return drift_report(reference, current, [column], **limits)
