"""Column profiles. Each is one pass, or one aggregation by (column, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.operators.lookup import fitted
from tabloom.operators.ranks import column_quantiles, melt


def null_counts(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, n_rows, n_null), one pass."""
    columns = columns or frame.columns
    counts = frame.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot(["n_rows"], columns, "column_name", "n_null")


def value_table(frame: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """(keep, feature, value, n) with values as text; nulls are left out."""
    text = frame.select(*keep, *[F.col(c).cast("string").alias(c) for c in columns])
    return (
        text.unpivot(list(keep), columns, "feature", "value")
        .where(F.col("value").isNotNull())
        .groupBy(*keep, "feature", "value")
        .agg(F.count("*").alias("n"))
    )


def column_summary(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, n_distinct, min_value, max_value) for text or whole-number columns."""
    number = F.try_to_number(F.col("value"), F.lit("S99999999999999999"))
    order = F.struct(number.alias("a"), F.col("value").alias("b"))
    return value_table(frame, columns).groupBy("feature").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("n_distinct"),
        F.min_by("value", order).alias("min_value"),
        F.max_by("value", order).alias("max_value"),
    )


def common_values(frame: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The k most frequent values of each column, ties by value."""
    order = W.partitionBy("feature").orderBy(F.desc("n"), "value")
    return value_table(frame, columns).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def describe(frame: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column."""
    basic = melt(frame, [], columns).groupBy("feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    q = column_quantiles(frame, columns, [0.25, 0.5, 0.75])
    return basic.join(q, "feature").select(
        "feature", "n", "mean", "std", "min", F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("q50"),
        F.get("q", F.lit(2)).alias("q75"), "max",
    )


def value_count_matrix(frame: DataFrame, columns: list[str]) -> DataFrame:
    """value x column counts."""
    return melt(frame, [], columns).groupBy("value").pivot("feature", columns).agg(F.count(F.lit(1))).na.fill(0, columns)


def category_shares(frame: DataFrame, columns: list[str]) -> DataFrame:
    counts = fitted(value_table(frame, columns), "counts")
    return counts.join(counts.groupBy("feature").agg(F.sum("n").alias("_all")), "feature").withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def histogram(frame: DataFrame, columns: list[str], bins: int = 60, by: list[str] = ()) -> DataFrame:
    """(by, feature, bin, n, density): equal-width bins over the whole column's range."""
    bounds = frame.agg(
        F.struct(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in columns])
    ).scalar()
    located = frame.select(*by, *columns).withColumn("_b", bounds)
    binned = located.select(
        *by,
        *[
            F.when(
                F.col(c).isNotNull(),
                F.struct(
                    F.least(F.floor((F.col(c) - F.col(f"_b.{c}.lo")) * bins / (F.col(f"_b.{c}.hi") - F.col(f"_b.{c}.lo"))), F.lit(bins - 1)).cast("int").alias("bin"),
                    ((F.col(f"_b.{c}.hi") - F.col(f"_b.{c}.lo")) / bins).alias("width"),
                ),
            ).alias(c)
            for c in columns
        ],
    )
    counted = (
        binned.unpivot(list(by), columns, "feature", "cell").where(F.col("cell").isNotNull())
        .groupBy(*by, "feature", F.col("cell.bin").alias("bin"), F.col("cell.width").alias("width")).agg(F.count("*").alias("n"))
    )
    density = F.col("n") / (F.sum("n").over(W.partitionBy(*by, "feature")) * F.col("width"))
    return counted.withColumn("density", density).drop("width")


def quantile_lookup(train: DataFrame, columns: list[str], probs: list[float]) -> Column:
    """Exact train quantiles as a one-row map feature -> array, usable on any frame."""
    table = column_quantiles(train, columns, probs)
    return table.agg(F.map_from_entries(F.collect_list(F.struct("feature", "q")))).scalar()


def fence_profile(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Quartile fences: q1, q3, iqr, upper fence, rows beyond it, share of zeros, rule validity.

    With an IQR of 0 the rule says nothing, so the row count is null.
    """
    quartiles = column_quantiles(frame, columns, [0.25, 0.75]).select(
        "feature", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3")
    )
    fences = quartiles.withColumn("iqr", F.col("q3") - F.col("q1")).withColumn("fence", F.col("q3") + 1.5 * F.col("iqr"))
    counts = melt(frame, [], columns).groupBy("feature", "value").agg(F.count("*").alias("n"))
    return (
        counts.join(fences, "feature")
        .groupBy("feature", "q1", "q3", "iqr", "fence")
        .agg(
            F.min("value").alias("min"), F.max("value").alias("max"),
            (F.sum(F.when(F.col("value") == 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("share_zero"),
            F.sum(F.when(F.col("value") > F.col("fence"), F.col("n")).otherwise(0)).alias("_beyond"),
        )
        .withColumn("rule_valid", F.col("iqr") > 0)
        .withColumn("rows_beyond", F.when(F.col("rule_valid"), F.col("_beyond").cast("double")))
        .drop("_beyond")
    )


def domain_profile(frame: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows outside hand-set bounds per column, one pass."""
    counts = [F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in bounds.items()]
    return frame.agg(*counts).unpivot([], list(bounds), "feature", "rows_outside")


def tail_profile(frame: DataFrame, columns: list[str], label: str, score: Column, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Label rate and mean score in the upper tail against the body between both quantiles."""
    q = quantile_lookup(frame, columns, [low, high])
    rows = frame.select(label, score.alias("_score"), *[F.col(c).cast("double").alias(c) for c in columns]).withColumn("_q", q)
    long = rows.unpivot([label, "_score", "_q"], columns, "feature", "value")
    bounds = F.col("_q")[F.col("feature")]
    tail = F.col("value") >= bounds[1]
    body = (F.col("value") > bounds[0]) & (F.col("value") < bounds[1])
    return long.groupBy("feature").agg(
        F.count_if(tail).alias("n_extreme"),
        F.avg(F.when(tail, F.col("_score"))).alias("score_extreme"),
        F.avg(F.when(body, F.col("_score"))).alias("score_ordinary"),
        F.avg(F.when(tail, F.col(label))).alias("rate_extreme"),
        F.avg(F.when(body, F.col(label))).alias("rate_ordinary"),
    )


def label_rate_by_category(frame: DataFrame, columns: list[str], label: str) -> DataFrame:
    text = frame.select(label, *[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot([label], columns, "feature", "value").groupBy("feature", "value").agg(
        F.avg(label).alias("label_rate"), F.count("*").alias("n")
    )


def crosstab_shares(frame: DataFrame, row: str, column: str, levels: list[str]) -> DataFrame:
    """Share of each level of ``column`` inside every value of ``row``."""
    return frame.groupBy(row).agg(*[F.avg((F.col(column) == v).cast("double")).alias(v) for v in levels])


def top_value_coverage(frame: DataFrame, key: str, k: int = 20) -> DataFrame:
    """Distinct values, and rows covered by the k most frequent ones."""
    counts = frame.groupBy(key).agg(F.count("*").alias("n"))
    return frame.sparkSession.range(1).select(
        counts.agg(F.count("*")).scalar().alias("n_distinct"),
        counts.orderBy(F.desc("n"), key).limit(k).agg(F.sum("n")).scalar().alias("n_covered"),
        counts.agg(F.sum("n")).scalar().alias("n_rows"),
    )


def contradictions(frame: DataFrame, features: list[str], label: str) -> DataFrame:
    """Identical feature vectors that carry both labels; nulls count as equal."""
    vectors = frame.groupBy(*features).agg(F.count("*").alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    conflict = (F.col("n") > 1) & (F.col("lo") != F.col("hi"))
    return vectors.agg(
        F.count_if(F.col("n") > 1).alias("repeated_vectors"),
        F.count_if(conflict).alias("conflicting_vectors"),
        F.coalesce(F.sum(F.when(conflict, F.col("n"))), F.lit(0)).alias("rows_in_conflict"),
    )


def variance_ratios(frame: DataFrame, signature: list[Column], label: str, min_rows: int = 200, low: float = 0.03, high: float = 0.97) -> DataFrame:
    """Per coarse group: sample variance of the label over p(1-p)."""
    names = [f"s{i}" for i in range(len(signature))]
    groups = frame.groupBy(*[c.alias(n) for c, n in zip(signature, names)]).agg(
        F.count("*").alias("n"), F.avg(label).alias("rate"), F.var_samp(label).alias("variance")
    )
    return groups.where((F.col("n") >= min_rows) & F.col("rate").between(low, high)).withColumn(
        "ratio", F.col("variance") / (F.col("rate") * (1 - F.col("rate")))
    )


def score_zones(frame: DataFrame, score: str, label: str, edges: list[float]) -> DataFrame:
    """Rows and positive rate per right-closed score zone; the lowest edge is included."""
    zone = F.when(F.col(score) <= edges[1], 0)
    for i, upper in enumerate(edges[2:], start=1):
        zone = zone.when(F.col(score) <= upper, i)
    return frame.where(F.col(score).between(edges[0], edges[-1])).groupBy(zone.alias("zone")).agg(
        F.count("*").alias("n"), F.avg(label).alias("positive_rate")
    )
