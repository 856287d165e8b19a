"""Data-quality gates. Each returns report rows; ``require`` raises on a failed one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.operators.ranks import melt, range_buckets, running_totals

REPORT = ["check_name", "subject", "passed", "observed"]


def _report(frame: DataFrame, check: str, subject, passed: Column, observed: Column) -> DataFrame:
    subject = F.lit(subject) if isinstance(subject, str) else subject
    return frame.select(
        F.lit(check).alias("check_name"), subject.alias("subject"), passed.alias("passed"), observed.cast("double").alias("observed")
    )


def _filled(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n_values) of the present columns, one pass."""
    return frame.agg(*[F.count(c).alias(c) for c in columns]).unpivot([], columns, "_name", "n_values")


def required_columns(frame: DataFrame, required: list[str], optional: list[str] = ()) -> DataFrame:
    """One row per required, optional or unknown column, with its non-null values.

    A required column fails when it is absent or holds no value at all.
    """
    rows = [(c, "required") for c in required] + [(c, "optional") for c in optional]
    rows += [(c, "extra") for c in frame.columns if c not in {*required, *optional}]
    wanted = frame.sparkSession.createDataFrame(rows, "subject string, detail string")
    return (
        wanted.join(_filled(frame, frame.columns), F.col("subject") == F.col("_name"), "left")
        .withColumn("n_values", F.coalesce("n_values", F.lit(0)))
        .withColumn("passed", (F.col("detail") != "required") | (F.col("n_values") > 0))
        .drop("_name")
    )


def compare_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns present in only one of two tables, with their non-null values."""
    parts = []
    for frame, other, side in ((left, right, "left only"), (right, left, "right only")):
        only = [c for c in frame.columns if c not in other.columns]
        if only:
            parts.append(_filled(frame, only).select(F.col("_name").alias("column_name"), F.lit(side).alias("side"), "n_values"))
    if not parts:
        return left.sparkSession.createDataFrame([], "column_name string, side string, n_values bigint")
    return reduce(lambda a, b: a.unionByName(b), parts)


def value_range(frame: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """Rows out of [low, high] per column, in one pass."""
    bad = [F.count_if(~F.col(c).between(low, high)).alias(c) for c in columns]
    long = frame.agg(*bad).unpivot([], columns, "subject", "observed")
    return _report(long, "value_range", F.col("subject"), F.col("observed") == 0, F.col("observed"))


def offending_values(frame: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """The values out of [low, high] with their row counts."""
    return melt(frame, [], columns).where(~F.col("value").between(low, high)).groupBy("feature", "value").agg(F.count("*").alias("n"))


def missing_share(frame: DataFrame, columns: list[str], limit: float = 0.40) -> DataFrame:
    """Null share per column against a limit, in one pass."""
    shares = [F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]
    long = frame.agg(*shares).unpivot([], columns, "subject", "observed")
    return _report(long, "missing_share", F.col("subject"), F.col("observed") <= limit, F.col("observed"))


def repeated_keys(frame: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """The first few keys that occur more than once."""
    return frame.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").orderBy(key).limit(examples)


def unique_key(frame: DataFrame, key: str) -> DataFrame:
    """Gate: number of keys that occur more than once."""
    repeated = frame.groupBy(key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("observed"))
    return _report(repeated, "unique_key", key, F.col("observed") == 0, F.col("observed"))


def key_profile(frame: DataFrame, key: str) -> DataFrame:
    """Distinct, repeated, first and last key, and whether the range has gaps."""
    per_key = frame.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_distinct"),
        (F.sum("n") - F.count("*")).alias("n_repeated"),
        F.min(key).alias("first_key"),
        F.max(key).alias("last_key"),
    ).withColumn("gapless", F.col("last_key") - F.col("first_key") + 1 == F.col("n_distinct"))


def order_breaks(frame: DataFrame, position: str, key: str) -> DataFrame:
    """How often the key does not increase from one position to the next.

    Neighbours are compared inside range buckets of the position, and the last key
    of a bucket with the first key of the next one.
    """
    rows = frame.select(position, key)
    placed = range_buckets(rows, position, rows)
    inside = placed.withColumn("_prev", F.lag(key).over(W.partitionBy("_bucket").orderBy(position)))
    ends = placed.groupBy("_bucket").agg(F.min_by(key, position).alias("_first"), F.max_by(key, position).alias("_last"))
    seams = ends.withColumn("_prev", F.lag("_last").over(W.orderBy("_bucket")))
    return (
        inside.agg(F.count_if(F.col(key) <= F.col("_prev")).alias("n"))
        .unionByName(seams.agg(F.count_if(F.col("_first") <= F.col("_prev")).alias("n")))
        .agg(F.sum("n").alias("breaks"))
        .withColumn("increasing", F.col("breaks") == 0)
    )


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many distinct keys of ``left`` occur in ``right``."""
    return left.select(key).distinct().join(right.select(key), key, "left_semi").agg(F.count("*").alias("n_overlap"))


def key_ranges(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Key ranges of two tables and whether they are disjoint."""
    bounds = F.struct(F.min(key).alias("lo"), F.max(key).alias("hi"))
    both = left.sparkSession.range(1).select(left.agg(bounds).scalar().alias("a"), right.agg(bounds).scalar().alias("b"))
    return both.select(
        F.col("a.lo").alias("left_min"), F.col("a.hi").alias("left_max"),
        F.col("b.lo").alias("right_min"), F.col("b.hi").alias("right_max"),
        ((F.col("a.hi") < F.col("b.lo")) | (F.col("b.hi") < F.col("a.lo"))).alias("disjoint"),
    )


def duplicate_rows(frame: DataFrame, ignore: list[str]) -> DataFrame:
    """Rows repeating an earlier row when some columns are ignored."""
    columns = [c for c in frame.columns if c not in ignore]
    return frame.groupBy(*columns).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")
    )


def row_count_tolerance(frame: DataFrame, split: str, expected: dict[str, float], tolerance: float = 0.01) -> DataFrame:
    """Split sizes against expected shares of the whole."""
    sizes = frame.groupBy(split).agg(F.count("*").alias("n"))
    share = F.when(F.lit(False), F.lit(0.0))
    for name, value in expected.items():
        share = share.when(F.col(split) == name, F.lit(float(value)))
    want = share * F.sum("n").over(W.partitionBy(F.lit(0)))
    return sizes.select(
        F.lit("row_count").alias("check_name"), F.col(split).alias("subject"), want.alias("_want"), F.col("n")
    ).select("check_name", "subject", (F.abs(F.col("n") - F.col("_want")) <= tolerance * F.col("_want")).alias("passed"), F.col("n").cast("double").alias("observed"))


def tiles(frame: DataFrame, key: str, k: int, out: str = "tile") -> DataFrame:
    """``ntile(k)`` over a unique key, 1-based, without a global window."""
    placed = running_totals(frame.withColumn("_one", F.lit(1)), [], key, ["_one"])
    position, n = F.col("below__one"), F.col("all__one")
    size, larger = F.floor(n / k), n % k
    edge = larger * (size + 1)
    tile = F.when(position < edge, F.floor(position / (size + 1))).otherwise(larger + F.floor((position - edge) / size))
    return placed.withColumn(out, (tile + 1).cast("int")).drop("_one", "below__one", "all__one")


def label_rate_stability(frame: DataFrame, key: str, label: str, k: int = 10, spread: float = 0.05) -> DataFrame:
    """Label rate per key decile, and whether the rates stay within ``spread``."""
    rates = tiles(frame.select(key, label), key, k).groupBy("tile").agg(F.avg(F.col(label).cast("double")).alias("label_rate"), F.count("*").alias("n"))
    whole = W.partitionBy(F.lit(0))
    return rates.withColumn("passed", F.max("label_rate").over(whole) - F.min("label_rate").over(whole) < spread)


def base_rate_parity(frame: DataFrame, split: str, label: str, limit: float = 0.01) -> DataFrame:
    """Gap between the largest and smallest label rate of the splits."""
    rates = frame.groupBy(split).agg(F.avg(F.col(label).cast("double")).alias("rate"))
    gap = rates.agg((F.max("rate") - F.min("rate")).alias("observed"))
    return _report(gap, "base_rate_parity", split, F.col("observed") <= limit, F.col("observed"))


def quality_report(*reports: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [report.select(*REPORT) for report in reports])


def require(report: DataFrame) -> DataFrame:
    """Stop when any gate failed; the message names the first few."""
    failed = report.where(~F.col("passed")).limit(20).collect()
    if failed:
        raise ValueError("failed gates: " + ", ".join(f"{row.check_name}({row.subject})" for row in failed))
    return report


def contract_violations(contract: DataFrame, columns: DataFrame, banned: list[str], pending: list[str] = ()) -> DataFrame:
    """(violation, feature) rows of a dataset against the contract.

    missing: contract feature absent; unlisted: generated column neither used,
    dropped, banned nor pending; banned: banned column used; order: feature whose
    rank among the shared columns differs; no_levels: category without level list.
    """
    used = contract.where("position >= 0")
    shared_contract = used.select("feature", F.col("position").alias("_want"))
    present = columns.select("feature", F.col("position").alias("_have"))
    both = shared_contract.join(present, "feature")
    one = W.partitionBy(F.lit(0))  # a column list, not data
    moved = both.withColumns(
        {"_a": F.row_number().over(one.orderBy("_want")), "_b": F.row_number().over(one.orderBy("_have"))}
    ).where("_a != _b")
    allowed = [*banned, *pending]
    parts = {
        "missing": shared_contract.join(present, "feature", "left_anti"),
        "unlisted": present.join(contract, "feature", "left_anti").where(~F.col("feature").isin(allowed) if allowed else F.lit(True)),
        "banned": used.where(F.col("feature").isin(banned)),
        "pending_used": used.where(F.col("feature").isin(list(pending))) if pending else used.where(F.lit(False)),
        "order": moved,
        "no_levels": used.where("kind = 'category' and (levels is null or size(levels) = 0)"),
    }
    return reduce(
        lambda a, b: a.unionByName(b), [part.select(F.lit(name).alias("violation"), "feature") for name, part in parts.items()]
    )


def feature_nulls(frame: DataFrame, features: list[str]) -> DataFrame:
    """Features that hold nulls, with their counts."""
    counts = frame.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in features])
    return counts.unpivot([], features, "feature", "n_null").where("n_null > 0")


def unseen_values(frame: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, n): values that train never showed."""

    def long(source: DataFrame) -> DataFrame:
        return source.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "feature", "value")

    seen = long(train).distinct()
    return (
        long(frame).where(F.col("value").isNotNull())
        .groupBy("feature", "value").agg(F.count("*").alias("n"))
        .join(seen, ["feature", "value"], "left_anti")
    )


def oof_coverage(scored: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """One row: train keys never scored, scored more than once, and scored keys outside train."""
    per_key = scored.groupBy(key).agg(F.count("*").alias("_n"))
    both = train.select(key, F.lit(True).alias("_t")).join(per_key, key, "full_outer")
    return both.agg(
        F.count_if(F.col("_t") & F.col("_n").isNull()).alias("n_missing"),
        F.count_if(F.col("_t") & (F.col("_n") > 1)).alias("n_repeated"),
        F.count_if(F.col("_t").isNull()).alias("n_foreign"),
    ).withColumn("passed", (F.col("n_missing") == 0) & (F.col("n_repeated") == 0) & (F.col("n_foreign") == 0))
