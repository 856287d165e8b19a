"""Per-key statistics joined back to rows, and joins with a second table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.lookup import fitted


def route_table(train: DataFrame, key: str, numeric: list[str], label: str, smoothing: float) -> DataFrame:
    """Per key: size, mean of each numeric column, smoothed label rate. Null keys are left out."""
    rate = train.agg(F.avg(F.col(label).cast("double"))).scalar()
    grouped = train.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("route_size"),
        *[F.avg(c).alias(f"route_mean_{c}") for c in numeric],
        F.sum(F.col(label).cast("double")).alias("_s"),
    )
    smoothed = (F.col("_s") + rate * F.lit(float(smoothing))) / (F.col("route_size") + F.lit(float(smoothing)))
    return grouped.withColumn("route_rate", smoothed).drop("_s")


def apply_route(frame: DataFrame, table: DataFrame, train: DataFrame, key: str, numeric: list[str], label: str) -> DataFrame:
    """Route columns on any rows: unseen keys get size 0, global means and the global rate;
    the residual of a null value is 0."""
    globals_ = train.agg(
        F.struct(*[F.avg(c).alias(f"route_mean_{c}") for c in numeric], F.avg(F.col(label).cast("double")).alias("route_rate"))
    ).scalar()
    joined = frame.join(fitted(table), key, "left").withColumn("_g", globals_)
    filled = joined.withColumns(
        {
            "route_size": F.coalesce("route_size", F.lit(0)),
            "route_rate": F.coalesce("route_rate", F.col("_g.route_rate")),
            **{f"route_mean_{c}": F.coalesce(f"route_mean_{c}", F.col(f"_g.route_mean_{c}")) for c in numeric},
        }
    )
    residuals = {f"routediff_{c}": F.coalesce(F.col(c) - F.col(f"route_mean_{c}"), F.lit(0.0)) for c in numeric}
    return filled.withColumns(residuals).drop("_g")


def key_profile_columns(frame: DataFrame, key: str, numeric: list[str]) -> DataFrame:
    """``fdm_<c>`` and ``fd_cnt`` over all rows.

    Aggregate and join instead of a window: a window would bring every row of a hot
    key to one task, the aggregate is combined before its shuffle.
    """
    means = frame.groupBy(key).agg(*[F.avg(c).alias(f"fdm_{c}") for c in numeric], F.count("*").alias("fd_cnt"))
    return frame.join(fitted(means), key, "left")


def second_table_rates(other: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(feature, value, rate): mean label of a second table per value of every column."""
    text = other.select(F.col(label).cast("double").alias("_y"), *[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot(["_y"], columns, "feature", "value").where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.avg("_y").alias("rate"))


def apply_second_table_rates(frame: DataFrame, rates: DataFrame, columns: list[str]) -> DataFrame:
    """``om_<c>``: the second table's rate of the row's value; null when it never occurred there."""
    stored = fitted(rates)
    for c in columns:
        own = stored.where(F.col("feature") == c).select(F.col("value").alias("_v"), F.col("rate").alias(f"om_{c}"))
        frame = frame.join(own, F.col(c).cast("string") == F.col("_v"), "left").drop("_v")
    return frame


def unseen_keys(frame: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """Rows whose key never occurred in train."""
    missing = frame.groupBy(key).agg(F.count("*").alias("n")).join(train.select(key).distinct(), key, "left_anti")
    return missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"))


def realign(rows: DataFrame, raw: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Raw columns put next to prepared rows by key."""
    return rows.join(raw.select(key, *columns), key)


def merge_tables(frames: list[DataFrame], label: str, recode: dict[str, int]) -> DataFrame:
    """Files of the same kind as one table: shared columns, label text to 0/1, exact duplicates dropped."""
    shared = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    merged = frames[0].select(*shared)
    for f in frames[1:]:
        merged = merged.unionByName(f.select(*shared))
    code = F.when(F.lit(False), F.lit(0))
    for text, value in recode.items():
        code = code.when(F.col(label) == text, F.lit(value))
    return merged.withColumn(label, code).dropDuplicates()


def expectation_columns(frame: DataFrame, targets: dict[str, list[str]], fold: str, eps: float = 1e-6) -> DataFrame:
    """``aux_p_<t>``, ``aux_ev_<t>`` per target and ``aux_sum_logp`` over all targets, out of fold.

    A key unseen in the other folds has probability 0 and no expected value.
    """
    total_log: Column = F.lit(0.0)
    for target, keys in targets.items():
        cells = frame.groupBy(*keys, target, fold).agg(F.count("*").alias("_n"), F.sum(target).cast("double").alias("_s"))
        by_value = cells.groupBy(*keys, target).agg(F.sum("_n").alias("_vn"))
        by_key = cells.groupBy(*keys).agg(F.sum("_n").alias("_kn"), F.sum("_s").alias("_ks"))
        by_fold = cells.groupBy(*keys, fold).agg(F.sum("_n").alias("_fn"), F.sum("_s").alias("_fs"))
        table = cells.join(by_value, [*keys, target]).join(by_fold, [*keys, fold]).join(by_key, keys)
        rest = F.col("_kn") - F.col("_fn")
        table = table.select(
            *keys, target, fold,
            F.coalesce(F.try_divide(F.col("_vn") - F.col("_n"), rest), F.lit(0.0)).alias(f"aux_p_{target}"),
            F.try_divide(F.col("_ks") - F.col("_fs"), rest).alias(f"aux_ev_{target}"),
        )
        frame = frame.join(fitted(table), [*keys, target, fold], "left")
        total_log = total_log + F.ln(F.greatest(F.col(f"aux_p_{target}"), F.lit(eps)))
    return frame.withColumn("aux_sum_logp", total_log)
