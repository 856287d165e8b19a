"""Leak-safe target encodings as "totals minus own fold".

One aggregation by (key, fold) serves every fold: a row's value comes from the
totals of its key without the part of its own fold. Rows are never grouped
themselves, only joined to the aggregated table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.functions.scalars import logit, text_key
from tabloom.operators.lookup import join_fitted


def _smoothed(total: Column, count: Column, prior: Column, smoothing: float) -> Column:
    return (total + prior * F.lit(float(smoothing))) / (count + F.lit(float(smoothing)))


def fit_target_table(
    train: DataFrame, keys: list[str], label: str, smoothing: float, out: str = "te"
) -> DataFrame:
    """Full map ``(keys, out)``; nulls in a key form their own group."""
    prior = train.agg(F.avg(F.col(label).cast("double"))).scalar()
    stats = train.groupBy(*keys).agg(F.sum(F.col(label).cast("double")).alias("_s"), F.count(label).alias("_n"))
    return stats.select(*keys, _smoothed(F.col("_s"), F.col("_n"), prior, smoothing).alias(out))


def apply_target_table(frame: DataFrame, table: DataFrame, train: DataFrame, keys: list[str], label: str, out: str = "te") -> DataFrame:
    """Left join of the full map; unseen keys get the train rate."""
    prior = train.agg(F.avg(F.col(label).cast("double"))).scalar()
    return join_fitted(frame, table, keys).withColumn(out, F.coalesce(out, prior))


def oof_target_table(
    train: DataFrame, keys: list[str], label: str, fold: str, smoothing: float, prior: str = "fold", out: str = "te"
) -> DataFrame:
    """``(keys, fold, out)``: smoothed rate of each key in the other folds.

    ``prior='fold'`` uses the label rate of the other folds, ``'global'`` that of all rows.
    """
    y = F.col(label).cast("double")
    stats = train.groupBy(*keys, fold).agg(F.sum(y).alias("_s"), F.count(label).alias("_n"))
    whole = W.partitionBy(*keys)
    others = stats.withColumns(
        {"_os": F.sum("_s").over(whole) - F.col("_s"), "_on": F.sum("_n").over(whole) - F.col("_n")}
    )
    # k rows, one per fold
    per_fold = train.groupBy(fold).agg(F.sum(y).alias("_fs"), F.count(label).alias("_fn"))
    every = W.partitionBy(F.lit(0))
    priors = per_fold.select(
        fold,
        (
            (F.sum("_fs").over(every) - F.col("_fs")) / (F.sum("_fn").over(every) - F.col("_fn"))
            if prior == "fold"
            else F.sum("_fs").over(every) / F.sum("_fn").over(every)
        ).alias("_prior"),
    )
    return others.join(priors, fold).select(
        *keys, fold, _smoothed(F.col("_os"), F.col("_on"), F.col("_prior"), smoothing).alias(out)
    )


def oof_target_encode(
    train: DataFrame, keys: list[str], label: str, fold: str, smoothing: float, prior: str = "fold", out: str = "te"
) -> DataFrame:
    """Train rows with their out-of-fold encoding."""
    return join_fitted(train, oof_target_table(train, keys, label, fold, smoothing, prior, out), [*keys, fold])


def encode_key_sets(
    frame: DataFrame, key_sets: dict[str, list[str]], label: str, fold: str, smoothing: float, is_train: Column | None = None, prior: str = "fold"
) -> DataFrame:
    """Several encodings at once: out of fold on train rows, full map on the others.

    Without ``is_train`` every row is a train row. Otherwise train rows look up
    (keys, fold) and other rows the same keys under a null fold, so one join per key
    set serves both.
    """
    if is_train is None:
        result = frame
        for out, keys in key_sets.items():
            table = oof_target_table(frame, keys, label, fold, smoothing, prior, out)
            result = join_fitted(result, table, [*keys, fold])
        return result
    train = frame.where(is_train)
    result = frame.withColumn("_fold", F.when(is_train, F.col(fold)))
    rate = train.agg(F.avg(F.col(label).cast("double"))).scalar()
    for out, keys in key_sets.items():
        oof = oof_target_table(train, keys, label, fold, smoothing, prior, out).withColumnRenamed(fold, "_fold")
        full = fit_target_table(train, keys, label, smoothing, out).withColumn("_fold", F.lit(None).cast("int"))
        result = join_fitted(result, oof.unionByName(full), [*keys, "_fold"]).withColumn(out, F.coalesce(out, rate))
    return result.drop("_fold")


def nested_target_encode(
    frame: DataFrame, keys: list[str], label: str, outer: str, inner: str, is_train: Column, folds: int, smoothing: float, out: str = "tef"
) -> DataFrame:
    """Encodings refitted inside every outer fold.

    For each context (outer fold left out) the result holds every row once:
    ``role='fit'`` rows are cross-fitted over the inner folds, ``'held_out'`` and
    ``'score'`` rows take the map of all fit rows. All contexts come from one
    aggregation by (keys, outer, inner).
    """
    y = F.col(label).cast("double")
    train = frame.where(is_train)
    contexts = F.sequence(F.lit(0), F.lit(folds - 1))
    cells = train.groupBy(*keys, outer, inner).agg(F.sum(y).alias("_s"), F.count(label).alias("_n"))

    def left_out(table: DataFrame, by: list[str]) -> DataFrame:
        spread = table.withColumn("context", F.explode(contexts)).where(F.col(outer) != F.col("context"))
        per = spread.groupBy(*by, "context", inner).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
        whole = W.partitionBy(*by, "context")
        return per.withColumns({"_ts": F.sum("_s").over(whole), "_tn": F.sum("_n").over(whole)})

    prior_cells = train.groupBy(outer, inner).agg(F.sum(y).alias("_s"), F.count(label).alias("_n"))
    priors = left_out(prior_cells, [])
    fit_priors = priors.select("context", inner, ((F.col("_ts") - F.col("_s")) / (F.col("_tn") - F.col("_n"))).alias("_prior"))
    all_priors = priors.groupBy("context").agg((F.max("_ts") / F.max("_tn")).alias("_prior"))
    priors = fit_priors.unionByName(all_priors.withColumn(inner, F.lit(None).cast("int")))
    by_key = left_out(cells, keys)
    fit_sums = by_key.select(*keys, "context", inner, (F.col("_ts") - F.col("_s")).alias("_s"), (F.col("_tn") - F.col("_n")).alias("_n"))
    all_sums = by_key.groupBy(*keys, "context").agg(F.max("_ts").alias("_s"), F.max("_tn").alias("_n"))
    sums = fit_sums.unionByName(all_sums.withColumn(inner, F.lit(None).cast("int")))

    role = (
        F.when(~is_train, "score").when(F.col(outer) == F.col("context"), "held_out").otherwise("fit")
    )
    rows = (
        frame.withColumn("context", F.explode(contexts))
        .withColumn("role", role)
        .withColumn("_cell", F.when(F.col("role") == "fit", F.col(inner)))
    )
    rows = join_fitted(rows, priors.withColumnRenamed(inner, "_cell"), ["context", "_cell"])
    rows = join_fitted(rows, sums.withColumnRenamed(inner, "_cell"), [*keys, "context", "_cell"])
    value = _smoothed(F.coalesce("_s", F.lit(0.0)), F.coalesce("_n", F.lit(0)), F.col("_prior"), smoothing)
    return rows.withColumn(out, value).drop("_s", "_n", "_prior", "_cell")


def auto_smoothed_table(train: DataFrame, keys: list[str], label: str, out: str = "te") -> DataFrame:
    """Empirical-Bayes full map: the weight of a key's own mean is
    ``n*var_all / (n*var_all + var_key)``; the rest goes to the global mean."""
    y = F.col(label).cast("double")
    overall = train.agg(F.struct(F.avg(y).alias("m"), F.var_pop(y).alias("v"))).scalar()
    stats = train.groupBy(*keys).agg(F.count(label).alias("_n"), F.avg(y).alias("_m"), F.var_pop(y).alias("_v"))
    return _shrunk(stats.withColumn("_g", overall), keys, out)


def _shrunk(stats: DataFrame, keys: list[str], out: str) -> DataFrame:
    own = F.col("_n") * F.col("_g.v")
    weight = F.coalesce(F.try_divide(own, own + F.col("_v")), F.lit(1.0))
    return stats.select(*keys, (weight * F.col("_m") + (1 - weight) * F.col("_g.m")).alias(out))


def auto_smoothed_oof_table(train: DataFrame, keys: list[str], label: str, fold: str, out: str = "te") -> DataFrame:
    """The same, cross-fitted: for 0/1 labels sums and counts of the other folds give mean and variance."""
    y = F.col(label).cast("double")
    stats = train.groupBy(*keys, fold).agg(F.sum(y).alias("_s"), F.count(label).alias("_c"))
    whole = W.partitionBy(*keys)
    others = stats.select(
        *keys,
        fold,
        (F.sum("_c").over(whole) - F.col("_c")).alias("_n"),
        (F.sum("_s").over(whole) - F.col("_s")).alias("_os"),
    )
    per_fold = train.groupBy(fold).agg(F.sum(y).alias("_fs"), F.count(label).alias("_fn"))
    every = W.partitionBy(F.lit(0))
    rate = (F.sum("_fs").over(every) - F.col("_fs")) / (F.sum("_fn").over(every) - F.col("_fn"))
    overall = per_fold.select(fold, F.struct(rate.alias("m"), (rate * (1 - rate)).alias("v")).alias("_g"))
    mean = F.coalesce(F.try_divide(F.col("_os"), F.col("_n")), F.lit(0.0))
    joined = others.join(overall, fold).withColumn("_m", mean).withColumn("_v", F.col("_m") * (1 - F.col("_m")))
    # a key absent from the other folds has n = 0 and takes the prior
    own = F.col("_n") * F.col("_g.v")
    weight = F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(own, own + F.col("_v")), F.lit(1.0)))
    return joined.select(*keys, fold, (weight * F.col("_m") + (1 - weight) * F.col("_g.m")).alias(out))


def oof_rates(
    frame: DataFrame, keep: list[str], key_sets: dict[str, list[Column]], label: str, fold: str, smoothing: float
) -> DataFrame:
    """Out-of-fold rates for many key sets as ``(keep, label, fold, key_set, rate)``.

    All key sets are unpivoted to (key_set, key_value), null being a value of its
    own, so that a single aggregation fits them all.
    """
    long = frame.select(*keep, label, fold, F.inline(_key_values(key_sets)))
    table = oof_rate_table_by_set(long, frame, label, fold, smoothing)
    return join_fitted(long, table, ["key_set", "key_value", fold]).select(*keep, label, fold, "key_set", "rate")


def _key_values(key_sets: dict[str | int, list[Column]]) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("key_set"), text_key(columns).alias("key_value")) for name, columns in key_sets.items()])


def rate_logits(
    frame: DataFrame, key: str, key_sets: dict[str, list[Column]], label: str, fold: str, smoothing: float, eps: float = 1e-4
) -> DataFrame:
    """``(key, key_set, logit)``: clipped logits of the out-of-fold rates."""
    rates = oof_rates(frame, [key], key_sets, label, fold, smoothing)
    return rates.select(key, "key_set", logit("rate", eps).alias("logit"))


def rate_logit_columns(
    frame: DataFrame, key: str, key_sets: dict[str, list[Column]], label: str, fold: str, smoothing: float, eps: float = 1e-4
) -> DataFrame:
    """The same as one column per key set.

    Rows are dealt out by ``key`` while they are still small: unpivoted, joined to the rates and put together again they stay in their
    task, and nothing with a row per key set is shuffled.
    """
    pairs = _key_values(dict(enumerate(key_sets.values())))
    table = oof_rate_table_by_set(frame.select(label, fold, F.inline(pairs)), frame, label, fold, smoothing)
    table = table.select("key_set", "key_value", fold, logit("rate", eps).alias("logit"))
    long = join_fitted(frame.repartition(F.col(key)).select(key, fold, F.inline(pairs)), table, ["key_set", "key_value", fold])
    return long.groupBy(key).agg(*[F.first(F.when(F.col("key_set") == i, F.col("logit")), ignorenulls=True).alias(name) for i, name in enumerate(key_sets)])


def oof_rate_table_by_set(long: DataFrame, frame: DataFrame, label: str, fold: str, smoothing: float) -> DataFrame:
    y = F.col(label).cast("double")
    stats = long.groupBy("key_set", "key_value", fold).agg(F.sum(y).alias("_s"), F.count(label).alias("_n"))
    whole = W.partitionBy("key_set", "key_value")
    others = stats.withColumns(
        {"_os": F.sum("_s").over(whole) - F.col("_s"), "_on": F.sum("_n").over(whole) - F.col("_n")}
    )
    per_fold = frame.groupBy(fold).agg(F.sum(y).alias("_fs"), F.count(label).alias("_fn"))
    every = W.partitionBy(F.lit(0))
    priors = per_fold.select(
        fold, ((F.sum("_fs").over(every) - F.col("_fs")) / (F.sum("_fn").over(every) - F.col("_fn"))).alias("_prior")
    )
    return others.join(priors, fold).select(
        "key_set", "key_value", fold, _smoothed(F.col("_os"), F.col("_on"), F.col("_prior"), smoothing).alias("rate")
    )
