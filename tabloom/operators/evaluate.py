"""Metrics at a threshold, rule baselines, error reading, ceilings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.functions.hashing import hash_unit
from tabloom.functions.scalars import ratio
from tabloom.operators.ranks import auc, melt, running_totals


def hard_label(score: str | Column, threshold: float = 0.5) -> Column:
    return ((F.col(score) if isinstance(score, str) else score) >= threshold).cast("int")


def confusion(
    rows: DataFrame, score: str, label: str, threshold: float = 0.5, by: list[str] = (), no_flag_precision: float = 0.0
) -> DataFrame:
    """tp, fp, fn, tn and the rates at a threshold; ``no_flag_precision`` applies when nothing is flagged."""
    flagged, positive = F.col(score) >= threshold, F.col(label) == 1
    aggs = [
        F.count_if(flagged & positive).alias("tp"), F.count_if(flagged & ~positive).alias("fp"),
        F.count_if(~flagged & positive).alias("fn"), F.count_if(~flagged & ~positive).alias("tn"),
    ]
    counts = rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + fp + fn + tn, 0.0),
            "precision": ratio(tp, tp + fp, no_flag_precision),
            "recall": ratio(tp, tp + fn, 0.0),
            "f1": ratio(2 * tp, 2 * tp + fp + fn, 0.0),
        }
    )


def rule_scores(rows: DataFrame, rules: dict[str, Column], label: str) -> DataFrame:
    """Every rule "condition => positive" in one aggregation: accuracy, precision
    (1.0 when nothing is flagged), recall, flagged rows and the AUC of the 0/1 prediction."""
    entries = F.array(
        *[F.struct(F.lit(name).alias("rule"), F.coalesce(cond, F.lit(False)).cast("int").alias("flag")) for name, cond in rules.items()]
    )
    long = rows.select(F.col(label).cast("int").alias("_y"), F.inline(entries))
    table = confusion(long, "flag", "_y", 0.5, ["rule"], no_flag_precision=1.0)
    hit, alarm = ratio(F.col("tp"), F.col("tp") + F.col("fn")), ratio(F.col("fp"), F.col("fp") + F.col("tn"))
    return table.withColumns({"rows_flagged": F.col("tp") + F.col("fp"), "auc": (1 + hit - alarm) / 2})


def ranked_rules(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("accuracy"), "rule")


def _confidence(score: str, label: str) -> Column:
    """Confidence in the wrong answer."""
    return F.when(F.col(label) == 1, 1 - F.col(score)).otherwise(F.col(score))


def wrong_rows(rows: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    return rows.where(hard_label(score, threshold) != F.col(label)).withColumn("confidence", _confidence(score, label))


def worst_mistakes(rows: DataFrame, key: str, score: str, label: str, threshold: float = 0.5, limit: int = 20) -> DataFrame:
    """The most confident wrong rows; their total is counted by ``wrong_rows``, not here."""
    return wrong_rows(rows, score, label, threshold).orderBy(F.desc("confidence"), key).limit(limit)


def sorted_extremes(rows: DataFrame, key: str, score: str, k: int = 10) -> DataFrame:
    """The k lowest and the k highest scores."""
    low = rows.orderBy(score, key).limit(k).withColumn("end", F.lit("lowest"))
    high = rows.orderBy(F.desc(score), key).limit(k).withColumn("end", F.lit("highest"))
    return low.unionByName(high)


def hardness(score: str, label: str, low: float = 0.10, high: float = 0.90) -> Column:
    """hard/easy positive/negative, null for rows between both cuts."""
    p, positive = F.col(score), F.col(label) == 1
    return (
        F.when(positive & (p < low), "hard positive").when(positive & (p > high), "easy positive")
        .when(~positive & (p > high), "hard negative").when(~positive & (p < low), "easy negative")
    )


def numeric_contrast(rows: DataFrame, group: str, a: str, b: str, columns: list[str]) -> DataFrame:
    """Mean of every column in two groups and the absolute difference."""
    long = melt(rows.where(F.col(group).isin(a, b)), [group], columns)
    means = long.groupBy("feature").agg(
        F.avg(F.when(F.col(group) == a, F.col("value"))).alias("mean_a"), F.avg(F.when(F.col(group) == b, F.col("value"))).alias("mean_b")
    )
    return means.withColumn("abs_difference", F.abs(F.col("mean_a") - F.col("mean_b")))


def mode_contrast(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Most frequent value of each column per group, with its share (ties: smallest value)."""
    text = rows.where(F.col(group).isNotNull()).select(group, *[F.col(c).cast("string").alias(c) for c in columns])
    counts = text.unpivot([group], columns, "feature", "value").groupBy(group, "feature", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy(group, "feature").agg(F.sum("n").alias("_all"))
    first = W.partitionBy(group, "feature").orderBy(F.desc("n"), "value")
    top = counts.where(F.col("value").isNotNull()).withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return top.join(totals, [group, "feature"]).select(group, "feature", F.col("value").alias("mode"), (F.col("n") / F.col("_all")).alias("share"))


def single_worst(rows: DataFrame, key: str, score: str, label: str) -> DataFrame:
    """The full row of the positive scored lowest and of the negative scored highest (ties: smallest key)."""
    row = F.struct(*rows.columns)
    positive = rows.where(F.col(label) == 1).agg(F.min_by(row, F.struct(F.col(score), F.col(key))).alias("row"))
    negative = rows.where(F.col(label) == 0).agg(F.min_by(row, F.struct(-F.col(score), F.col(key))).alias("row"))
    return positive.select(F.lit("positive").alias("mistake"), "row.*").unionByName(negative.select(F.lit("negative").alias("mistake"), "row.*"))


def headroom(rows: DataFrame, score: str, label: str, low: float = 0.10, high: float = 0.90) -> DataFrame:
    """AUC now and AUC if every hard row were ranked perfectly."""
    kind = hardness(score, label, low, high)
    fixed = F.when(kind == "hard positive", 1.0).when(kind == "hard negative", 0.0).otherwise(F.col(score))
    both = rows.select(label, F.inline(F.array(
        F.struct(F.lit("current").alias("variant"), F.col(score).alias("_s")), F.struct(F.lit("fixed").alias("variant"), fixed.alias("_s")))))
    table = auc(both, "_s", label, by=["variant"])
    return table.agg(
        F.max(F.when(F.col("variant") == "current", F.col("auc"))).alias("current_auc"),
        F.max(F.when(F.col("variant") == "fixed", F.col("auc"))).alias("fixed_auc"),
    ).withColumn("available", F.col("fixed_auc") - F.col("current_auc"))


def drawn_label(key: str, score: str, seed: int | str, votes: int = 1) -> Column:
    """A label drawn from its own probability; with several votes the (at least half) majority."""
    hits = [(hash_unit(key, f"{seed}-{v}") < F.col(score)).cast("int") for v in range(votes)]
    total = reduce(lambda a, b: a + b, hits)
    return (total * 2 >= votes).cast("int")


def draw_ceiling(rows: DataFrame, key: str, score: str, draws: int, seed: int | str, votes: int = 1) -> DataFrame:
    """(draw, auc) of the scores against labels drawn from them.

    All draws are separate sums of one aggregation by score, so no row is copied.
    """
    names = [f"d{i}" for i in range(draws)]
    drawn = rows.where(F.col(score).isNotNull()).select(F.col(score).alias("_s"), *[drawn_label(key, score, f"{seed}-{i}", votes).cast("bigint").alias(n) for i, n in enumerate(names)])
    counts = drawn.groupBy("_s").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names])
    placed = running_totals(counts.withColumns({f"neg_{n}": F.col("n") - F.col(n) for n in names}), [], "_s", [f"neg_{n}" for n in names])
    row = placed.agg(
        *[
            (F.sum(F.col(n) * (F.col(f"below_neg_{n}") + F.col(f"neg_{n}") / 2)) / (F.sum(n).cast("double") * F.sum(f"neg_{n}"))).alias(n)
            for n in names
        ]
    )
    return row.unpivot([], names, "draw", "auc").withColumn("draw", F.substring("draw", 2, 9).cast("int"))


def metric_rows(table: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide metrics to (keys, metric, value)."""
    cast = table.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return cast.unpivot(keys, metrics, "metric", "value")


def fold_spread(fold_scores: DataFrame, by: list[str], value: str = "auc") -> DataFrame:
    """mean, population deviation, min, max and range over folds."""
    return fold_scores.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"),
        (F.max(value) - F.min(value)).alias("spread"),
    )
