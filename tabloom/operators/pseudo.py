"""Pseudo-labels: confident scored rows used as training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalars import clip


def select_confident(scored: DataFrame, p: str, high: float, low: float, label: str = "label") -> DataFrame:
    """Rows above ``high`` or below ``low`` with the label the score implies."""
    return scored.where((F.col(p) > high) | (F.col(p) < low)).withColumn(label, (F.col(p) > 0.5).cast("int"))


def confident_counts(scored: DataFrame, p: str, cuts: list[tuple[float, float]]) -> DataFrame:
    """(high, low, n_positive, n_negative, share) for several cut pairs, one pass."""
    entries = F.array(*[F.struct(F.lit(h).alias("high"), F.lit(lo).alias("low")) for h, lo in cuts])
    return (
        scored.select(p, F.inline(entries)).groupBy("high", "low")
        .agg(F.count_if(F.col(p) > F.col("high")).alias("n_positive"), F.count_if(F.col(p) < F.col("low")).alias("n_negative"), F.count("*").alias("_n"))
        .withColumn("share", (F.col("n_positive") + F.col("n_negative")) / F.col("_n")).drop("_n")
    )


def augment(train: DataFrame, confident: DataFrame, flag: str = "is_pseudo") -> DataFrame:
    """Train rows and pseudo-labelled rows together, the latter flagged."""
    return train.withColumn(flag, F.lit(False)).unionByName(confident.select(*train.columns).withColumn(flag, F.lit(True)))


def soft_targets(scored: DataFrame, p: str, temperature: float, label: str = "label", weight: str = "weight") -> DataFrame:
    """Each row twice, as positive and negative, weighted by its sharpened probability."""
    q = F.col(p)
    scale = 1 - q + 1e-6
    hot = F.pow(clip((q / scale), 1e-6, 1.0), F.lit(1.0 / temperature))
    cold = F.pow(clip(((1 - q) / scale), 1e-6, 1.0), F.lit(1.0 / temperature))
    target = hot / (hot + cold)
    pair = F.array(
        F.struct(F.lit(1).alias(label), F.col("_t").alias(weight)), F.struct(F.lit(0).alias(label), (1 - F.col("_t")).alias(weight))
    )
    kept = [c for c in scored.columns if c not in (label, weight)]
    return scored.withColumn("_t", target).select(*kept, F.inline(pair))
