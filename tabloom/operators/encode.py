"""Vocabularies, category codes, counts and frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalars import text_key
from tabloom.operators.folds import hash_order_position
from tabloom.operators.lookup import fitted, join_fitted
from tabloom.operators.ranks import dense_positions


def vocabulary(train: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, level, code): sorted distinct values of each column, code = place in the order; a column may have any number of levels."""
    text = train.select(*[F.col(c).cast("string").alias(c) for c in columns])
    levels = text.unpivot([], columns, "feature", "level").where(F.col("level").isNotNull()).distinct()
    return dense_positions(levels, ["feature"], ["level"], "code").withColumn("code", F.col("code").cast("int"))


def pinned_codes(frame: DataFrame, train: DataFrame, columns: list[str], suffix: str = "_code") -> DataFrame:
    """Alphabetical level codes fitted on train; a value train never showed is an error. Levels stay on the executors."""
    coded = apply_vocabulary(frame, vocabulary(train, columns), columns, suffix)
    unseen = {c: F.raise_error(F.concat(F.lit(f"unseen label in {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))) for c in columns}
    return coded.withColumns({f"{c}{suffix}": F.coalesce(f"{c}{suffix}", unseen[c].cast("int")) for c in columns})


def apply_vocabulary(frame: DataFrame, levels: DataFrame, columns: list[str], suffix: str = "_code") -> DataFrame:
    """Codes from a stored vocabulary; values outside it become null."""
    stored = fitted(levels)
    for c in columns:
        own = stored.where(F.col("feature") == c).select(F.col("level").alias(f"_l_{c}"), F.col("code").alias(f"{c}{suffix}"))
        frame = frame.join(own, F.col(c).cast("string") == F.col(f"_l_{c}"), "left").drop(f"_l_{c}")
    return frame


def one_hot(columns_levels: dict[str, list[str]]) -> dict[str, Column]:
    """``<col>_<level>`` indicators for fixed level lists; an absent level gives a column of zeros."""
    return {
        f"{c}_{level}": F.coalesce(F.col(c).cast("string") == level, F.lit(False)).cast("int")
        for c, levels in columns_levels.items()
        for level in levels
    }


def twin(column: str) -> Column:
    """A whole number as a category: null becomes "0"."""
    return F.coalesce(F.col(column), F.lit(0)).cast("int").cast("string")


def twin_names(columns: list[str]) -> dict[str, Column]:
    return {f"{c}_cat_": twin(c) for c in columns}


def twin_vocabulary(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    """Levels of the twins over all splits together."""
    twins = [f.select(*[v.alias(n) for n, v in twin_names(columns).items()]) for f in frames]
    merged = twins[0]
    for other in twins[1:]:
        merged = merged.unionByName(other)
    return vocabulary(merged, list(twin_names(columns)))


def factorise(frame: DataFrame, columns: list[str], out: str = "code") -> DataFrame:
    """Dense id of each distinct combination; null is a value of its own.

    Ids follow the hash order of the combination, which is stable and is counted
    without a global window.
    """
    keyed = frame.withColumn("_key", text_key(columns))
    ids = hash_order_position(keyed.select("_key").distinct(), "_key", "factorise", out=out).drop(f"{out}_of")
    return join_fitted(keyed, ids, ["_key"]).drop("_key")


def composite_key(columns: list[str], sep: str = "|") -> Column:
    """Several columns as one text key; null forms its own key and no two combinations share one."""
    return text_key(columns, sep)


def pair_keys(pairs: list[tuple[str, str]]) -> dict[str, Column]:
    return {f"pair_{a}_{b}": composite_key([a, b], "_") for a, b in pairs}


def count_table(train: DataFrame, column: str) -> DataFrame:
    """(column, n) of the non-null train values."""
    return train.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def add_value_counts(frame: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """``cnt_<c>``: train count of the row's value, 0 when unseen or null."""
    for c in columns:
        counts = fitted(count_table(train, c).withColumnRenamed("n", f"cnt_{c}"))
        frame = frame.join(counts, c, "left").withColumn(f"cnt_{c}", F.coalesce(f"cnt_{c}", F.lit(0)))
    return frame


def add_frequencies(frame: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """``freq_<c>`` = n/N_train and ``rarity_<c>`` = -ln(max(freq, 1/N_train)); unseen and null give 0 and ln N."""
    total = train.agg(F.count("*")).scalar()
    counted = add_value_counts(frame, train, columns).withColumn("_n", total.cast("double"))
    added = {}
    for c in columns:
        freq = F.col(f"cnt_{c}") / F.col("_n")
        added[f"freq_{c}"] = freq
        added[f"rarity_{c}"] = -F.ln(F.greatest(freq, F.lit(1.0) / F.col("_n")))
    return counted.withColumns(added).drop("_n", *[f"cnt_{c}" for c in columns])


def category_share(frame: DataFrame, column: str, out: str = "share") -> DataFrame:
    """Share of the row's value among the non-null values of the same frame."""
    counts = count_table(frame, column)
    total = counts.agg(F.sum("n")).scalar()
    return frame.join(fitted(counts.select(column, (F.col("n") / total).alias(out))), column, "left")


def pooled_counts(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    """(feature, value, n) over all frames together, one aggregation."""
    merged = None
    for f in frames:
        text = f.select(*[F.col(c).cast("string").alias(c) for c in columns])
        merged = text if merged is None else merged.unionByName(text)
    return merged.unpivot([], columns, "feature", "value").where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count("*").alias("n"))

