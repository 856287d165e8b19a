"""The feature contract: which columns a model reads, in which order and encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTRACT_SCHEMA = "feature string, position int, kind string, levels array<string>, reason string"


def build_contract(
    train: DataFrame, features: list[str], categorical: list[str], dropped: dict[str, str] | None = None, max_levels: int | None = None
) -> DataFrame:
    """One row per feature; ``levels`` are the sorted train values of short categoricals.

    Dropped columns stay in the table with position -1 and the reason. With ``max_levels`` a
    categorical with more values is an error; without, every vocabulary is kept whole.
    """
    spark = train.sparkSession
    plain = spark.createDataFrame(
        [(f, i, "category" if f in categorical else "number", None) for i, f in enumerate(features)]
        + [(f, -1, "dropped", why) for f, why in (dropped or {}).items()],
        "feature string, position int, kind string, reason string",
    )
    listed = [c for c in categorical if c in features]
    if not listed:
        return plain.select("feature", "position", "kind", F.lit(None).cast("array<string>").alias("levels"), "reason")
    values = (
        train.select(*[F.col(c).cast("string").alias(c) for c in listed])
        .unpivot([], listed, "feature", "level")
        .where(F.col("level").isNotNull())
        .distinct()
    )
    if max_levels is not None:
        long = values.groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") > max_levels).collect()  # one row per feature
        if long:
            raise ValueError("too many levels: " + ", ".join(f"{row.feature} ({row.n})" for row in long))
    levels = values.groupBy("feature").agg(F.array_sort(F.collect_set("level")).alias("levels"))
    return plain.join(levels, "feature", "left").select("feature", "position", "kind", "levels", "reason")


def save_contract(contract: DataFrame, path: str) -> None:
    contract.write.mode("overwrite").json(path)


def load_contract(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONTRACT_SCHEMA).json(path)


def column_table(frame: DataFrame) -> DataFrame:
    """(feature, position) of a dataset's columns."""
    return frame.sparkSession.createDataFrame(list(zip(frame.columns, range(len(frame.columns)))), "feature string, position int")


def select_features(features: list[str], keep_prefixes: list[str] = (), drop_prefixes: list[str] = (), drop_suffixes: list[str] = ()) -> list[str]:
    """Feature view, never empty: names kept by prefix or, if no prefix is kept, without the dropped ones; dropped suffixes go in either case."""
    if keep_prefixes:
        kept = [f for f in features if f.startswith(tuple(keep_prefixes))]
    else:
        kept = [f for f in features if not f.startswith(tuple(drop_prefixes) or ("\0",))]
    kept = [f for f in kept if not f.endswith(tuple(drop_suffixes) or ("\0",))]
    if not kept:
        raise ValueError("the view selects no feature")
    return kept


def view_rows(contract: DataFrame, keep_prefixes: list[str] = (), drop_prefixes: list[str] = (), drop_suffixes: list[str] = ()) -> DataFrame:
    """The same rules on the contract table."""

    def any_of(tests):
        result = F.lit(False)
        for t in tests:
            result = result | t
        return result

    name = F.col("feature")
    kept = any_of([name.startswith(p) for p in keep_prefixes]) if keep_prefixes else F.lit(True)
    prefixes = [] if keep_prefixes else drop_prefixes
    dropped = any_of([name.startswith(p) for p in prefixes] + [name.endswith(s) for s in drop_suffixes])
    return contract.where((F.col("position") >= 0) & kept & ~dropped)
