"""Sinks: tables, split ids, predictions, roster, scored export, model bundles, run metrics."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabloom.sources.contract import load_contract


def save_table(frame: DataFrame, path: str, partition_by: list[str] = ()) -> DataFrame:
    """Write Parquet and read it back, which also cuts the lineage."""
    writer = frame.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def save_csv(frame: DataFrame, path: str) -> None:
    """CSV at the export edge: one file per task, each with a header."""
    frame.write.mode("overwrite").csv(path, header=True)


def save_split_ids(frame: DataFrame, key: str, path: str, split: str = "split") -> None:
    """Only (key, split), so that a split can be replayed on any later copy of the table."""
    frame.select(key, split).write.mode("overwrite").partitionBy(split).parquet(path)


def replay_split(frame: DataFrame, key: str, path: str) -> DataFrame:
    return frame.join(frame.sparkSession.read.parquet(path), key)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Write (id, member, split, fold, p) rows; a run again replaces its members' folds and leaves the others."""
    predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("member", "fold").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Committed member rows only: unfinished task output lives in folders Spark does not list.

    Member names are text whatever they look like; other columns keep the stored types.
    """
    found = spark.read.option("basePath", path).parquet(path)
    kinds = ", ".join(f"`{f.name}` {'string' if f.name == 'member' else f.dataType.simpleString()}" for f in found.schema.fields)
    return spark.read.schema(kinds).parquet(path)


def fold_count_mismatch(predictions: DataFrame) -> DataFrame:
    """Members whose fold count differs from the largest one."""
    folds = predictions.groupBy("member").agg(F.count_distinct("fold").alias("folds"))
    return folds.where(F.col("folds") != folds.agg(F.max("folds")).scalar())


def wide_predictions(predictions: DataFrame, members: list[str], keep: list[str] = ("id",)) -> DataFrame:
    """One column per member. The member list is given, so no extra job looks for it."""
    return predictions.groupBy(*keep).pivot("member", members).agg(F.first("p"))


def append_roster(rows: DataFrame, path: str, run: str) -> None:
    """Add a run's rows to the roster; the same run written again replaces its own rows."""
    rows.write.mode("overwrite").parquet(f"{path}/run={run}")


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("run")


def check_against_template(scored: DataFrame, template: DataFrame, key: str = "id") -> DataFrame:
    """One row: rows on either side, ids missing from the scores and ids not asked for."""
    ours, wanted = scored.select(key), template.select(key)
    return scored.sparkSession.range(1).select(
        ours.agg(F.count("*")).scalar().alias("rows_scored"),
        wanted.agg(F.count("*")).scalar().alias("rows_wanted"),
        wanted.join(ours, key, "left_anti").agg(F.count("*")).scalar().alias("not_scored"),
        ours.join(wanted, key, "left_anti").agg(F.count("*")).scalar().alias("not_wanted"),
    )


def write_scored(scored: DataFrame, template: DataFrame, path: str, key: str = "id") -> None:
    """Export in the template's column order; any difference in rows is an error."""
    found = check_against_template(scored, template, key).first()
    if found.rows_scored != found.rows_wanted or found.not_scored or found.not_wanted:
        raise ValueError(f"scores do not match the template: {found.asDict()}")
    missing = [c for c in template.columns if c not in scored.columns]
    if missing:
        raise ValueError(f"scores lack template columns {missing}")
    save_csv(scored.select(*template.columns), path)


def save_bundle(model: PipelineModel, contract: DataFrame, metrics: DataFrame, path: str) -> None:
    """Model, feature contract and metrics side by side."""
    model.write().overwrite().save(f"{path}/model")
    contract.write.mode("overwrite").json(f"{path}/contract")
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame, DataFrame]:
    return (
        PipelineModel.load(f"{path}/model"),
        load_contract(spark, f"{path}/contract"),
        spark.read.parquet(f"{path}/metrics"),
    )


class StepMetrics:
    """Row counts per step, taken while the step's own job runs."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.steps: list[tuple[str, Observation]] = []

    def observe(self, frame: DataFrame, step: str, **facts) -> DataFrame:
        observation = Observation(step)
        self.steps.append((step, observation))
        extra = [expr.alias(name) for name, expr in facts.items()]
        return frame.observe(observation, F.count(F.lit(1)).alias("rows"), *extra)

    def table(self) -> DataFrame:
        """(step, fact, value) of the steps whose jobs have finished."""
        rows = [(step, fact, float(value)) for step, o in self.steps for fact, value in sorted(o.get.items())]
        return self.spark.createDataFrame(rows, "step string, fact string, value double")


def fingerprint(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(rows, digest): 8 hex digits that do not depend on row order or partitioning."""
    names = columns or frame.columns
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in names])
    number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("decimal(38,0)")
    summed = frame.agg(F.count("*").alias("rows"), F.sum(number).alias("_s"))
    return summed.select(
        "rows", F.lpad(F.lower(F.hex((F.col("_s") % F.lit(2**32)).cast("bigint"))), 8, "0").alias("digest")
    )
