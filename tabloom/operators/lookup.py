"""Joining rows to fitted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import scratch_path


def fitted(table: DataFrame, name: str = "fitted") -> DataFrame:
    """Run the fit and keep its result as a table in the shared folder.

    Read back, the table has a known size, so Spark itself broadcasts it when it is
    below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise joins by shuffle.
    Lost executors cost nothing: the rows are on shared storage.
    """
    path = scratch_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def fitted_parts(table: DataFrame, by: str, names: list[str], name: str = "fitted") -> dict[str, DataFrame]:
    """As :func:`fitted`, each of ``names`` (values of the text column ``by``) a table of its own without that column.

    Spark knows the size of every part by itself, so that small ones are broadcast whatever the others hold.
    """
    path = scratch_path(table.sparkSession, name)
    rest = table.drop(by)
    table.select(*rest.columns, (F.array_position(F.lit(names), F.col(by)) - 1).alias("_part")).write.partitionBy("_part").parquet(path)
    reader = table.sparkSession.read
    found = {row["_part"] for row in reader.schema(f"{rest._jdf.schema().toDDL()}, _part bigint").parquet(path).select("_part").distinct().collect()}  # one row per name
    return {n: reader.schema(rest.schema).parquet(f"{path}/_part={i}") if i in found else rest.limit(0) for i, n in enumerate(names)}


SPREAD_ROWS = 16_384


def dealt(table: DataFrame, name: str = "fitted") -> DataFrame:
    """As :func:`fitted`, for rows that many fits read: where one task would read more than twice its share, they are dealt out evenly.

    A table that comes from one file of one row group stays in one file otherwise, and every pass over it is one task's.
    Fewer than ``SPREAD_ROWS`` rows stay as they are.
    """
    kept = fitted(table, name)
    read = [row["count"] for row in kept.groupBy(F.spark_partition_id()).count().collect()]  # one row per task
    rows, cores = sum(read), kept.sparkSession.sparkContext.defaultParallelism
    pieces = min(2 * cores, -(-rows // SPREAD_ROWS))
    if pieces < 2 or max(read) * min(cores, pieces) <= 2 * rows:
        return kept
    return fitted(kept.repartition(pieces), name)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join in which null equals null, keeping the left key columns."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def join_fitted(left: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Left join of a fitted table, null keys matching null keys."""
    return join_null_safe(left, fitted(table), keys, how)
