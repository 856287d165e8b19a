"""Rows that many fits read are spread over the cores; a preparation is fitted once for members that share it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import members as M
from tabloom.operators.lookup import SPREAD_ROWS, dealt, fitted


def rows(spark, n):
    return spark.range(n, numPartitions=1).select("id", (F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, "x").otherwise("y").alias("c"), (F.col("id") % 7 > F.col("id") % 5).cast("int").alias("label"))


def per_task(frame):
    return [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]


def test_one_file_is_dealt_out(spark):
    frame = rows(spark, 8 * SPREAD_ROWS)
    assert len(per_task(fitted(frame))) == 1
    found = dealt(frame)
    assert max(per_task(found)) * 4 <= 8 * SPREAD_ROWS
    assert found.exceptAll(frame).isEmpty() and found.count() == frame.count()


def test_few_or_no_rows_stay(spark):
    assert len(per_task(dealt(rows(spark, 100)))) == 1
    assert dealt(rows(spark, 0)).count() == 0


def test_given_preparation_gives_the_same_member(spark):
    frame = fitted(rows(spark, 700))
    spec = M.MemberSpec("p", "perceptron", ("a",), ("c",), {"hidden": [3], "maxIter": 5}, 1)
    one, two = (M.score(m, frame, spec, ["id"]).orderBy("id").collect() for m in (M.fit_member(frame, spec), M.fit_member(frame, spec, M.prepared(frame, spec))))
    assert one == two


def test_folds_keep_their_order(spark):
    frame = fitted(rows(spark, 500).withColumn("fold", (F.col("id") % 3).cast("int")))
    found = M.cross_validate(frame, M.MemberSpec("l", "logistic", ("a",), ("c",), {"maxIter": 3}, 1), "fold", 3)
    assert found.where("fold <> id % 3").isEmpty() and found.count() == 500
