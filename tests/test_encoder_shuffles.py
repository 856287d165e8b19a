"""Encoders on tables too large to broadcast."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators.encoders import FIT_ROWS, FoldTargetEncoder


def shuffles(frame, word="Exchange hashpartitioning"):
    return frame._jdf.queryExecution().executedPlan().toString().count(word)


def test_encodings_of_the_same_column_move_the_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(500).select("id", (F.col("id") % 50).alias("k"), (F.col("id") % 3 == 0).cast("int").alias("label"))
        out = rows.withColumn(FIT_ROWS, F.lit(True))
        for auto in (False, True):
            out = FoldTargetEncoder(keySets=(("k",),), auto=auto, seed=1).fit(rows).transform(out)
        assert shuffles(out) == 3  # the rows, and the table of each encoding
        assert out.count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
