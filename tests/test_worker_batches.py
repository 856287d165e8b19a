"""What a Python worker is handed at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F


def test_chunks_reach_workers_a_few_at_a_time(spark):
    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch({"n": [max(sum(len(v.as_py()) for v in b.column("x")) for b in batches)]})

    rows = spark.range(0, 40, numPartitions=1).select(F.expr("cast(repeat('x', 1000000) as binary)").alias("x"))
    assert rows.mapInArrow(most, "n long").first().n <= 10_000_000
