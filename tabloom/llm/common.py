"""Small helpers of this package: table reads, stored tables, session facts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.lookup import fitted
from tabloom.session import scratch_path, shuffle_partitions

__all__ = ["fitted", "hex_sha", "packed", "power_of_two", "read", "scratch_path", "summed", "shuffle_partitions"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def power_of_two(n: float, least: int, most: int) -> int:
    """Smallest power of two that is at least ``n``, between ``least`` and ``most``."""
    return min(most, max(least, 1 << (max(1, int(n)) - 1).bit_length()))


def hex_sha(text: Column) -> Column:
    return F.sha2(text, 256)


def packed(table: DataFrame, name: str) -> DataFrame:
    """As :func:`fitted`, with denser compression, for tables that hold whole texts."""
    path = scratch_path(table.sparkSession, name)
    table.write.option("compression", "zstd").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def summed(rows: DataFrame, tally: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, pieces: int = 16) -> np.ndarray:
    """Sum over all partitions of ``tally`` (``size`` whole numbers, fixed), in one job.

    A partition's vector travels as ``pieces`` binary rows, equal pieces are added where they meet, and ``pieces`` rows reach the driver.
    """
    cuts = np.linspace(0, size, pieces + 1).astype(int)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.asarray(tally(batches), np.int64)
        parts = [total[lo:hi] for lo, hi in zip(cuts, cuts[1:])]
        filled = [i for i, part in enumerate(parts) if part.any()]
        yield pa.record_batch({"piece": pa.array(filled, pa.int32()), "values": pa.array([parts[i].tobytes() for i in filled], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, values in zip(batch.column("piece").to_pylist(), batch.column("values")):
                part = np.frombuffer(values.as_buffer(), np.int64)
                found[piece] = found[piece] + part if piece in found else part
        for piece, part in found.items():
            yield pa.record_batch({"piece": pa.array([piece], pa.int32()), "values": pa.array([part.tobytes()], pa.binary())})

    schema = "piece int, values binary"
    out = np.zeros(size, np.int64)
    for row in rows.mapInArrow(count, schema).repartition(min(pieces, shuffle_partitions(rows.sparkSession)), "piece").mapInArrow(add, schema).collect():
        out[cuts[row.piece] : cuts[row.piece + 1]] = np.frombuffer(row["values"], np.int64)
    return out
