"""Neighbour votes by block joins on the executors.

Queries and references are dealt into blocks of about ``block_rows`` rows; every pair of a query block and a reference block
is one group, compared by matrix products of ``TILE_ROWS`` queries at a time, and the partial results are merged per query. No block,
on either side, ever passes through the driver; a task holds two blocks and one tile (10 MB) whatever the tables' sizes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.functions.hashing import hash_number

BLOCK_ROWS = 20_000
TILE_ROWS = 64


def scale_vectors(frame: DataFrame, reference: DataFrame, vector: str) -> DataFrame:
    """Each dimension standardised with the reference mean and population deviation."""
    moments = (
        reference.select(F.posexplode(vector).alias("i", "x")).groupBy("i")
        .agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s"))
        .agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("f"))  # one entry per dimension
        .scalar()
    )
    scaled = F.zip_with(vector, F.col("_f"), lambda x, f: (x.cast("double") - f["m"]) / f["s"])
    return frame.withColumn("_f", moments).withColumn(vector, scaled).drop("_f")


def _block_pairs(queries: DataFrame, reference: DataFrame, key: str, vector: str, label: str, block_rows: int, schema: str, work: Callable) -> DataFrame:
    """``work(query ids, squared distances, reference ids, labels)`` for the tiles of every pair of blocks; references ascend by id."""
    nq, nr = (max(1, -(-frame.count() // block_rows)) for frame in (queries, reference))

    def dealt(frame: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return frame.withColumn(own, (hash_number("k", "block") % n).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left = dealt(queries.select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v")), "qb", nq, "rb", nr)
    right = reference.select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("double").alias("y"))
    right = dealt(right, "rb", nr, "qb", nq)

    def matrix(table: pa.Table) -> np.ndarray:
        flat = np.asarray(table.column("v").combine_chunks().flatten())
        return flat.reshape(table.num_rows, -1)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return work(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(1, np.int64), np.zeros(1))
        order = np.argsort(np.asarray(b.column("k")), kind="stable")
        x, z = matrix(a), matrix(b)[order]
        keys, ids, labels, norm = np.asarray(a.column("k")), np.asarray(b.column("k"))[order], np.asarray(b.column("y"))[order], (z * z).sum(axis=1)
        parts = []
        for at in range(0, len(x), TILE_ROWS):
            tile = x[at : at + TILE_ROWS]
            d2 = tile @ z.T
            d2 *= -2.0
            d2 += (tile * tile).sum(axis=1)[:, None]
            d2 += norm
            np.maximum(d2, 0.0, out=d2)
            parts.append(work(keys[at : at + TILE_ROWS], d2, ids, labels))
        return pa.concat_tables(parts)

    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(run, schema)


def knn_vote(queries: DataFrame, reference: DataFrame, key: str, vector: str, label: str, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, p): distance-weighted share of positives among the k nearest references.

    References at distance 0, if any, decide alone; ties in distance go to the smaller reference key.
    """

    def nearest(q: np.ndarray, d2: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> pa.Table:
        n = min(k, d2.shape[1])
        if not len(q):
            return pa.table({"q": q, "d2": np.zeros(0), "r": ids[:0], "y": labels[:0]})
        # what is not beyond the n-th distance, in order of distance and id; ties may be more than n
        row, col = np.nonzero(d2 <= np.partition(d2, n - 1, axis=1)[:, n - 1 : n])
        near = d2[row, col]
        order = np.lexsort((col, near, row))
        row, col, near = row[order], col[order], near[order]
        first = np.searchsorted(row, np.arange(len(q)))
        keep = np.arange(len(row)) - first[row] < n
        return pa.table({"q": q[row[keep]], "d2": near[keep], "r": ids[col[keep]], "y": labels[col[keep]]})

    parts = _block_pairs(queries, reference, key, vector, label, block_rows, "q bigint, d2 double, r bigint, y double", nearest)
    best = parts.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy("d2", "r"))).where(F.col("n") <= k)
    touch = F.col("d2") <= 1e-12
    total = best.groupBy("q").agg(
        F.count_if(touch).alias("exact"), F.sum(F.when(touch, F.col("y"))).alias("exact_y"),
        F.sum(F.when(~touch, 1 / F.sqrt("d2"))).alias("w"), F.sum(F.when(~touch, F.col("y") / F.sqrt("d2"))).alias("wy"),
    )
    return total.select(F.col("q").alias(key), F.when(F.col("exact") > 0, F.col("exact_y") / F.col("exact")).otherwise(F.col("wy") / F.col("w")).alias("p"))


def soft_vote(queries: DataFrame, reference: DataFrame, key: str, vector: str, label: str, tau: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, p): softmax(-d2 / tau) weighted share of positives over all references."""

    def partial(q: np.ndarray, d2: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> pa.Table:
        low = d2.min(axis=1)
        w = d2 - low[:, None]
        w /= -tau
        np.exp(w, out=w)
        return pa.table({"q": q, "low": low, "w": w.sum(axis=1), "wy": w @ labels})

    parts = _block_pairs(queries, reference, key, vector, label, block_rows, "q bigint, low double, w double, wy double", partial)
    least = parts.groupBy("q").agg(F.min("low").alias("least"), F.collect_list(F.struct("low", "w", "wy")).alias("parts"))  # one per block

    def summed(field: str) -> Column:
        return F.aggregate("parts", F.lit(0.0), lambda a, x: a + x[field] * F.exp(-(x["low"] - F.col("least")) / tau))

    return least.select(F.col("q").alias(key), (summed("wy") / summed("w")).alias("p"))
