"""Deterministic folds, splits and samples from a hash of the row key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.hashing import hash_hex, hash_number
from tabloom.operators.ranks import totals_over_buckets
from tabloom.session import shuffle_partitions


def hash_order_position(
    frame: DataFrame, key: str, seed: int | str, within: list[str] = (), out: str = "position", digits: int | None = None
) -> DataFrame:
    """0-based position of each row in the hash order inside ``within``, exact at any size.

    Ordering by the hex digest is ordering by its prefix first, so the prefix is
    the bucket: each task orders evenly filled buckets and the counts of the buckets
    before them are added. The prefix gives at least eight buckets per shuffle
    partition. Also adds ``<out>_of``, the number of rows in the group.
    """
    within = list(within)
    digits = digits or max(2, math.ceil(math.log(8 * shuffle_partitions(frame.sparkSession), 16)))
    placed = (
        frame.withColumn("_hash", hash_hex(key, seed))
        .withColumn("_bucket", F.substring("_hash", 1, digits))
        .withColumn("_one", F.lit(1))
    )
    counted = totals_over_buckets(placed, within, [F.col("_hash"), F.col(key)], ["_one"])
    return counted.withColumnsRenamed({"below__one": out, "all__one": f"{out}_of"}).drop("_hash", "_one")


def stratified_folds(frame: DataFrame, key: str, label: str, k: int, seed: int | str, out: str = "fold") -> DataFrame:
    """Label-balanced shuffled folds: fold sizes per label differ by at most one row."""
    return (
        hash_order_position(frame, key, seed, [label], "_position")
        .withColumn(out, (F.col("_position") % k).cast("int"))
        .drop("_position", "_position_of")
    )


def hash_folds(frame: DataFrame, key: str, k: int, seed: int | str, out: str = "fold") -> DataFrame:
    """Label-blind folds: a row's fold depends on nothing but its key. No shuffle."""
    return frame.withColumn(out, (hash_number(key, seed) % k).cast("int"))


def stratified_split(
    frame: DataFrame, key: str, label: str, shares: dict[str, float], seed: int | str, out: str = "split"
) -> DataFrame:
    """Exact label-stratified split; each share's size is the floor of its cumulated share."""
    placed = hash_order_position(frame, key, seed, [label], "_position")
    chain, reached, names = None, 0.0, list(shares)
    for name in names[:-1]:
        reached = round(reached + shares[name], 12)
        inside = F.col("_position") < F.floor(F.col("_position_of") * F.lit(reached))
        chain = F.when(inside, name) if chain is None else chain.when(inside, name)
    return placed.withColumn(out, chain.otherwise(names[-1])).drop("_position", "_position_of")


def threshold_split(frame: DataFrame, key: str, shares: dict[str, float], seed: int | str, out: str = "split") -> DataFrame:
    """Shuffle-free split by hash threshold; sizes match the shares only on average."""
    chain, reached, names = None, 0.0, list(shares)
    for name in names[:-1]:
        reached = round(reached + shares[name], 12)
        inside = hash_number(key, seed) < F.lit(int(reached * 2**32))
        chain = F.when(inside, name) if chain is None else chain.when(inside, name)
    return frame.withColumn(out, chain.otherwise(names[-1]))


def sample_rows(frame: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """``n`` pseudo-random rows: the first ``n`` in hash order (a distributed top-k)."""
    return frame.orderBy(hash_hex(key, seed), key).limit(n)


def sample_per_group(frame: DataFrame, key: str, group: list[str], n: int, seed: int | str) -> DataFrame:
    """At most ``n`` pseudo-random rows of every group."""
    return (
        hash_order_position(frame, key, seed, group, "_position")
        .where(F.col("_position") < n)
        .drop("_position", "_position_of")
    )


def carve_validation(frame: DataFrame, key: str, share: float, seed: int | str, out: str = "is_validation") -> DataFrame:
    """Flag a random slice of the fit rows for early stopping."""
    return frame.withColumn(out, hash_number(key, seed) < F.lit(int(share * 2**32)))
