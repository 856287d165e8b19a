"""Seeded, engine-independent pseudo-randomness from md5 of a row key.

A retried task, another partitioning or another cluster size gives the same
value for the same key, which ``rand(seed)`` does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_hex(key: str | Column, seed: int | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_number(key: str | Column, seed: int | str) -> Column:
    """The first 32 bits of the digest as a non-negative integer."""
    return F.conv(F.substring(hash_hex(key, seed), 1, 8), 16, 10).cast("bigint")


def hash_unit(key: str | Column, seed: int | str) -> Column:
    """A number in [0, 1)."""
    return hash_number(key, seed) / F.lit(float(2**32))
