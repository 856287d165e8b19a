"""Connected components of a set of links, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import fitted


def components(links: DataFrame) -> DataFrame:
    """Columns ``id`` and ``component`` (the smallest id reachable), for every id of ``links`` (``a``, ``b``).

    Alternates two rewritings until nothing changes: every node's larger neighbours are linked to its smallest neighbour,
    then its smaller neighbours are. Each keeps the components and flattens them towards stars; both are a grouping and a
    join, so no component is ever gathered. Rounds grow with the logarithm of the longest chain. Empty links give no rows.
    """
    edges = fitted(_clean(links), "links")
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = fitted(_clean(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "links")
        # every edge of `large` now runs from a larger id to a smaller one
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a")
        edges = fitted(
            _clean(moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))), "links"
        )
        after = _state(edges)
        if before == after:
            break
        before = after
    stars = edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component")).distinct()


def _clean(edges: DataFrame) -> DataFrame:
    """Undirected links once each, smaller id first."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
