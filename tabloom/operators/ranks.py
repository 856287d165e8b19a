"""Exact global order statistics without a one-task window.

Everything that depends on a global order (mid-ranks, AUC, quantiles, rank
correlation, Mann-Whitney) is computed from the same two-level scheme:

1. rows are first reduced to one row per distinct value (partial aggregation
   happens before the shuffle, so a value held by a third of all rows is cheap);
2. distinct values are cut into buckets at approximate quantiles of the distinct
   values; the cut points only decide which task does the work, never the result;
3. bucket totals (a few thousand small rows) are accumulated, and a window inside
   each bucket adds the running total of the values below. The join that brings the
   totals back and the window share one partitioning by (group, bucket).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.operators.lookup import fitted, fitted_parts
from tabloom.session import shuffle_partitions


def range_buckets(frame: DataFrame, value: str, cuts_from: DataFrame, buckets: int | None = None) -> DataFrame:
    """Add ``_bucket``: the range of ``value`` among approximate quantiles of ``cuts_from``.

    The cut points are a one-row subquery. They are searched by halving, one
    projection per step, which stays in generated code for thousands of buckets.
    """
    steps = max(2, math.ceil(math.log2(buckets or shuffle_partitions(frame.sparkSession))))
    n = 2**steps
    fractions = F.lit([i / n for i in range(1, n)])
    cuts = cuts_from.agg(F.percentile_approx(value, fractions, F.lit(max(1000, 4 * n)))).scalar()
    placed = frame.withColumns({"_cuts": cuts, "_bucket": F.lit(0)})
    for k in reversed(range(steps)):
        half = 2**k
        placed = placed.withColumn("_bucket", F.expr(f"_bucket + if(get(_cuts, _bucket + {half - 1}) <= {value}, {half}, 0)"))
    return placed.drop("_cuts")


def running_totals(
    counts: DataFrame, by: list[str], value: str, measures: list[str], buckets: int | None = None
) -> DataFrame:
    """Add ``below_<m>`` (sum over smaller values) and ``all_<m>`` (sum over the group).

    ``counts`` holds one row per (by, value) with a non-null numeric value. It is
    stored first because it is read three times (cut points, bucket totals, running
    sums) and would otherwise be derived from the rows each time.
    """
    counts = fitted(counts, "values")
    # Cut at quantiles of the distinct values of all groups together: every bucket then
    # holds its share of all rows, so no (group, bucket) cell can hold more than that.
    placed = range_buckets(counts, value, counts, buckets)
    return totals_over_buckets(placed, by, [F.col(value)], measures)


def totals_over_buckets(
    placed: DataFrame, by: list[str], order: list[Column], measures: list[str]
) -> DataFrame:
    """Running totals over ``(_bucket, order)`` within ``by``; drops ``_bucket``."""
    per_bucket = placed.groupBy(*by, "_bucket").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    ordered = W.partitionBy(*by).orderBy("_bucket") if by else W.orderBy("_bucket")
    earlier = ordered.rowsBetween(W.unboundedPreceding, -1)
    everything = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = per_bucket.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{m}").over(earlier), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_t_{m}").over(everything).alias(f"all_{m}") for m in measures],
    )
    inside = W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    kept = [c for c in placed.columns if c != "_bucket"]
    return (
        placed.join(offsets, [*by, "_bucket"])
        .withColumns({f"below_{m}": F.coalesce(F.sum(m).over(inside), F.lit(0)) + F.col(f"_o_{m}") for m in measures})
        .select(*kept, *[f"below_{m}" for m in measures], *[f"all_{m}" for m in measures])
    )


def dense_positions(rows: DataFrame, by: list[str], order: list[str], out: str = "position") -> DataFrame:
    """Place of every row in its group by ``order``, counted from 0, for values of any type.

    Rows are range-sorted and stored with their place in the partition; only counts per (group, partition) are accumulated, so a
    group is spread over as many tasks as its rows need.
    """
    ordered = fitted(rows.orderBy(*by, *order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    parts = ordered.groupBy(*by, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    shifts = fitted(parts.select(*by, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")), "parts")
    return ordered.withColumn("_part", part).join(shifts, [*by, "_part"]).withColumn(out, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def distinct_values(rows: DataFrame, by: list[str], value: str, measures: dict[str, Column]) -> DataFrame:
    """One row per (by, value) with summed measures; null values are left out."""
    return (
        rows.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(*[F.sum(expr).alias(name) for name, expr in measures.items()])
    )


def mid_ranks(rows: DataFrame, by: list[str], value: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Table (by, value, n, mid_rank, all_n): average rank of every distinct value."""
    counts = distinct_values(rows, by, value, {"n": F.lit(1), **(extra or {})})
    return running_totals(counts, by, value, ["n"]).withColumn(
        "mid_rank", F.col("below_n") + (F.col("n") + 1) / 2
    )


def rank_transform(rows: DataFrame, by: list[str], value: str, out: str = "rank") -> DataFrame:
    """Rows with ``out`` = average rank / n within ``by`` (ties averaged)."""
    ranks = mid_ranks(rows, by, value).select(*by, value, (F.col("mid_rank") / F.col("all_n")).alias(out))
    return rows.join(fitted(ranks, "ranks"), [*by, value], "left")


def quantiles(rows: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact linearly interpolated quantiles as ``(by, q array<double>)``.

    Only the (at most two) distinct values around each wanted position survive the
    running count, so no task ever holds a whole column.
    """
    counts = distinct_values(rows, by, value, {"n": F.lit(1)})
    placed = running_totals(counts, by, value, ["n"])
    last = F.col("below_n") + F.col("n") - 1
    aggs = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("all_n") - 1)
        low, high = F.floor(position), F.ceil(position)
        v = F.col(value).cast("double")
        aggs += [
            F.max(F.when((F.col("below_n") <= low) & (low <= last), v)).alias(f"_lo{i}"),
            F.max(F.when((F.col("below_n") <= high) & (high <= last), v)).alias(f"_hi{i}"),
            F.max(position - low).alias(f"_w{i}"),
        ]
    grouped = placed.groupBy(*by).agg(*aggs) if by else placed.agg(*aggs)
    return grouped.select(
        *by,
        F.array(
            *[
                F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")
                for i in range(len(probs))
            ]
        ).alias("q"),
    )


def melt(rows: DataFrame, ids: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide numeric columns to (ids, name, value) rows."""
    cast = rows.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return cast.unpivot(ids, columns, name, value)


def column_quantiles(rows: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """``(feature, q)`` for several columns in one job."""
    return quantiles(melt(rows, [], columns), ["feature"], "value", probs)


def auc(rows: DataFrame, score: str, label: str, by: list[str] = (), weight: Column | None = None) -> DataFrame:
    """Exact ROC-AUC with averaged ties as ``(by, n_pos, n_neg, auc)``; null for one-sided groups."""
    by = list(by)
    y = F.col(label).cast("bigint")
    counts = distinct_values(rows.where(F.col(label).isNotNull()), by, score, {"pos": y, "neg": 1 - y})
    placed = running_totals(counts, by, score, ["neg"])
    wins = F.col("pos") * (F.col("below_neg") + F.col("neg") / 2)
    aggs = [F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(wins).alias("_wins")]
    grouped = placed.groupBy(*by).agg(*aggs) if by else placed.agg(*aggs)
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return grouped.select(*by, "n_pos", "n_neg", F.try_divide(F.col("_wins"), pairs).alias("auc"))


TALLY_ROWS = 1 << 20  # rows that a task counts at once
RANGE_VALUES = 1 << 18  # distinct values that a task merges
SKETCH = 64


def _merged(values: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order with summed counts."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) & ~np.isnan(values[:-1])
    at = np.flatnonzero(new)
    return values[at], np.add.reduceat(pos[order], at), np.add.reduceat(neg[order], at)


def _twice_wins(pos: np.ndarray, neg: np.ndarray) -> int:
    """Twice the pairs in which the positive is above, ties counted half, of counts in the order of their values; exact."""
    if int(pos.sum()) * int(neg.sum()) >= 1 << 60:
        pos, neg = pos.astype(object), neg.astype(object)
    return int((pos * (2 * (np.cumsum(neg) - neg) + neg)).sum())


def whole_auc(rows: DataFrame, score: str, label: str) -> float | None:
    """The AUC of :func:`auc` of all rows as one group, for labels 0 and 1 and a number as score.

    Tasks count sorted arrays of distinct scores instead of rows; the arrays are cut into ranges at approximate quantiles, a range is merged by
    one task, and the driver takes three sums per range.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
            both = np.concatenate(parts)
            values, pos, neg = _merged(both[:, 0], (y := both[:, 1].astype(np.int64)), 1 - y)
            sketch = values[((np.arange(SKETCH) + 0.5) * len(values) / SKETCH).astype(np.int64)]
            columns = {"v": values, "pos": pos.astype(np.int32), "neg": neg.astype(np.int32), "sketch": sketch}
            return pa.record_batch({"n": pa.array([len(values)], pa.int64()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in columns.items()}})

        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, 2))
                held += batch.num_rows
            if held >= TALLY_ROWS:
                yield counted(parts)
                parts, held = [], 0
        if parts:
            yield counted(parts)

    seen = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.array(F.col(score).cast("double"), F.col(label).cast("double")).alias("x"))
    tallies = fitted(seen.mapInArrow(count, "n bigint, v binary, pos binary, neg binary, sketch binary"), "tallies")
    sketches = tallies.select("n", "sketch").collect()  # one short line per TALLY_ROWS rows
    if not sketches:
        return None
    points, weights = np.concatenate([np.frombuffer(r.sketch) for r in sketches]), np.repeat([r.n / SKETCH for r in sketches], SKETCH)
    order = np.argsort(points, kind="stable")
    ranges = max(1, -(-int(weights.sum()) // RANGE_VALUES))
    place = np.searchsorted(np.cumsum(weights[order]), np.arange(1, ranges) * weights.sum() / ranges)
    cuts = np.unique(points[order][np.minimum(place, len(points) - 1)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, pos, neg in zip(*(batch.column(c) for c in ("v", "pos", "neg"))):
                values = np.frombuffer(v.as_buffer())
                ends = [0, *np.searchsorted(values, cuts), len(values)]
                for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                    if b > a:
                        arrays = {"v": values[a:b], "pos": np.frombuffer(pos.as_buffer(), np.int32)[a:b], "neg": np.frombuffer(neg.as_buffer(), np.int32)[a:b]}
                        yield pa.record_batch({"part": pa.array([i], pa.int64()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in arrays.items()}})

    def merge(table: pa.Table) -> pa.Table:
        v, pos, neg = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[c]]) for c, kind in (("v", np.float64), ("pos", np.int32), ("neg", np.int32)))
        _, pos, neg = _merged(v, pos.astype(np.int64), neg.astype(np.int64))
        return pa.table({"part": table["part"][:1], "pos": [int(pos.sum())], "neg": [int(neg.sum())], "wins": [str(_twice_wins(pos, neg))]})

    pieces = tallies.select("v", "pos", "neg").mapInArrow(cut, "part bigint, v binary, pos binary, neg binary")
    found = pieces.groupBy("part").applyInArrow(merge, "part bigint, pos bigint, neg bigint, wins string").collect()  # one line per range
    wins = below = positive = 0
    for r in sorted(found, key=lambda r: r.part):
        wins += int(r.wins) + 2 * r.pos * below
        below, positive = below + r.neg, positive + r.pos
    return wins / (2 * positive * below) if positive and below else None


def spearman_with_label(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """``(feature, spearman)`` from aggregated values; no row is joined back.

    The label of a row is ranked among the rows in which the feature is present.
    """
    long = melt(rows, [label], columns)
    counts = distinct_values(long, ["feature"], "value", {"n": F.lit(1), "pos": F.col(label).cast("bigint")})
    placed = running_totals(counts, ["feature"], "value", ["n", "pos"])
    rank = F.col("below_n") + (F.col("n") + 1) / 2
    n_neg = F.col("all_n") - F.col("all_pos")
    rank_neg, rank_pos = (n_neg + 1) / 2, n_neg + (F.col("all_pos") + 1) / 2
    mean = (F.col("all_n") + 1) / 2
    dx = rank - mean
    neg = F.col("n") - F.col("pos")
    return (
        placed.groupBy("feature")
        .agg(
            F.sum(dx * (F.col("pos") * (rank_pos - mean) + neg * (rank_neg - mean))).alias("sxy"),
            F.sum(F.col("n") * dx * dx).alias("sxx"),
            F.sum(F.col("pos") * (rank_pos - mean) * (rank_pos - mean) + neg * (rank_neg - mean) * (rank_neg - mean)).alias("syy"),
        )
        .select("feature", F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy"))).alias("spearman"))
    )


def ranked_columns(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Wide table (key, one mid-rank column per feature); of a repeated key the largest ranks, which are those of its largest values.

    Rows stay wide: only the count of distinct values unpivots them, and every column's ranks are joined as a column.
    """
    ranks = mid_ranks(melt(rows, [], columns), ["feature"], "value").select("feature", "value", "mid_rank")
    wide = rows.groupBy(key).agg(*[F.max(F.col(c).cast("double")).alias(f"_v_{c}") for c in columns])
    for c, table in fitted_parts(ranks, "feature", columns, "ranks").items():
        wide = wide.join(table.select(F.col("value").alias(f"_v_{c}"), F.col("mid_rank").alias(c)), f"_v_{c}", "left")
    return wide.select(key, *columns)
