"""Correlation and two-group tests from aggregated values."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tabloom.operators.ranks import distinct_values, melt, quantiles, ranked_columns, running_totals

Z_975 = 1.959963984540054  # standard normal quantile of 0.975


def correlations(frame: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """(a, b, corr): Pearson of every left with every right column, over the rows where both are present.

    The right columns are unpivoted, so one pass with ``len(left)`` aggregates per
    group serves all pairs and the shuffled state is one row per right column.
    """
    wide = frame.select(
        *[F.col(c).cast("double").alias(f"a_{c}") for c in left], *[F.col(c).cast("double").alias(f"b_{c}") for c in right]
    )
    long = wide.unpivot([f"a_{c}" for c in left], [f"b_{c}" for c in right], "b", "_v")
    table = long.groupBy("b").agg(*[F.corr(f"a_{c}", "_v").alias(c) for c in left])
    return table.unpivot(["b"], left, "a", "corr").select("a", F.substring("b", 3, 1 << 20).alias("b"), "corr")


def correlation_matrix(frame: DataFrame, columns: list[str]) -> DataFrame:
    """The upper triangle: every unordered pair of columns once, in the given order.

    A task adds the moments of all pairs up as matrix products and leaves one line per pair; the lines of the tasks are merged around
    their own means, as :func:`pyspark.sql.functions.corr` does.
    """
    lines = frame.select(*[F.col(c).cast("double").alias(str(i)) for i, c in enumerate(columns)]).mapInArrow(_pair_moments, MOMENTS)
    parts = F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in ("n", "ma", "mb", "saa", "sbb", "sab")])), asc=False)  # a line per task
    empty = F.named_struct(F.lit("n"), F.lit(0.0), *[x for c in ("ma", "mb", "saa", "sbb", "sab") for x in (F.lit(c), F.lit(0.0))])
    s = lines.groupBy("a", "b").agg(F.aggregate(parts, empty, _merged).alias("s"))
    names = F.lit(columns)
    corr = F.when(F.col("s.n") > 1, F.col("s.sab") / F.sqrt(F.col("s.saa") * F.col("s.sbb")))
    return s.select(F.get(names, "a").alias("a"), F.get(names, "b").alias("b"), corr.alias("corr"))


MOMENTS = "a int, b int, n double, ma double, mb double, saa double, sbb double, sab double"


def _merged(x: Column, y: Column) -> Column:
    """Moments of two sets of rows as those of their union; a set without rows changes nothing."""
    n = x.n + y.n
    share = F.when(n > 0, y.n / F.when(n > 0, n).otherwise(1.0)).otherwise(0.0)
    da, db, w = y.ma - x.ma, y.mb - x.mb, x.n * share
    made = {"n": n, "ma": x.ma + da * share, "mb": x.mb + db * share, "saa": x.saa + y.saa + da * da * w, "sbb": x.sbb + y.sbb + db * db * w, "sab": x.sab + y.sab + da * db * w}
    return F.named_struct(*[v for c, col in made.items() for v in (F.lit(c), col)])


def _pair_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair of columns, over the rows where both are present: count, means, sums of squares and products around the means.

    A batch is summed around its own means, and batches are merged around theirs. A value that is not finite makes its pairs NaN.
    """
    total = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        here = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
        odd = here & ~np.isfinite(x)
        m = here.astype(float)
        shift = np.array([v[ok][0] if ok.any() else 0.0 for v, ok in zip(x, here & ~odd)])[:, None]
        x = np.where(here & ~odd, x - shift, 0.0)  # a constant column becomes zeros, and stays exactly constant
        n, s, q, p = m @ m.T, x @ m.T, (x * x) @ m.T, x @ x.T
        some = np.maximum(n, 1)
        found = [n, s / some + shift, q - s * s / some, p - s * s.T / some]
        if odd.any():
            bad = odd.astype(float) @ m.T
            for v in found[1:]:
                v[(bad > 0) | (bad.T > 0)] = np.nan
        if total is None:
            total = found
            continue
        both = np.maximum(total[0] + n, 1)
        d, w = found[1] - total[1], total[0] * n / both
        empty = (total[0] == 0) | (n == 0)
        d = np.where(empty, 0.0, d)
        mean = np.where(total[0] == 0, found[1], total[1] + d * n / both)
        total = [total[0] + n, mean, total[2] + found[2] + d * d * w, total[3] + found[3] + d * d.T * w]
    if total is not None:
        a, b = np.triu_indices(len(total[0]), 1)
        n, mean, square, product = total
        values = [n[a, b], mean[a, b], mean[b, a], square[a, b], square[b, a], product[a, b]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((a, b, *values), (pa.int32(), pa.int32(), *[pa.float64()] * 6))], names=["a", "b", "n", "ma", "mb", "saa", "sbb", "sab"])


def all_pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def rank_correlations(frame: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(a, b, corr): Spearman; a column's ranks are taken over the rows where it is present."""
    return correlation_matrix(ranked_columns(frame, key, columns), columns)


def two_group_means(frame: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Mean and median per feature in both label groups, and the difference of the means."""
    long = melt(frame, [label], columns)
    means = long.groupBy("feature").agg(
        F.avg(F.when(F.col(label) == 0, F.col("value"))).alias("negative_mean"),
        F.avg(F.when(F.col(label) == 1, F.col("value"))).alias("positive_mean"),
    )
    medians = quantiles(long, ["feature", label], "value", [0.5]).groupBy("feature").agg(
        F.max(F.when(F.col(label) == 0, F.get("q", F.lit(0)))).alias("negative_median"),
        F.max(F.when(F.col(label) == 1, F.get("q", F.lit(0)))).alias("positive_median"),
    )
    return means.join(medians, "feature").withColumn("difference", F.col("positive_mean") - F.col("negative_mean"))


def category_rate_spread(frame: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Largest minus smallest label rate over the values of each categorical."""
    text = frame.select(label, *[F.col(c).cast("string").alias(c) for c in columns])
    rates = text.unpivot([label], columns, "feature", "value").groupBy("feature", "value").agg(F.avg(label).alias("rate"))
    return rates.groupBy("feature").agg((F.max("rate") - F.min("rate")).alias("difference"))


def effect_size(delta: Column) -> Column:
    """Verbal size of Cliff's delta; fixed thresholds .147, .33, .474."""
    size = F.abs(delta)
    return F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large")


def rank_sum_tests(frame: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Mann-Whitney U (positives against negatives), tie- and continuity-corrected z,
    Cliff's delta with a normal-approximation interval, and its verbal size."""
    long = melt(frame, [label], columns)
    y = F.col(label).cast("bigint")
    counts = distinct_values(long, ["feature"], "value", {"pos": y, "neg": 1 - y})
    placed = running_totals(counts, ["feature"], "value", ["neg"])
    t = (F.col("pos") + F.col("neg")).cast("double")
    sums = placed.groupBy("feature").agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2)).alias("u"),
        F.sum(t * t * t - t).alias("_ties"),
    )
    n1, n2 = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    n = n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("_ties") / (n * (n - 1))))
    larger = F.greatest(F.col("u"), n1 * n2 - F.col("u"))
    delta = 2 * F.col("u") / (n1 * n2) - 1
    error = F.sqrt((n1 + n2 + 1 - F.col("delta") * F.col("delta") * (n1 + n2)) / (12 * n1 * n2))
    return (
        sums.withColumn("z", (larger - n1 * n2 / 2 - 0.5) / spread)
        .withColumn("delta", delta)
        .withColumns({"delta_low": F.col("delta") - Z_975 * error, "delta_high": F.col("delta") + Z_975 * error})
        .withColumn("effect", effect_size(F.col("delta")))
        .drop("_ties")
    )


def strong_signals(tests: DataFrame) -> DataFrame:
    return tests.where(F.col("effect").isin("medium", "large")).orderBy(F.desc("delta"))


@F.pandas_udf(DoubleType())
def normal_two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal tail; applied to one row per feature."""
    return z.map(lambda v: min(1.0, math.erfc(v / math.sqrt(2.0))))


@F.pandas_udf(DoubleType())
def chi_square_p(chi2: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution for whole degrees of freedom."""

    def tail(x: float, k: int) -> float:
        half = x / 2.0
        if k % 2:
            total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
            start = 1.5
        else:
            total, term, start = math.exp(-half), math.exp(-half) * half, 2.0
        a = start
        for _ in range((k - 1) // 2):
            total += term
            term *= half / a
            a += 1.0
        return total

    return pd.Series([tail(float(x), int(k)) for x, k in zip(chi2, dof)])


def chi_square(frame: DataFrame, columns: list[str], label: str, yates: bool = True) -> DataFrame:
    """Chi-square independence test of each column with a 0/1 label, and Cramer's V.

    The continuity correction applies to 2x2 tables only.
    """
    text = frame.select(F.col(label).cast("bigint").alias("_y"), *[F.col(c).cast("string").alias(c) for c in columns])
    cells = (
        text.unpivot(["_y"], columns, "feature", "value")
        .where(F.col("value").isNotNull() & F.col("_y").isNotNull())
        .groupBy("feature", "value")
        .agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
    )
    margins = cells.groupBy("feature").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"), (F.count("*") - 1).alias("dof"))
    row = F.col("pos") + F.col("neg")
    total = F.col("_p") + F.col("_q")

    def term(seen: Column, margin: Column) -> Column:
        expected = row * margin / total
        gap = F.abs(seen - expected)
        corrected = F.when((F.col("dof") == 1) & F.lit(yates), gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return corrected * corrected / expected

    return (
        cells.join(margins, "feature")
        .groupBy("feature", "dof", total.alias("_n"))
        .agg(F.sum(term(F.col("pos"), F.col("_p")) + term(F.col("neg"), F.col("_q"))).alias("chi2"))
        .select("feature", "chi2", "dof", F.sqrt(F.col("chi2") / F.col("_n")).alias("cramers_v"))
    )


def latent_factor(frame: DataFrame, columns: list[str]) -> tuple[list[float], list[float], list[float], list[float]]:
    """(eigenvalues, first eigenvector, means, deviations) of the correlation matrix.

    Aggregations yield the matrix and the moments; only that small matrix is decomposed on the driver.
    """
    k = len(columns)
    matrix = np.eye(k)
    for row in correlation_matrix(frame, columns).collect():  # k*(k-1)/2 rows
        i, j = columns.index(row.a), columns.index(row.b)
        matrix[i, j] = matrix[j, i] = row.corr
    moments = frame.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    values, vectors = np.linalg.eigh(matrix)
    first = vectors[:, -1]
    first = first * (1.0 if first.sum() >= 0 else -1.0)
    return values[::-1].tolist(), first.tolist(), list(moments[:k]), list(moments[k:])


def latent_factor_profile(frame: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Share of the first and the first three components, participation ratio,
    correlation of the first component with the label, and both AUCs."""
    from tabloom.operators.ranks import auc

    values, first, means, deviations = latent_factor(frame, columns)
    total = sum(values)
    score = sum(((F.col(c).cast("double") - m) / d * w for c, w, m, d in zip(columns, first, means, deviations)), F.lit(0.0))
    mean = sum((F.col(c).cast("double") for c in columns), F.lit(0.0)) / len(columns)
    rows = frame.select(label, score.alias("_pc1"), mean.alias("_mean"))
    corr = rows.agg(F.corr("_pc1", F.col(label).cast("double")).alias("c"))
    return frame.sparkSession.range(1).select(
        F.lit(values[0] / total).alias("pc1_share"),
        F.lit(sum(values[:3]) / total).alias("top3_share"),
        F.lit(total**2 / sum(v * v for v in values)).alias("participation_ratio"),
        corr.scalar().alias("pc1_label_corr"),
        auc(rows, "_pc1", label).select("auc").scalar().alias("pc1_auc"),
        auc(rows, "_mean", label).select("auc").scalar().alias("mean_auc"),
    )
