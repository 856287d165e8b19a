"""Correlations of all pairs in one pass."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import stats as St


def test_correlation_matrix_equals_sparks_for_gaps_and_infinity_and_needs_no_expansion(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4)) + 1e6
    rows = [tuple(None if (i + j) % 7 == 0 else float(v) for j, v in enumerate(r)) for i, r in enumerate(x)]
    rows += [(float("inf"), None, 1e6, 1e6), (1.0, None, 2.0, None)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    found = St.correlation_matrix(frame, ["a", "b", "c", "d"])
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        want = frame.agg(F.corr(r.a, r.b)).first()[0]
        assert r.corr == pytest.approx(want, abs=1e-9, nan_ok=True)
    assert St.correlation_matrix(frame.where("false"), ["a", "b"]).count() == 0
    assert St.correlation_matrix(frame.limit(1), ["a", "b"]).first().corr is None
