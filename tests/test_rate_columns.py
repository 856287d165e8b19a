"""Rates at many keys: rows are shuffled before they are unpivoted."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators.target_encode import rate_logit_columns


def shuffles(frame, word="Exchange hashpartitioning"):
    return frame._jdf.queryExecution().executedPlan().toString().count(word)


def test_rate_logits_shuffle_rows_before_they_are_unpivoted(spark):
    rows = spark.createDataFrame([(i, i % 3, i % 4, i % 2, i % 5) for i in range(200)], "id long, a int, b int, label int, fold int")
    keys = {"a": [F.col("a")], "a_b": [F.col("a"), F.col("b")]}
    found = rate_logit_columns(rows, "id", keys, "label", "fold", 5.0)
    assert shuffles(found) == 1
    data = rows.collect()
    got = {r.id: r for r in found.collect()}
    assert len(got) == 200
    for r in data[::17]:
        for name, cols in (("a", "a"), ("a_b", "ab")):
            others = [q for q in data if q.fold != r.fold]
            prior = sum(q.label for q in others) / len(others)
            same = [q.label for q in others if all(q[c] == r[c] for c in cols)]
            p = (sum(same) + 5 * prior) / (len(same) + 5)
            assert got[r.id][name] == pytest.approx(np.log(p / (1 - p)), abs=1e-9)
