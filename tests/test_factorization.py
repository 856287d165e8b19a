"""Factorisation machines by chunks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import VectorAssembler

from tabloom.operators.factorization import FactorizationMachine


def test_factorization_machine_learns_what_sparks_learns(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 4))
    y = (x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(size=2000) > 0).astype(int)
    frame = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], "a double, b double, c double, d double, label int")
    rows = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(frame)
    for more in ({}, {"regParam": 0.01, "fitLinear": False}, {"fitIntercept": False, "tol": 0.05, "maxIter": 40}):
        settings = {"factorSize": 3, "maxIter": 12, "stepSize": 0.1, "seed": 7} | more
        ours, theirs = FactorizationMachine(**settings).fit(rows), FMClassifier(**settings).fit(rows)
        assert ours.factors.toArray() == pytest.approx(theirs.factors.toArray(), abs=1e-8)
        assert ours.linear.toArray() == pytest.approx(theirs.linear.toArray(), abs=1e-8) and ours.intercept == pytest.approx(theirs.intercept, abs=1e-8)
    PipelineModel(stages=[ours]).write().overwrite().save(str(tmp_path / "fm"))
    a, b = (m.transform(rows).select("probability").collect() for m in (PipelineModel.load(str(tmp_path / "fm")), theirs))
    assert [r.probability[1] for r in a] == pytest.approx([r.probability[1] for r in b], abs=1e-8)
