"""Logistic members fitted in shared passes are those of ``spark.ml``."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import logistic as L
from tabloom.operators import members as M
from tabloom.operators import ranks as R
from tabloom.plans import models as P


@pytest.fixture(scope="module")
def rows(spark):
    """Missing numbers and categories, a constant, a large offset, a level that only one fold has, rows that are never held out."""
    r = np.random.default_rng(3)
    data = []
    for i in range(400):
        a, b, t = float(r.normal()), int(r.integers(0, 6)), 1.7e9 + float(r.integers(0, 10**6))
        c = "rare" if i % 4 == 2 and i % 3 == 0 else "xyz"[i % 3] if i % 5 else None
        label = int(2 * a + b - 2.5 + (c == "x") + r.normal() > 0.3)
        data.append((i, i % 4 - 1, None if i % 7 == 0 else float("nan") if i % 13 == 0 else a, None if i % 11 == 0 else b, t, 1, c, label))
    return spark.createDataFrame(data, "id long, fold int, a double, b int, t double, k int, c string, label int").cache()


def test_shared_passes_give_the_scores_of_own_fits(rows, monkeypatch):
    imputer = M.Imputer
    monkeypatch.setattr(M, "Imputer", lambda **given: imputer(relativeError=0.0, **given))  # the shared ones are exact
    monkeypatch.setattr(L, "CHUNK_ROWS", 50)
    spec = M.MemberSpec("m", "logistic", ("a", "b", "t", "k"), ("c",), {"regParam": 0.001, "maxIter": 12}, 1)
    new = rows.drop("label").withColumns({"id": F.col("id") + 1000, "c": F.when(F.col("id") % 17 == 0, F.lit("never")).otherwise(F.col("c"))})
    own, shared = (M.cross_validate(rows, replace(spec, kind=k), "fold", 3, "id", new) for k in ("logistic", "shared_logistic"))
    assert own.dtypes == shared.dtypes
    own, shared = ({tuple(r[:-1]): r.p for r in found.collect()} for found in (own, shared))
    assert len(own) == 300 + 3 * 400 and shared == pytest.approx(own, abs=1e-12)


def test_many_levels_and_far_rows_change_no_score(rows, monkeypatch):
    spec = M.MemberSpec("m", "shared_logistic", ("a",), ("c",), {"maxIter": 8}, 1)
    plain = {r.id: r.p for r in M.cross_validate(rows, spec, "fold", 3).collect()}
    monkeypatch.setattr(L, "FEW_LEVELS", 0)
    monkeypatch.setattr(L, "SAFE", -1.0)
    assert {r.id: r.p for r in M.cross_validate(rows, spec, "fold", 3).collect()} == pytest.approx(plain, abs=1e-9)


def test_fit_rows_of_one_label_give_it_with_certainty(rows):
    spec = M.MemberSpec("m", "shared_logistic", ("a",), (), {}, 1)
    found = M.cross_validate(rows.withColumn("label", F.when(F.col("fold") == 1, F.col("id").cast("int") % 2).otherwise(1)), spec, "fold", 3)
    assert {r.p for r in found.where("fold = 1").collect()} == {1.0}


def test_labels_other_than_0_and_1_are_refused(rows):
    spec = M.MemberSpec("m", "shared_logistic", ("a",), (), {}, 1)
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        M.cross_validate(rows.withColumn("label", F.lit(2)), spec, "fold", 3)


@pytest.mark.parametrize("values", [[3.5, -2.25, 0.0, 7.0], [-5, 300, 2, 4, 4], [70000.0, -1.0, 5.0], [1e300, -1e-300, -0.0]])
def test_medians_are_exact(spark, values):
    frame = spark.createDataFrame([(float(v), 1, g) for v in values for g in (0, 1)], "v double, y int, fold int")
    found = L._medians(L._chunks(frame, ["v"], [], "y", "fold", [0, 1], []), ["v"], 2)
    assert found.tolist() == [[sorted(values)[(len(values) - 1) // 2]]] * 2


def test_auc_of_packed_scores(spark, monkeypatch):
    data = [(None if i % 13 == 0 else -0.0 if i % 7 == 0 else i * i % 31 / 4.0, None if i % 11 == 0 else int(i * 5 % 9 > 3)) for i in range(400)]
    frame = spark.createDataFrame(data, "p double, label int").repartition(3)
    expected = R.auc(frame, "p", "label").first()["auc"]
    assert R.whole_auc(frame, "p", "label") == pytest.approx(expected, abs=1e-15)
    monkeypatch.setattr(R, "TALLY_ROWS", 40)
    monkeypatch.setattr(R, "RANGE_VALUES", 5)
    assert R.whole_auc(frame, "p", "label") == pytest.approx(expected, abs=1e-15)
    assert R.whole_auc(frame.where("label = 1"), "p", "label") is None and R.whole_auc(frame.limit(0), "p", "label") is None


def test_rounds_walk_through_the_rows_once_for_all_folds(spark, monkeypatch):
    r = np.random.default_rng(5)
    data = [(i, i % 5, *map(int, r.integers(0, 6, 4)), int(r.integers(7, 80)), int(r.integers(0, 17)), ("Business", "Eco", "Eco Plus")[i % 3]) for i in range(600)]
    frame = spark.createDataFrame(data, "id long, fold int, r1 int, r6 int, r7 int, r8 int, age int, dep_delay int, class string")
    frame = frame.withColumn("label", (F.expr("3 * r6 + r1 + r7 + r8 + (id * 17) % 11") >= 20).cast("int")).cache()
    own, passes, losses = [], [], L._losses
    monkeypatch.setattr(M, "fit_member", lambda *given: own.append(1))
    monkeypatch.setattr(L, "_losses", lambda *given: passes.append(1) or losses(*given))
    monkeypatch.setattr(P, "_folds", lambda spark, sf_dir: frame)
    monkeypatch.setattr(P, "_score_rows", lambda spark, sf_dir: frame.drop("fold").withColumn("id", F.col("id") + 1000))
    found = P.pseudo_label_rounds(spark, "").collect()
    assert [(f.round, f.high) for f in found] == [(n, h) for h in (0.85, 0.9, 0.95) for n in (1, 2)] and all(f.auc > 0.6 and f.n_pseudo > 0 for f in found)
    assert not own and 7 < len(passes) < 7 * 40  # not 35 fits with passes of their own
