"""In-fold target encodings as pipeline stages."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabloom.operators import members as M
from tabloom.operators.encoders import FIT_ROWS, FoldTargetEncoder
from tabloom.operators.folds import hash_folds
from tabloom.operators.lookup import fitted

SETS = (("a",), ("a", "b"))


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, f"k{i % 7}" if i % 11 else None, i % 4, float(i % 5), int((i % 7) * 3 + i % 5 > 11)) for i in range(400)]
    rows.append((400, "alone", 0, 1.0, 1))
    base = spark.createDataFrame(rows, "id long, a string, b int, x double, label int")
    return fitted(hash_folds(base, "id", 3, 5), "enc")


def encode(frame, fit, auto=False):
    model = FoldTargetEncoder(keySets=SETS, seed=9, innerFolds=4, smoothing=5.0, auto=auto).fit(fit)
    return model, model.transform(frame)


def test_values_equal_brute_force(spark, frame):
    model, out = encode(frame.withColumn(FIT_ROWS, F.col("id") < 300), frame.where("id < 300"))
    cells = {r.id: r.c for r in frame.select("id", model._cell().alias("c")).collect()}
    rows = frame.collect()
    fit = [r for r in rows if r.id < 300]
    for r in out.collect():
        use = [q for q in fit if r.id >= 300 or cells[q.id] != cells[r.id]]
        prior = sum(q.label for q in use) / len(use)
        for name, keys in (("tef_a", ("a",)), ("te2_pair_a_b", ("a", "b"))):
            same = [q.label for q in use if all(q[k] == r[k] for k in keys)]
            assert r[name] == pytest.approx((sum(same) + 5 * prior) / (len(same) + 5), abs=1e-12)


@pytest.mark.parametrize("auto", [False, True])
def test_own_label_does_not_move_own_value(spark, frame, auto):
    flipped = frame.withColumn("label", F.when(F.col("id").isin(3, 400), 1 - F.col("label")).otherwise(F.col("label")))
    names = ["tea_a", "tea_a_b"] if auto else ["tef_a", "te2_pair_a_b"]
    # one row at a time: rows of other inner folds may move, the row itself may not
    for own in (3, 400):
        one = frame.withColumn("label", F.when(F.col("id") == own, 1 - F.col("label")).otherwise(F.col("label")))
        before, after = ({r.id: tuple(r[n] for n in names) for r in encode(f.withColumn(FIT_ROWS, F.lit(True)), f, auto)[1].collect()} for f in (frame, one))
        assert before[own] == after[own] and before != after
    assert flipped.count() == frame.count()


def test_fitted_inside_every_fold_and_reloaded(spark, frame, tmp_path):
    spec = M.MemberSpec("m", "logistic", ("x",), (), {"maxIter": 10}, 3, encoded=SETS, auto_encoded=(("a",),))
    plain = M.MemberSpec("p", "logistic", ("x",), (), {"maxIter": 10}, 3)
    assert spec.encodings == ["tef_a", "te2_pair_a_b", "tea_a"] and spec.inputs == ["x", "a", "b"]
    found = M.cross_validate(frame, spec, "fold", 3).unionByName(M.cross_validate(frame, plain, "fold", 3))
    aucs = {r.member: r.auc for r in M.member_auc(found).collect()}
    assert aucs["m"] > aucs["p"] + 0.05 and found.where("member = 'm'").count() == 401
    model = M.fit_member(frame.where("fold <> 0"), spec)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    held = frame.where("fold = 0")
    a, b = (dict(M.score(m, held, spec, ["id"]).collect()) for m in (model, again))
    assert a == b and len(a) == held.count()
    # a held-out row's own label is not part of its value
    changed = held.withColumn("label", 1 - F.col("label"))
    assert dict(M.score(model, changed, spec, ["id"]).collect()) == a


def test_histogram_member_takes_encodings(spark, frame):
    spec = M.MemberSpec("h", "histogram", ("x",), (), {"maxIter": 3, "maxDepth": 2}, 3, encoded=SETS)
    assert M.cross_validate(frame, spec, "fold", 2, "id", frame.drop("label")).groupBy("split").count().count() == 2


def test_names_do_not_meet_the_raw_columns(spark, frame):
    _, out = encode(frame, frame)
    assert len(set(out.columns)) == len(out.columns) and set(frame.columns) < set(out.columns)
    by_key = defaultdict(set)
    for r in out.collect():
        by_key[r.a].add(r.tef_a)
    assert all(len(v) == 1 for v in by_key.values())  # rows that are not marked take the full map
