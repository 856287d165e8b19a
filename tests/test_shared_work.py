"""Work that several fits share is done once, and gives what each of them would have done alone."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import boosting as B
from tabloom.operators import members as M
from tabloom.plans import models as P


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    data = [(i, i % 3, float(a) if i % 7 else None, int(b), "xyz"[i % 3] if i % 11 else None, int(a + b > 1)) for i, (a, b) in enumerate(zip(r.normal(size=300), r.integers(0, 3, 300)))]
    return spark.createDataFrame(data, "id long, fold int, a double, b int, c string, label int").cache()


def test_shared_preparations_give_the_scores_of_own_ones(rows, monkeypatch):
    specs = [M.MemberSpec(n, "logistic", cols, cats, {"maxIter": 5}, 1) for n, cols, cats in (("one", ("a",), ()), ("two", ("a", "b"), ("c",)), ("three", ("b",), ("c",)))]
    fits = []
    imputer = M.Imputer
    monkeypatch.setattr(M, "Imputer", lambda **given: fits.append(1) or imputer(**given))
    shared = {(r.member): r.auc for r in M.compare_members(rows, specs, "fold", 3).collect()}
    assert len(fits) == 3  # one per fold, not one per fold and member
    own = {s.name: M.member_auc(M.cross_validate(rows, s, "fold", 3)).first()["auc"] for s in specs}
    assert shared == pytest.approx(own, abs=1e-9)


def test_a_column_that_is_a_number_here_and_a_category_there_is_not_shared(rows):
    specs = [M.MemberSpec("n", "logistic", ("b",), (), {}, 1), M.MemberSpec("c", "logistic", ("a",), ("b",), {}, 1)]
    frame, find = M.shared_preparations(rows, specs, "fold")
    assert find(specs[0], 0) is None and frame.schema == rows.schema


def test_rounds_fit_no_member_twice(spark, rows, monkeypatch):
    calls = []

    def validated(frame, spec, fold, folds, key="id", to_score=None, ready=None):
        calls.append(frame.count())
        p = (F.col("id") % 97) / 97.0
        found = frame.where("fold >= 0").select(key, F.lit("m").alias("member"), F.lit("train").alias("split"), fold, "label", p.alias("p"))
        if to_score is None:
            return found
        return found.unionByName(to_score.select(key, F.lit("m").alias("member"), F.lit("score").alias("split"), F.lit(0).alias(fold), F.lit(None).cast("int").alias("label"), p.alias("p")))

    monkeypatch.setattr(P.M, "cross_validate", validated)
    monkeypatch.setattr(P, "_folds", lambda spark, sf_dir: rows)
    monkeypatch.setattr(P, "_score_rows", lambda spark, sf_dir: rows.drop("fold").withColumn("id", F.col("id") + 1000))
    found = P.pseudo_label_rounds(spark, "")
    assert found.count() == 6 and len(calls) == 7  # the plain member, then one per threshold and round


def test_a_pass_recomputes_few_trees(spark, rows, monkeypatch):
    longest = []
    sums = B._sums
    monkeypatch.setattr(B, "_sums", lambda chunks, works, bins: longest.append(max(len(w.trees) for w in works.values())) or sums(chunks, works, bins))
    bins = B.fit_bins(rows, ["a", "b"], ["c"])
    B.fit_boosted(rows, bins, "label", B.Settings(rounds=9, depth=2), 1, "id", "fold", [0])
    assert max(longest) < 5


def test_nodes_are_those_of_a_walk():
    r = np.random.default_rng(0)
    codes = r.integers(0, 5, (3, 200)).astype(np.uint8)
    tree = B.Tree({1: 2, 2: 0, 6: 1, 3: 1}, {1: [0, 1], 2: [4], 3: [2, 3], 6: [0]}, dict.fromkeys((1, 2, 3, 4, 5, 6, 7, 12, 13), 0.0))

    def walk(row):
        at = 1
        while at in tree.feature:
            at = 2 * at + (codes[tree.feature[at], row] not in tree.left[at])
        return at

    assert B.nodes_of(codes, tree.routes(5)).tolist() == [walk(i) for i in range(200)]
    assert B.nodes_of(codes, B.Tree().routes(5)).tolist() == [1] * 200
