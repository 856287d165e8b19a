"""Forests of many targets in shared passes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from tabloom.functions.hashing import hash_unit
from tabloom.operators import forest as Fo
from tabloom.operators import members as M
from tabloom.operators.boosting import Tree, _kept, nodes_of
from tabloom.operators.folds import hash_folds
from tabloom.operators.lookup import fitted


@pytest.fixture(scope="module")
def rows(spark):
    u = [hash_unit("id", f"f{i}") for i in range(4)]
    base = spark.range(3000).select("id", F.floor(u[0] * 6).cast("double").alias("a"), u[1].alias("x"), F.floor(u[2] * 3).cast("string").alias("kind"), u[3].alias("_u"))
    follows = F.when(F.col("_u") < 0.9, (F.col("a") + F.col("kind").cast("int")) % 4).otherwise(F.floor(F.col("_u") * 40) % 4)
    return fitted(hash_folds(base.withColumn("b", F.when(F.col("id") % 17 > 0, follows.cast("double"))), "id", 3, 2), "forest")


def test_gini_split_equals_all_cuts():
    rng = np.random.default_rng(0)
    for _ in range(30):
        counts = rng.integers(0, 9, (2, 7, 3)) * (rng.random((2, 7, 1)) < 0.8)
        counts[1] = rng.permutation(counts[0])
        best = max(
            ((l**2).sum() / max(l.sum(), 1) + (r**2).sum() / max(r.sum(), 1), f, k)
            for f in range(2) for k in range(6) for l, r in [(counts[f, : k + 1].sum(axis=0).astype(float), counts[f, k + 1 :].sum(axis=0).astype(float))] if l.sum() and r.sum()
        )
        found = Fo.gini_split(counts, np.array([0, 1]), 2)
        if found is not None:
            left, right = (np.array(x, float) for x in found[2:])
            assert (left**2).sum() / left.sum() + (right**2).sum() / right.sum() == pytest.approx(best[0])


def test_trees_equal_brute_force_in_one_and_many_passes(spark, rows, monkeypatch):
    classes = M._classes(rows, ["b", "kind"], ["a", "x", "b"], [])
    bins = M.fit_bins(rows, ["a", "x", "b"], ["kind"], 16)
    grown = Fo.grow(rows, bins, classes, ["id"], 5, 2, 3, fold="fold", held=[None, 1])
    monkeypatch.setattr(Fo, "BATCH", 1)
    again = Fo.grow(rows, bins, classes, ["id"], 5, 2, 3, fold="fold", held=[None, 1])
    assert {k: [(t.feature, t.left, c) for t, c in v] for k, v in grown.items()} == {k: [(t.feature, t.left, c) for t, c in v] for k, v in again.items()}
    assert set(grown) == {(t, h) for t in ("b", "kind") for h in (0, 1)}
    frame = rows.withColumn("d", F.xxhash64("id")).toArrow().combine_chunks().to_batches()[0]
    codes, own, draw, fold = M.encode_batch(frame, bins), classes.classes(frame), frame.column("d").to_numpy(), frame.column("fold").to_numpy()
    for place, (target, held) in enumerate([(t, h) for t in classes.names for h in (0, 1)]):
        t = classes.names.index(target)
        for n, (tree, counts) in enumerate(grown[target, held]):
            use = _kept(draw, 0.7, (5 << 24) + 2 * place + n) & (own[t] >= 0) & ((fold != 1) if held else True)
            assert bins.features.index(target) not in tree.feature.values()
            node = nodes_of(codes, Tree(tree.feature, tree.left, dict.fromkeys(counts, 0.0)).routes(bins.width))
            for leaf in set(counts) - set(tree.feature):
                mine = own[t][use & (node == leaf)]
                assert len(mine) and np.bincount(mine, minlength=classes.size(target)).tolist() == counts[leaf]


def test_as_good_as_the_library_forest(spark, rows):
    table = M.expectation_models(rows, rows, ["b"], ["a", "x", "b"], ["kind"], 1, ["id"], {"numTrees": 10, "maxDepth": 5})
    mine = table.agg(F.avg("aux_hit_b")).first()[0]
    known = rows.where("b is not null")
    stages = [StringIndexer(inputCol="kind", outputCol="k"), VectorAssembler(inputCols=["a", "x", "k"], outputCol="features"), RandomForestClassifier(labelCol="b", numTrees=10, maxDepth=5, seed=1)]
    other = Pipeline(stages=stages).fit(known).transform(known).agg(F.avg((F.col("prediction") == F.col("b")).cast("int"))).first()[0]
    assert mine > other - 0.03


def test_folds_and_fixed_column_order(spark, rows):
    found = M.oof_expectations(rows, ["b", "kind"], ["a", "x", "b"], ["kind"], "fold", 3, 1, ["id"], {"numTrees": 3, "maxDepth": 3})
    assert found.columns == ["id", "aux_p_b", "aux_p_kind", "aux_ev_b", "aux_ev_kind", "aux_sum_logp", "aux_hit_b", "aux_hit_kind"]
    got = found.toPandas()
    assert len(got) == 3000 == got["id"].nunique() and got["aux_p_kind"].between(0, 1).all()
    assert got["aux_p_b"].isna().sum() == rows.where("b is null").count() and got["aux_ev_b"].between(0, 3).all()


def test_a_row_does_not_see_its_own_fold(spark, rows):
    changed = rows.withColumn("b", F.when(F.col("fold") == 0, F.lit(3.0)).otherwise(F.col("b")))
    ev = []
    for frame in (rows, changed):
        out = M.oof_expectations(frame, ["b"], ["a", "x"], ["kind"], "fold", 3, 1, ["id"], {"numTrees": 3, "maxDepth": 3})
        ev.append({r.id: r.aux_ev_b for r in out.join(rows.where("fold = 0").select("id"), "id").collect()})
    assert ev[0] == ev[1]


def test_new_levels_and_empty_tables(spark, rows):
    strange = rows.limit(3).withColumns({"kind": F.lit("new"), "b": F.lit(99.0)})
    got = M.expectation_models(rows, strange, ["b", "kind"], ["a", "x", "b"], ["kind"], 1, ["id"], {"numTrees": 2, "maxDepth": 2}).collect()
    assert all(r.aux_p_b == 0 and r.aux_p_kind == 0 and r.aux_hit_kind == 0 for r in got)
    assert M.expectation_models(rows.limit(0), rows.limit(2), ["kind"], ["a"], ["kind"], 1, ["id"]).count() == 2
