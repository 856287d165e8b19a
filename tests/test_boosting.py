"""Histogram boosting: exact splits, shared folds, start margins, storage."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabloom.functions.hashing import hash_unit
from tabloom.operators import boosting as B
from tabloom.operators import members as M
from tabloom.operators.folds import hash_folds
from tabloom.operators.lookup import fitted
from tabloom.operators.ranks import auc


@pytest.fixture(scope="module")
def rows(spark):
    """Two numeric columns (one with gaps), a category, a label that depends on all three."""
    u = [hash_unit("id", f"b{i}") for i in range(5)]
    base = spark.range(4000).select("id", u[0].alias("x"), F.when(u[1] > 0.1, F.floor(u[1] * 20)).cast("double").alias("gap"), F.when(u[2] < 0.95, F.floor(u[2] * 12).cast("string")).alias("kind"), u[3].alias("noise"), u[4].alias("_u"))
    signal = F.col("x") * 2 + F.coalesce(F.col("gap") / 20, F.lit(0.9)) + F.when(F.coalesce("kind", F.lit("0")).isin("1", "5", "9"), 1.2).otherwise(0.0)
    return fitted(hash_folds(base.withColumn("label", (F.col("_u") < 1 / (1 + F.exp(-3 * (signal - 2)))).cast("int")), "id", 4, 3), "boost")


def local(rows, bins):
    frame = rows.orderBy("id").toPandas()
    import pyarrow as pa

    batch = pa.RecordBatch.from_pandas(frame[["x", "gap", "noise", "kind"]], preserve_index=False)
    return B.encode_batch(batch, bins), frame["label"].to_numpy(float), frame["fold"].to_numpy(), frame["id"].to_numpy()


def brute(codes, y, n_numeric, settings):
    """Level-wise growth, every split from all rows."""
    base = np.log(y.mean() / (1 - y.mean()))
    margin, trees = np.full(len(y), base), []
    for _ in range(settings.rounds):
        p = 1 / (1 + np.exp(-margin))
        tree, node = B.Tree(), np.ones(len(y), int)
        for level in range(settings.depth):
            for at in range(2**level, 2 ** (level + 1)):
                mine = node == at
                if not mine.any():
                    continue
                g, h = (np.array([np.bincount(c[mine], v[mine], 70) for c in codes]) for v in (p - y, p * (1 - p)))
                found = B.best_split(g, h, np.arange(len(codes)), n_numeric, settings)
                if found is None:
                    continue
                _, tree.feature[at], tree.left[at], *sides = found
                for child, (a, b) in zip((2 * at, 2 * at + 1), sides):
                    tree.value[child] = -settings.rate * a / (b + settings.l2)
                left = np.isin(codes[found[1]], found[2])
                node[mine & left], node[mine & ~left] = 2 * at, 2 * at + 1
        trees.append(tree)
        margin += np.array([tree.value[n] for n in node])
    return trees, margin


def test_trees_equal_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(B, "REFRESH", 2)
    bins = B.fit_bins(rows, ["x", "gap", "noise"], ["kind"])
    settings = B.Settings(rounds=5, depth=3, rate=0.3, tolerance=0.0)
    codes, y, _, ids = local(rows, bins)
    want, margin = brute(codes, y, 3, settings)
    (model,) = B.fit_boosted(rows, bins, "label", settings, 1)
    assert [t.feature for t in model.trees] == [t.feature for t in want]
    assert [t.left for t in model.trees] == [t.left for t in want]
    got = {r.id: r.margins[0] for r in B.score_boosted([model], rows, ["id"]).collect()}
    assert [got[i] for i in ids] == pytest.approx(margin.tolist(), abs=1e-9)
    loss = (np.logaddexp(0, margin) - y * margin).mean()
    assert model.losses[-1][0] == pytest.approx(loss) and all(b[0] < a[0] for a, b in zip(model.losses, model.losses[1:]))


def test_a_small_sample_only_costs_passes(spark, rows, monkeypatch):
    bins = B.fit_bins(rows, ["x", "gap", "noise"], ["kind"])
    settings = B.Settings(rounds=3, depth=3, rate=0.3, tolerance=0.0)
    (whole,) = B.fit_boosted(rows, bins, "label", settings, 1)
    monkeypatch.setattr(B, "SAMPLE", 200)
    (small,) = B.fit_boosted(rows, bins, "label", settings, 1)
    assert [t.feature for t in small.trees] == [t.feature for t in whole.trees] and [t.left for t in small.trees] == [t.left for t in whole.trees]


def test_best_split_of_a_category_orders_its_levels():
    g, h = np.zeros((1, 6)), np.zeros((1, 6))
    g[0, 1:5], h[0, 1:5] = [5, -5, 5, -5], [10, 10, 10, 10]
    gain, feature, left, *_ = B.best_split(g, h, np.array([0]), 0, B.Settings())
    assert sorted(left) == [2, 4] and feature == 0
    assert B.best_split(g, h, np.array([0]), 0, B.Settings(min_child=25)) is None


def test_missing_values_go_where_they_belong():
    g, h = np.array([[9.0, -1, 0, 9, 0, 0]]), np.array([[9.0, 9, 0, 9, 0, 0]])
    _, _, left, *_ = B.best_split(g, h, np.array([0]), 1, B.Settings())
    assert left == [1] or sorted(left) == [1, 2]  # missing to the right
    g = np.array([[-9.0, -9, 0, 9, 0, 0]])
    assert 0 in B.best_split(g, h, np.array([0]), 1, B.Settings())[2]


def test_folds_in_shared_passes_equal_folds_alone(spark, rows):
    bins = B.fit_bins(rows, ["x", "gap"], ["kind"])
    settings = B.Settings(rounds=3, depth=3, rate=0.3, tolerance=0.0)
    together = B.fit_boosted(rows, bins, "label", settings, 1, fold="fold", held=[0, 2])
    (alone,) = B.fit_boosted(rows.where("fold <> 2"), bins, "label", settings, 1)
    assert [t.feature for t in together[1].trees] == [t.feature for t in alone.trees]
    assert together[1].base == pytest.approx(alone.base) and not np.isnan(together[1].losses[-1][1])


def test_as_good_as_the_library_trees_and_early_stop(spark, rows):
    params = {"maxIter": 10, "maxDepth": 3}
    mine = M.MemberSpec("h", "histogram", ("x", "gap", "noise"), ("kind",), {**params, "stepSize": 0.3}, 1)
    other = M.MemberSpec("b", "boosted", ("x", "gap", "noise"), ("kind",), {**params, "stepSize": 0.3}, 1)
    fit, held = rows.where("fold <> 0"), rows.where("fold = 0")
    found = {s.kind: auc(M.score(M.fit_member(fit, s), held, s, ["label"]), "p", "label").first()["auc"] for s in (mine, other)}
    assert found["histogram"] > found["boosted"] - 0.002
    quick = M.MemberSpec("h", "histogram", ("noise",), (), {"maxIter": 40, "stepSize": 1.0, "patience": 2}, 1)
    assert len(M.early_stopped(fit, quick).stages[-1].treeWeights) < 40


def test_margin_start_and_storage(spark, rows, tmp_path):
    linear = M.MemberSpec("l", "logistic", ("x",), (), {"maxIter": 10}, 1)
    trees = M.MemberSpec("t", "histogram", ("gap",), ("kind",), {"maxIter": 4, "maxDepth": 2, "stepSize": 0.5}, 1)
    scored, models = M.margin_boosting(rows, linear, trees, "fold", 4)
    table = scored.toPandas()
    assert len(table) == 4000 == table["id"].nunique() and all(b[0] < a[0] for m in models for a, b in zip(m.losses, m.losses[1:]))
    both = {c: auc(spark.createDataFrame(table[["label", c]]), c, "label").first()["auc"] for c in ("p", "p_linear")}
    assert both["p"] > both["p_linear"] + 0.01
    model = M.fit_member(rows, trees)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a, b = (M.score(m, rows, trees, ["id"]).orderBy("id").toPandas()["p"].to_numpy() for m in (model, again))
    assert np.array_equal(a, b)


def test_cross_validated_histogram_member_scores_every_row_once(spark, rows):
    spec = M.MemberSpec("h", "histogram", ("x", "gap"), ("kind",), {"maxIter": 3, "stepSize": 0.3}, 1)
    found = M.cross_validate(rows, spec, "fold", 4, "id", rows.where("id < 50").drop("label"))
    assert found.where("split = 'train'").count() == 4000 and found.where("split = 'score'").count() == 200
    assert M.averaged_scores(found).count() == 50


def test_empty_and_constant_labels(spark, rows):
    bins = B.fit_bins(rows, ["x"], ["kind"])
    for frame in (rows.limit(0), rows.where("label = 1"), rows.withColumn("label", F.lit(None).cast("int"))):
        (model,) = B.fit_boosted(frame, bins, "label", B.Settings(rounds=2), 1)
        assert all(0 <= 1 / (1 + np.exp(-r.margins[0])) <= 1 for r in B.score_boosted([model], rows.limit(5), ["id"]).collect())


def test_chunks_without_a_sampled_row(spark, monkeypatch):
    """A sample of few rows of a large table: most chunks have none of them."""
    monkeypatch.setattr(B, "SAMPLE", 8)
    frame = spark.range(400).selectExpr("id", "cast(id % 10 as double) as a", "cast(id % 10 > 4 as int) as label").repartition(8)
    bins = B.fit_bins(frame, ["a"], [])
    (model,) = B.fit_boosted(frame, bins, "label", B.Settings(rounds=2, depth=2), 1)
    assert model.best == 2 and model.losses[2][0] < model.losses[1][0] < model.losses[0][0]
