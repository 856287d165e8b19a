"""Fitted members, stacks, blends and neighbour votes."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabloom.functions.hashing import hash_unit
from tabloom.operators import members as M
from tabloom.operators import neighbours as N
from tabloom.operators import pseudo as Ps
from tabloom.operators import stack as S
from tabloom.operators.folds import hash_folds
from tabloom.operators.lookup import fitted
from tabloom.operators.ranks import auc
from tabloom.plans import all_entries
from tabloom.sources.survey import RAW_FEATURES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def logits(spark):
    """Two members of signal strengths 1.4 and .6, one of noise; labels from both signals."""
    base = spark.range(3000).select("id", *[(F.sqrt(-2 * F.ln(hash_unit("id", f"u{i}") + 1e-9)) * F.cos(6.283185307 * hash_unit("id", f"v{i}"))).alias(f"n{i}") for i in range(4)])
    label = (F.col("n0") * 1.4 + F.col("n1") * 0.6 + F.col("n3") > 0).cast("int")
    frame = base.select("id", label.alias("label"), F.col("n0").alias("strong"), F.col("n1").alias("weak"), F.col("n2").alias("noise"))
    return fitted(hash_folds(frame, "id", 5, 1), "test-logits")


MEMBERS = ["strong", "weak", "noise"]


def test_newton_equals_spark_logistic_regression(spark, logits):
    fit = S.newton_fits(logits, MEMBERS, "label", "fold", {"all": (None, MEMBERS)}, C=0.5)["all"]
    rows = VectorAssembler(inputCols=MEMBERS, outputCol="features").transform(logits)
    other = LogisticRegression(regParam=1 / (0.5 * 3000), standardization=False, tol=1e-12, maxIter=200).fit(rows)
    assert fit.gradient < 1e-8
    assert fit.weights[:3] == pytest.approx(other.coefficients.toArray(), abs=1e-5)
    assert fit.weights[3] == pytest.approx(other.intercept, abs=1e-5)


def test_stack_beats_its_best_member_and_noise_gets_little(spark, logits):
    scores, fits = S.nested_stack_scores(logits, MEMBERS, "label", "fold", 5, {"all": MEMBERS}, ["id"])
    stacked = auc(scores, "p", "label").first()["auc"]
    assert scores.count() == 3000 and scores.where("p < 0 or p > 1").count() == 0
    assert stacked > auc(logits, "strong", "label").first()["auc"]
    weights = fits[("all", 0)].weights
    assert abs(weights[2]) < 0.2 < weights[1] < weights[0]


def test_identical_members_share_the_weight(spark, logits):
    twice = logits.withColumn("copy", F.col("strong"))
    fit = S.newton_fits(twice, ["strong", "copy"], "label", "fold", {"all": (None, ["strong", "copy"])}, C=1.0)["all"]
    assert fit.weights[0] == pytest.approx(fit.weights[1], abs=1e-6)  # the penalty shares the weight


def test_greedy_takes_the_strong_member_first(spark, logits):
    trail = S.greedy_selection(logits, MEMBERS, "label", "fold", 5, min_gain=1e-3)
    assert [m for _, m, _ in trail] == ["strong", "weak"]


def test_coordinate_ascent_gives_noise_less(spark, logits):
    unit = fitted(logits.select("label", "fold", *[S.sigmoid(m).alias(m) for m in MEMBERS]), "unit")
    weights = S.coordinate_ascent(unit, MEMBERS, "label", "fold", {"all": None})["all"]
    assert weights.sum() == pytest.approx(1.0) and weights[2] < weights[1] < weights[0]


def test_view_names_must_be_unique(spark):
    table = spark.createDataFrame([("a", 0.9), ("a", 0.8)], "view string, auc double")
    with pytest.raises(ValueError, match="unique"):
        S.view_decisions(table, 0.5, 0.01)


SPEC = M.MemberSpec("m", "logistic", ("strong", "weak"), (), {"maxIter": 10}, 7)


def test_registry_lists_options_and_needs_a_seed():
    with pytest.raises(ValueError, match="boosted"):
        M.build_model("xyz", {}, 1)
    with pytest.raises(ValueError, match="seed"):
        M.build_model("tree", {}, None)


def test_cross_validation_scores_every_row_once_and_repeats(spark, logits):
    one = M.cross_validate(logits, SPEC, "fold", 3).toPandas().sort_values("id")
    folds = logits.where("fold < 3").count()
    assert len(one) == folds == one["id"].nunique()
    again = M.cross_validate(logits, SPEC, "fold", 3).toPandas().sort_values("id")
    assert np.allclose(one["p"], again["p"])
    assert M.member_auc(M.cross_validate(logits, SPEC, "fold", 3)).first()["auc"] > 0.8


def test_resumed_folds_are_kept_until_something_changes(spark, logits, tmp_path):
    frame = hash_folds(logits.drop("fold"), "id", 2, 5)
    first, done = M.resumable_cross_validate(frame, SPEC, "fold", 2, str(tmp_path))
    again, redone = M.resumable_cross_validate(frame, SPEC, "fold", 2, str(tmp_path))
    assert (done, redone) == ([0, 1], []) and first.count() == again.count() == 3000
    assert M.resumable_cross_validate(frame, replace(SPEC, seed=8), "fold", 2, str(tmp_path))[1] == [0, 1]
    assert M.resumable_cross_validate(frame.where("id < 2000"), SPEC, "fold", 2, str(tmp_path))[1] == [0, 1]


@pytest.mark.parametrize("block_rows", [10_000, 40])
def test_neighbours_equal_brute_force_in_one_and_many_blocks(spark, block_rows):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 5)), rng.integers(0, 2, 200)
    x[150] = x[3]  # one query at distance 0
    frame = spark.createDataFrame([(int(i), x[i].tolist(), int(y[i])) for i in range(200)], "id long, v array<double>, y int")
    refs, queries = frame.where("id < 150"), frame.where("id >= 150")
    d2 = ((x[150:, None, :] - x[None, :150, :]) ** 2).sum(-1)
    w = np.exp(-d2 / 2.0)
    soft = {r.id: r.p for r in N.soft_vote(queries, refs, "id", "v", "y", 2.0, block_rows).collect()}
    assert [soft[i] for i in range(150, 200)] == pytest.approx((w @ y[:150] / w.sum(1)).tolist(), abs=1e-9)
    near = {r.id: r.p for r in N.knn_vote(queries, refs, "id", "v", "y", 7, block_rows).collect()}
    for i in range(50):
        top = np.argsort(d2[i])[:7]
        if d2[i, top[0]] < 1e-12:
            want = float(y[top[0]])
        else:
            inv = 1 / np.sqrt(d2[i, top])
            want = float((inv * y[top]).sum() / inv.sum())
        assert near[150 + i] == pytest.approx(want, abs=1e-6)


def test_pseudo_labels_and_soft_targets(spark):
    scored = spark.createDataFrame([(1, 0.99), (2, 0.5), (3, 0.01)], "id long, p double")
    assert sorted((r.id, r.label) for r in Ps.select_confident(scored, "p", 0.9, 0.1).collect()) == [(1, 1), (3, 0)]
    soft = Ps.soft_targets(scored, "p", 0.5)
    assert soft.count() == 6
    assert all(r.w == pytest.approx(1.0) for r in soft.groupBy("id").agg(F.sum("weight").alias("w")).collect())


@pytest.mark.parametrize("name", ["newton_stacker", "latent_factor_profile", "boosted_trees_early_stop", "cross_validated_member", "model_bundle", "auxiliary_expectations"])
def test_rows_only_queries_run_on_the_small_tables(spark, name):
    assert all_entries()[name].run(spark, SMALL).count() > 0


def test_every_column_is_predicted_from_the_others(spark):
    found = {r.feature: r.accuracy for r in all_entries()["column_predictability"].run(spark, SMALL).collect()}
    assert set(found) == set(RAW_FEATURES) and all(0 <= v <= 1 for v in found.values())


@pytest.mark.parametrize("name", ["auxiliary_expectations_oof", "second_table_expectations", "auxiliary_expectations"])
def test_expectation_queries_hold_every_column(spark, name):
    found = all_entries()[name].run(spark, SMALL)
    assert [c for c in found.columns if c.startswith("aux_p_")] == [f"aux_p_{c}" for c in RAW_FEATURES]
    assert found.where("aux_sum_logp is null or aux_sum_logp > 0").count() == 0 < found.count()


def test_long_targets_are_binned_and_missing_values_add_nothing(spark):
    rows = [(i, float(i) if i % 10 else None, float(i // 100), "x" if i < 200 else "y") for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, far double, near double, kind string")
    table = M.expectation_models(frame, frame, ["far", "kind"], ["far", "near"], ["kind"], 1, ["id", "far"], {"numTrees": 5, "maxDepth": 5})
    got = table.toPandas()
    missing = got["far"].isna()
    assert missing.sum() == 40 and got.loc[missing, "aux_p_far"].isna().all() and got.loc[missing, "aux_hit_far"].isna().all()
    assert got.loc[missing, "aux_sum_logp"].to_numpy() == pytest.approx(np.log(np.maximum(got.loc[missing, "aux_p_kind"], 1e-6)).to_numpy())
    assert (got["aux_ev_far"] - got["id"]).abs().mean() < 60 and got.loc[~missing, "aux_p_far"].between(0, 1).all()
    bins = M._bins(frame, ["far"])["far"]
    assert len(bins[1]) == M.BINS and sum(bins[1].values()) / M.BINS == pytest.approx(200, abs=1)
