"""Keys that must stay apart, views, and writes that run twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import encode as E
from tabloom.operators import members as M
from tabloom.operators.folds import hash_folds
from tabloom.operators.lookup import fitted
from tabloom.operators.target_encode import oof_rates
from tabloom.sources import sinks
from tabloom.sources.contract import build_contract, select_features, view_rows

ODD = [(1, "a|b", "c"), (2, "a", "b|c"), (3, None, "x"), (4, "nan", "x"), (5, "\\N", "x"), (6, "a\\", "|b"), (7, "a\\|", "b"), (8, "a_b", None), (9, "a", "b_"), (10, "a_", "b")]


def test_text_keys_tell_all_combinations_apart(spark):
    frame = spark.createDataFrame(ODD, "id int, a string, b string")
    assert E.factorise(frame, ["a", "b"]).select("code").distinct().count() == len(ODD)
    assert frame.select(E.composite_key(["a", "b"]).alias("k")).distinct().count() == len(ODD)
    assert frame.select(*[c.alias(n) for n, c in E.pair_keys([("a", "b")]).items()]).distinct().count() == len(ODD)


def test_rates_keep_null_and_nan_apart(spark):
    rows = [(i, None if i % 2 else "nan", i % 2, i % 4 // 2) for i in range(40)]
    frame = spark.createDataFrame(rows, "id int, k string, label int, fold int")
    rates = {r.id: r.rate for r in oof_rates(frame, ["id"], {"m": [F.col("k")]}, "label", "fold", 1.0).collect()}
    assert rates[1] > 0.9 > 0.1 > rates[0]


def test_a_kept_prefix_wins_over_a_dropped_one(spark):
    names = ["r1", "r10", "r2_cat", "age"]
    assert select_features(names, ["r"], ["r1"], ["_cat"]) == ["r1", "r10"]
    assert select_features(names, [], ["r1"], ["_cat"]) == ["age"]
    contract = build_contract(spark.createDataFrame([(1, 2, 3, 4)], names), names, [])
    assert sorted(r.feature for r in view_rows(contract, ["r"], ["r1"], ["_cat"]).collect()) == ["r1", "r10"]


def test_predictions_written_twice_are_there_once(spark, tmp_path):
    path = str(tmp_path / "predictions")
    rows = spark.createDataFrame([(i, "007", "train", i % 2, 0.5) for i in range(10)], "id bigint, member string, split string, fold int, p double")
    sinks.write_predictions(rows, path)
    sinks.write_predictions(rows.withColumn("member", F.lit("b")), path)
    sinks.write_predictions(rows.where("fold = 1").withColumn("p", F.lit(0.75)), path)
    found = sinks.read_predictions(spark, path)
    assert dict(found.dtypes)["member"] == "string"
    assert {(r.member, r.fold): (r.n, r.p) for r in found.groupBy("member", "fold").agg(F.count("*").alias("n"), F.max("p").alias("p")).collect()} == {
        ("007", 0): (5, 0.5), ("007", 1): (5, 0.75), ("b", 0): (5, 0.5), ("b", 1): (5, 0.5),
    }
    assert sinks.fold_count_mismatch(found).count() == 0


def test_changed_labels_refit_every_fold(spark, tmp_path):
    base = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    frame = hash_folds(base, "id", 2, 1)
    spec = M.MemberSpec("m", "logistic", ("x",), (), {"maxIter": 3}, 1)
    run = lambda f: M.resumable_cross_validate(f, spec, "fold", 2, str(tmp_path / "cv"))[1]
    assert run(frame) == [0, 1] and run(frame) == []
    assert run(frame.withColumn("label", 1 - F.col("label"))) == [0, 1]
    assert run(hash_folds(base, "id", 2, 2)) == [0, 1]


def test_trees_take_long_categories(spark):
    frame = spark.range(400).select("id", (F.col("id") % 60).cast("string").alias("c"), F.col("id").cast("double").alias("x"), (F.col("id") % 60 < 20).cast("int").alias("label"))
    for kind, params in {"tree": {"maxDepth": 3}, "boosted": {"maxIter": 2, "maxDepth": 3}}.items():
        spec = M.MemberSpec(kind, kind, ("x",), ("c",), params, 1)
        assert M.score(M.fit_member(frame, spec), frame, spec, ["id"]).count() == 400


def test_members_score_after_an_observation(spark):
    """A used observation makes the session unserialisable; fitted members must not carry it along."""
    metrics = sinks.StepMetrics(spark)
    frame = spark.range(120).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("string").alias("c"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    metrics.observe(frame, "step").write.format("noop").mode("overwrite").save()
    assert metrics.table().count() == 1
    settings = {"logistic": {}, "forest": {"numTrees": 2}, "tree": {}, "boosted": {"maxIter": 2}, "factorization": {"maxIter": 2}, "perceptron": {"hidden": [2], "maxIter": 2}}
    for kind, params in settings.items():
        spec = M.MemberSpec(kind, kind, ("x",), ("c",), params, 1)
        model = M.fit_member(frame, spec)
        parts = M.score(model, frame, spec, ["id"]).unionByName(M.score(model, frame, spec, ["id"]))
        assert fitted(parts, "scores").count() == 240
