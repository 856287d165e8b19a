"""Hand-computed cases for the semantics that are easy to get wrong."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tabloom.functions import scalars as S
from tabloom.operators import derive as D
from tabloom.operators import encode as E
from tabloom.operators import evaluate as V
from tabloom.operators import folds as Fo
from tabloom.operators import gates as G
from tabloom.operators import group_stats as GS
from tabloom.operators import ranks as R
from tabloom.operators import stats as St
from tabloom.operators import target_encode as T
from tabloom.sources import sinks, tables
from tabloom.sources.contract import select_features
from tabloom.sources.survey import Roles


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


# ---- derived columns


def rated(spark, values):
    names = ", ".join(f"r{i} int" for i in range(1, len(values[0]) + 1))
    return spark.createDataFrame(values, names), Roles(ratings=[f"r{i}" for i in range(1, len(values[0]) + 1)])


def test_zero_is_missing_in_rating_aggregates(spark):
    frame, roles = rated(spark, [(0, 2, 4), (0, 0, 0), (0, 0, 3), (1, None, 5)])
    names = ["mean_service_rating", "worst_service_rating", "count_of_ratings_at_or_below_2", "rating_std"]
    out = D.add_derived(frame, names, roles).select(*names).collect()
    assert tuple(out[0]) == (3.0, 2.0, 1, pytest.approx(math.sqrt(2)))
    assert tuple(out[1]) == (None, None, 0, None)
    assert tuple(out[2]) == (3.0, 3.0, 0, None)
    assert tuple(out[3]) == (3.0, 1.0, 1, pytest.approx(math.sqrt(8)))


def test_unknown_derived_feature_is_an_error(spark):
    frame, roles = rated(spark, [(1, 2, 3)])
    with pytest.raises(ValueError, match="nonsense"):
        D.add_derived(frame, ["nonsense"], roles)


def test_bins_are_right_closed(spark):
    frame = spark.createDataFrame([(0,), (18,), (19,), (100,), (101,), (None,)], "age int")
    out = [r[0] for r in frame.select(S.right_closed_bin("age", D.AGE_EDGES)).collect()]
    assert out == [-1, 0, 1, 6, -1, -1]


def test_digits_use_the_magnitude_and_half_even(spark):
    frame = spark.createDataFrame([(-694.25,), (None,), (0.00025,)], "x double")
    pick = [S.decimal_digit("x", e) for e in (2, 1, 0, -1, -2, -4)]
    out = [tuple(r) for r in frame.select(*pick).collect()]
    assert out == [(6, 9, 4, 2, 5, 0), (0,) * 6, (0, 0, 0, 0, 0, 2)]


def test_unknown_category_code_is_zero(spark):
    frame = spark.createDataFrame([("Eco",), ("First",), (None,)], "class string")
    assert [r[0] for r in frame.select(S.code_of("class", D.CLASS_CODES)).collect()] == [1, 0, 0]


def test_status_groups(spark):
    frame = spark.createDataFrame([(None,), (30.0,), (0.0,)], "d double")
    assert [r[0] for r in frame.select(D.arrival_status("d")).collect()] == ["unknown", "delayed", "on_time"]


def test_clip_uses_train_bounds_and_keeps_null(spark):
    train = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    other = spark.createDataFrame([(-50.0,), (500.0,), (None,)], "x double")
    assert [r.x for r in D.percentile_clip(other, train, ["x"], 0.05, 0.95).collect()] == [5.0, 95.0, None]


# ---- order statistics


def test_quantiles_interpolate_linearly_with_ties_and_nulls(spark):
    frame = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,), (None,)], "x double")
    q = R.quantiles(frame, [], "x", [0.0, 0.25, 0.5, 0.9, 1.0]).first()["q"]
    assert q == pytest.approx([1.0, 1.75, 2.0, 3.4, 4.0])


def test_auc_averages_ties_and_is_null_for_one_class(spark):
    frame = spark.createDataFrame([("a", 0.9, 1), ("a", 0.5, 1), ("a", 0.5, 0), ("a", 0.1, 0), ("b", 0.3, 1)], "g string, p double, y int")
    assert rows(R.auc(frame, "p", "y", by=["g"]), "g", "auc") == [("a", 0.875), ("b", None)]


def test_auc_equals_pair_counting_on_many_buckets(spark):
    data = [((i * 37 % 101) / 101, int(i * 53 % 97 > 40)) for i in range(2000)]
    frame = spark.createDataFrame(data, "p double, y int")
    pos, neg = [p for p, y in data if y], [p for p, y in data if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert R.auc(frame, "p", "y").first()["auc"] == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)


@pytest.mark.parametrize("buckets", [2, 7, 64])
def test_running_totals_do_not_depend_on_buckets(spark, buckets):
    frame = spark.createDataFrame([("x", i * 7 % 50, 1) for i in range(50)] + [("y", 3, 2)], "g string, v int, n int")
    out = R.running_totals(frame, ["g"], "v", ["n"], buckets).collect()
    assert all(r.below_n == (r.v if r.g == "x" else 0) and r.all_n == (50 if r.g == "x" else 2) for r in out) and len(out) == 51


def test_hot_value_holds_a_third_of_the_rows(spark):
    frame = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    import pandas as pd

    local = frame.toPandas()
    want = local["x"].rank()
    u = want[local["y"] == 1].sum() - (local["y"] == 1).sum() * ((local["y"] == 1).sum() + 1) / 2
    got = R.auc(frame, "x", "y").first()["auc"]
    assert got == pytest.approx(u / ((local["y"] == 1).sum() * (local["y"] == 0).sum()), abs=1e-12)
    assert R.quantiles(frame, [], "x", [0.5]).first()["q"][0] == pytest.approx(float(pd.Series(local["x"]).quantile(0.5)))


def test_positions_are_exact_in_hash_order(spark):
    frame = spark.range(5000).select("id", (F.col("id") % 2).alias("label"))
    import hashlib

    got = {r.id: r.position for r in Fo.hash_order_position(frame, "id", 1, ["label"]).collect()}
    for label in (0, 1):
        want = sorted((i for i in range(5000) if i % 2 == label), key=lambda i: (hashlib.md5(f"1:{i}".encode()).hexdigest(), i))
        assert [got[i] for i in want] == list(range(2500))


# ---- splits


def test_split_is_disjoint_stratified_and_repeatable(spark):
    frame = spark.range(1000).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))
    shares = {"train": 0.7, "validation": 0.15, "test": 0.15}
    one = rows(Fo.stratified_split(frame, "id", "label", shares, 42), "id", "split")
    assert one == rows(Fo.stratified_split(frame.repartition(5), "id", "label", shares, 42), "id", "split")
    assert len(one) == len({i for i, _ in one}) == 1000
    sizes = {s: sum(1 for _, x in one if x == s) for s in shares}
    assert sizes == {"train": 700, "validation": 149, "test": 151}
    assert one != rows(Fo.stratified_split(frame, "id", "label", shares, 43), "id", "split")


# ---- leak safety


def labelled(spark, flip: bool):
    """600 rows, a unique key and a shared key; the label of row 0 may be flipped."""
    data = [(i, i, i * 7 % 40, int(i % 3 == 0) ^ int(flip and i == 0)) for i in range(600)]
    return Fo.hash_folds(spark.createDataFrame(data, "id long, own long, shared long, label int"), "id", 5, 3)


def test_own_label_never_reaches_own_encoding(spark):
    for key, same in (("own", True), ("shared", None)):
        before = dict(rows(T.oof_target_encode(labelled(spark, False), [key], "label", "fold", 20), "id", "te"))
        after = dict(rows(T.oof_target_encode(labelled(spark, True), [key], "label", "fold", 20), "id", "te"))
        assert before[0] == after[0]
        if same is None:
            assert any(before[i] != after[i] for i in before if i != 0), "the control must move"


def test_nested_encoding_hides_own_and_held_out_labels(spark):
    def run(flip):
        frame = Fo.hash_folds(labelled(spark, flip).withColumnRenamed("fold", "outer"), "id", 5, 9, "inner")
        out = T.nested_target_encode(frame, ["shared"], "label", "outer", "inner", F.lit(True), 5, 20)
        return {(r.id, r.context): (r.role, r.tef, r.outer) for r in out.collect()}

    before, after = run(False), run(True)
    outer0 = before[(0, 0)][2]
    for key in before:
        if key[0] == 0 or key[1] == outer0:
            assert before[key] == after[key], key
    assert any(before[k] != after[k] for k in before)
    assert {r for r, _, _ in before.values()} == {"fit", "held_out"}


def test_one_positive_row_cannot_see_itself(spark):
    frame = spark.createDataFrame([(i, 1, int(i == 0), i % 5) for i in range(20)], "id long, k int, label int, fold int")
    assert dict(rows(T.oof_target_encode(frame, ["k"], "label", "fold", 1), "id", "te"))[0] < 0.5


def test_smoothing_pulls_small_keys_to_the_rate(spark):
    data = [(9999, 1)] * 200 + [(500, 0)] * 1000 + [(1111, 1)] * 2
    table = dict(rows(T.fit_target_table(spark.createDataFrame(data, "k int, label int"), ["k"], "label", 20), "k", "te"))
    rate = 202 / 1202
    assert table[9999] > 0.9 and abs(table[1111] - rate) < 0.1


def test_null_keys_form_their_own_group(spark):
    frame = spark.createDataFrame([(1, None, 1, 0), (2, None, 1, 1), (3, "a", 0, 0), (4, "a", 0, 1)], "id long, k string, label int, fold int")
    te = dict(rows(T.oof_target_encode(frame, ["k"], "label", "fold", 1), "id", "te"))
    assert te[1] == te[2] > te[3] == te[4]


# ---- group statistics


def test_unseen_route_gets_size_zero_and_globals(spark):
    train = spark.createDataFrame([(500, 1.0, 1), (500, 3.0, 0), (1000, None, 1), (None, 9.0, 0)], "k int, x double, label int")
    table = GS.route_table(train, "k", ["x"], "label", 20)
    assert rows(table, "k", "route_size") == [(500, 2), (1000, 1)]
    out = GS.apply_route(spark.createDataFrame([(777777, None), (500, 5.0)], "k int, x double"), table, train, "k", ["x"], "label")
    assert rows(out, "k", "route_size", "routediff_x") == [(500, 2, 3.0), (777777, 0, 0.0)]
    assert out.where("route_rate is null").count() == 0


def test_frequency_of_unseen_and_null(spark):
    train = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    out = E.add_frequencies(spark.createDataFrame([(1,), (3,), (None,)], "k int"), train, ["k"]).collect()
    assert {r.k: (r.freq_k, round(r.rarity_k, 9)) for r in out} == {1: (0.5, round(math.log(2), 9)), 3: (0.0, round(math.log(4), 9)), None: (0.0, round(math.log(4), 9))}


def test_pinned_codes_refuse_unseen_levels(spark):
    train = spark.createDataFrame([("b",), ("a",)], "c string")
    assert rows(E.pinned_codes(train, train, ["c"]), "c", "c_code") == [("a", 0.0), ("b", 1.0)]
    with pytest.raises(Exception):
        E.pinned_codes(spark.createDataFrame([("z",)], "c string"), train, ["c"]).collect()


# ---- gates


def test_gates_pass_and_fail(spark):
    good = spark.createDataFrame([(1, 3, 1.0), (2, 4, None), (3, 5, 2.0)], "id long, r int, x double")
    assert G.require(G.quality_report(G.value_range(good, ["r"], 0, 5), G.unique_key(good, "id"), G.missing_share(good, ["x"], 0.4))).count() == 3
    for report, name in (
        (G.value_range(spark.createDataFrame([(7,)], "r int"), ["r"], 0, 5), "r"),
        (G.unique_key(spark.createDataFrame([(1,), (1,)], "id long"), "id"), "id"),
        (G.missing_share(spark.createDataFrame([(None,), (1,)], "x int"), ["x"], 0.4), "x"),
    ):
        with pytest.raises(ValueError, match=name):
            G.require(report)
    assert rows(G.required_columns(good, ["id", "label"]).where("not passed"), "subject") == [("label",)]


def test_order_breaks_across_buckets(spark):
    frame = spark.createDataFrame([(i, i if i != 500 else 0) for i in range(1000)], "pos long, key long")
    assert tuple(G.order_breaks(frame, "pos", "key").first()) == (1, False)
    assert tuple(G.order_breaks(frame, "pos", "pos").first()) == (0, True)


def test_coverage_gate_counts(spark):
    train = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    scored = spark.createDataFrame([(1,), (2,), (2,), (9,)], "id long")
    assert tuple(G.oof_coverage(scored, train, "id").first()) == (1, 1, 1, False)


# ---- metrics


def test_confusion_counts(spark):
    frame = spark.createDataFrame(list(zip([0.9, 0.2, 0.8, 0.1, 0.6, 0.4], [1, 1, 0, 0, 1, 0])), "p double, y int")
    r = V.confusion(frame, "p", "y").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 2)


def test_rule_arithmetic_and_undefined_precision(spark):
    frame = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (0, 0)], "x int, y int")
    table = {r.rule: r for r in V.rule_scores(frame, {"x": F.col("x") == 1, "none": F.lit(False)}, "y").collect()}
    assert (table["x"].accuracy, table["x"].recall) == (0.75, 1.0) and table["x"].precision == pytest.approx(2 / 3)
    assert table["none"].precision == 1.0 and table["none"].auc == 0.5
    assert V.confusion(frame.withColumn("p", F.lit(0.0)), "p", "y").first().precision == 0.0


def test_mistakes_are_exactly_the_wrong_rows(spark):
    frame = spark.createDataFrame([(1, 0.95, 1), (2, 0.05, 1), (3, 0.90, 0), (4, 0.10, 0)], "id long, p double, y int")
    assert [r.id for r in V.worst_mistakes(frame, "id", "p", "y").collect()] == [2, 3]


def test_yates_applies_to_two_by_two_only(spark):
    data = [("a", 1)] * 10 + [("a", 0)] * 20 + [("b", 1)] * 30 + [("b", 0)] * 5
    frame = spark.createDataFrame(data, "c string, y int")
    n, a, b, c, d = 65, 10, 20, 30, 5
    plain = n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    yates = n * (abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert St.chi_square(frame, ["c"], "y").first()["chi2"] == pytest.approx(yates)
    row = St.chi_square(frame, ["c"], "y", yates=False).first()
    assert row["chi2"] == pytest.approx(plain) and row["cramers_v"] == pytest.approx(math.sqrt(plain / n))


def test_chi_square_tail_in_closed_form(spark):
    frame = spark.createDataFrame([(3.841459, 1), (5.991465, 2), (7.814728, 3), (18.307038, 10)], "x double, k int")
    assert [r[0] for r in frame.select(St.chi_square_p("x", "k")).collect()] == pytest.approx([0.05] * 4, abs=1e-6)


# ---- sources and sinks


def test_union_of_splits_keeps_rows_and_refuses_repeated_columns(spark):
    a, b = spark.createDataFrame([(1, 5, 1)], "id long, age int, label int"), spark.createDataFrame([(2, 6)], "id long, age int")
    assert rows(tables.union_splits({"train": a, "score": b}, "id"), "id", "split") == [(1, "train"), (2, "score")]
    with pytest.raises(ValueError, match="age"):
        tables.union_splits({"train": a.select("id", "age", F.col("label").alias("age"))}, "id")


def test_empty_csv_is_an_error(spark, tmp_path):
    path = str(tmp_path / "e.csv")
    (tmp_path / "e.csv").write_text("id\n")
    with pytest.raises(ValueError, match="no rows"):
        tables.read_csv_table(spark, path, "id bigint")


def test_export_needs_the_template_rows(spark, tmp_path):
    template = spark.createDataFrame([(1, False), (2, False), (3, False)], "id long, label boolean")
    good = spark.createDataFrame([(0.1, 1), (0.2, 2), (0.3, 3)], "label double, id long")
    sinks.write_scored(good, template, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["id", "label"]
    with pytest.raises(ValueError, match="template"):
        sinks.write_scored(good.where("id < 3"), template, str(tmp_path / "bad"))


def test_fingerprint_ignores_order_and_sees_changes(spark):
    frame = spark.range(100).select("id", (F.col("id") * 2).alias("x"))
    one = tuple(sinks.fingerprint(frame).first())
    assert one == tuple(sinks.fingerprint(frame.orderBy(F.desc("id")).repartition(7)).first())
    assert one != tuple(sinks.fingerprint(frame.withColumn("x", F.when(F.col("id") == 5, 0).otherwise(F.col("x")))).first())


def test_views_by_name(spark):
    names = ["te_a", "te_b_code", "tef_a", "age"]
    assert select_features(names, keep_prefixes=["te_"], drop_suffixes=["_code"]) == ["te_a"]
    with pytest.raises(ValueError):
        select_features(names, keep_prefixes=["zz"])


def test_vocabulary_codes_follow_the_order_without_a_window_over_the_levels(spark):
    frame = spark.range(3000).selectExpr("cast(id % 1237 as string) as long", "if(id % 5 = 0, null, cast(id % 3 as string)) as short")
    got = E.vocabulary(frame, ["long", "short"])
    want = [("long", v, i) for i, v in enumerate(sorted({str(i) for i in range(1237)}))] + [("short", str(i), i) for i in range(3)]
    assert sorted((r.feature, r.level, r.code) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
