"""Queries for spark.ml members and what is built on them."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.ratings import mean_rating
from tabloom.functions.scalars import logit
from tabloom.operators import derive as D
from tabloom.operators import members as M
from tabloom.operators import neighbours as N
from tabloom.operators import pseudo as Ps
from tabloom.operators.lookup import dealt, fitted
from tabloom.operators.ranks import auc, whole_auc
from tabloom.operators.encoders import FIT_ROWS, FoldTargetEncoder, encoded_name
from tabloom.plans.common import CATEGORICAL, CONTINUOUS, FOLDS, NUMERIC, RATINGS, SEED, SMOOTHING, TRAIN, auc_sql, hash_fold_sql, r, rd
from tabloom.plans.derived import MEAN
from tabloom.plans.member_data import folded_train
from tabloom.plans.registry import plain_sql, query, survey_sql
from tabloom.session import scratch_path
from tabloom.sources import sinks
from tabloom.sources.contract import build_contract, view_rows
from tabloom.sources.survey import RAW_FEATURES, is_train, second_survey, survey
from tabloom.sources.tables import read_table

CORE = ("r1", "r6", "r7", "r8", "age", "dep_delay")
LOGISTIC = M.MemberSpec("logistic", "logistic", CORE, ("class",), {"regParam": 0.001, "maxIter": 20}, SEED)
BOOSTED = M.MemberSpec("boosted", "histogram", CORE, ("class",), {"maxIter": 20, "maxDepth": 4, "stepSize": 0.3}, SEED)


def _folded(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return dealt(folded_train(spark, sf_dir, columns or [*NUMERIC, *CATEGORICAL]), "folds")


def _score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey(spark, sf_dir).where(~is_train())


@query("median_imputation", "I2", sql=survey_sql(f"select id, {', '.join(f'{rd(f'coalesce({c}, m_{c})')} as {c}' for c in CONTINUOUS)} from survey, m", tr=TRAIN, m="select " + ", ".join(f"quantile_cont(cast({c} as double), 0.5) as m_{c}" for c in CONTINUOUS) + " from tr"))
def median_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir)
    return D.impute_median(rows, rows.where(is_train()), CONTINUOUS).select("id", *[r(c).alias(c) for c in CONTINUOUS])


@query("standard_scaling", "I3", sql=survey_sql("select id, " + ", ".join(rd(f"({c} - m_{c}) / s_{c}") + f" as {c}_z" for c in NUMERIC) + " from survey, m", tr=TRAIN, m="select " + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in NUMERIC) + " from tr"))
def standard_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir)
    return D.standardise(rows, rows.where(is_train()), NUMERIC, sample=False).select("id", *[r(f"{c}_z").alias(f"{c}_z") for c in NUMERIC])


@query("ordinal_target_bins", "I28", sql=survey_sql(f"select id, case when m < 1.5 then 0 when m < 2.5 then 1 when m < 3.5 then 2 when m < 4.5 then 3 else 4 end as level from (select id, coalesce({MEAN}, 2.5) as m from survey) x"))
def ordinal_target_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.coalesce(mean_rating(RATINGS), F.lit(2.5))
    return survey(spark, sf_dir).select("id", D.ordinal_bin(mean).alias("level"))


@query(
    "feature_view", "I19",
    sql=survey_sql(
        "select feature, position, n_levels from (" + " union all ".join(
            f"select '{f}' as feature, {i} as position, {f'(select count(distinct {f}) from survey where id % 10 < 7)' if f in CATEGORICAL else 'cast(0 as bigint)'} as n_levels" for i, f in enumerate(RAW_FEATURES)
        ) + ") c where (starts_with(feature, 'r') or starts_with(feature, 'c') or starts_with(feature, 'd')) and not ends_with(feature, '_type')"
    ),
)
def feature_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = build_contract(survey(spark, sf_dir).where(is_train()), RAW_FEATURES, CATEGORICAL)
    view = view_rows(contract, keep_prefixes=["r", "c", "d"], drop_prefixes=["r1"], drop_suffixes=["_type"])
    return view.select("feature", "position", F.coalesce(F.size("levels"), F.lit(0)).cast("bigint").alias("n_levels"))


VEC = "select vec_id, cast(embedding as double[]) as e, case when label < 5 then 1 else 0 end as y from embeddings"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("y"))
    reference = F.col("vec_id") % 10 < 7
    return rows.where(~reference), rows.where(reference)


PAIR_DISTANCE = "list_sum(list_transform(list_zip(q.e, f.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query(
    "k_nearest_neighbours", "I10",
    sql=plain_sql(
        f"select q as vec_id, {rd('sum(y / sqrt(d2)) / sum(1 / sqrt(d2))', 5)} as p from (select *, row_number() over (partition by q order by d2, k) as rn from pairs) n where rn <= 15 group by q",
        v=VEC,
        el="select vec_id, unnest(e) as x, generate_subscripts(e, 1) as i from v",
        mom="select i, avg(x) as m, stddev_pop(x) as s from el where vec_id % 10 < 7 group by i",
        sc="select el.vec_id, list((x - m) / s order by el.i) as e from el join mom on mom.i = el.i group by el.vec_id",
        w="select sc.*, v.y from sc join v on v.vec_id = sc.vec_id",
        pairs=f"select q.vec_id as q, f.vec_id as k, f.y, {PAIR_DISTANCE} as d2 from w q, w f where q.vec_id % 10 >= 7 and f.vec_id % 10 < 7",
    ),
)
def k_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, reference = _vectors(spark, sf_dir)
    scaled = N.scale_vectors(queries, reference, "embedding"), N.scale_vectors(reference, reference, "embedding")
    return N.knn_vote(*scaled, "vec_id", "embedding", "y", 15).withColumn("p", r("p", 5))


@query(
    "soft_neighbour_vote", "I11",
    sql=plain_sql(
        f"select q as vec_id, {rd('sum(y * exp(-(d2 - lo) / 0.5)) / sum(exp(-(d2 - lo) / 0.5))', 5)} as p from (select *, min(d2) over (partition by q) as lo from pairs) n group by q",
        v=VEC, pairs=f"select q.vec_id as q, f.vec_id as k, f.y, {PAIR_DISTANCE} as d2 from v q, v f where q.vec_id % 10 >= 7 and f.vec_id % 10 < 7",
    ),
)
def soft_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, reference = _vectors(spark, sf_dir)
    return N.soft_vote(queries, reference, "vec_id", "embedding", "y", 0.5).withColumn("p", r("p", 5))


# ---- fitted members: rows-only checks


@query("model_registry_comparison", "I1", "I24", note="every registered estimator on the same rows and folds")
def model_registry_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = {
        "logistic": {"maxIter": 10}, "tree": {"maxDepth": 4}, "forest": {"numTrees": 5, "maxDepth": 4}, "boosted": {"maxIter": 3, "maxDepth": 3},
        "perceptron": {"hidden": [8], "maxIter": 20}, "factorization": {"factorSize": 4, "maxIter": 20, "stepSize": 0.1}, "histogram": {"maxIter": 10, "stepSize": 0.3},
    }
    specs = [M.MemberSpec(kind, kind, CORE, ("class",), p, SEED) for kind, p in params.items()]
    return M.compare_members(_folds(spark, sf_dir), specs, "fold", FOLDS)


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.operators.folds import hash_folds

    return dealt(hash_folds(survey(spark, sf_dir).where(is_train()), "id", FOLDS, SEED), "folds")


@query("logistic_coefficients", "I4", note="impute, scale, fit; coefficients by magnitude")
def logistic_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = survey(spark, sf_dir).where(is_train())
    spec = replace(LOGISTIC, numeric=tuple(NUMERIC), categorical=tuple(CATEGORICAL))
    return M.linear_terms(M.fit_member(train, spec), train, spec)


@query("forest_importance", "I5", note="tree and forest impurity importance")
def forest_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = dealt(survey(spark, sf_dir).where(is_train()))
    parts = []
    for kind, params in {"tree": {"maxDepth": 5}, "forest": {"numTrees": 10, "maxDepth": 5}}.items():
        spec = M.MemberSpec(kind, kind, tuple(NUMERIC), tuple(CATEGORICAL), params, SEED)
        parts.append(M.impurity_importance(M.fit_member(train, spec), train, spec).withColumn("model", F.lit(kind)))
    return parts[0].unionByName(parts[1])


@query("boosted_trees_early_stop", "I6", "H7", note="histogram boosting, native categories; validation slice carved from the fit rows by hash")
def boosted_trees_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(survey(spark, sf_dir).select("id", "label", *BOOSTED.features))
    model = M.early_stopped(rows.where(is_train()), replace(BOOSTED, params={**BOOSTED.params, "patience": 3}))
    scored = M.score(model, rows.where(~is_train()), BOOSTED, ["id", "label"])
    return auc(scored, "p", "label").withColumn("trees", F.lit(len(model.stages[-1].treeWeights)))


LAYOUTS = ((8,), (16,), (8, 4), (16, 8))


@query("perceptron_seed_spread", "I7", "I8", note="layouts x seeds; AUC of each and of the seed average")
def perceptron_seed_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(survey(spark, sf_dir))
    train, held = rows.where(is_train()), rows.where(~is_train())
    specs = [M.MemberSpec("p", "perceptron", CORE, ("class",), {"hidden": list(layout), "maxIter": 25}, seed) for layout in LAYOUTS for seed in range(1, 6)]
    ready = M.prepared(train, specs[0])  # the same for every layout and seed, and so are the vectors
    fit_rows, new = (fitted(ready.transform(M.numeric_input(rows, list(CORE))).select("id", "label", "features"), "vectors") for rows in (train, held))

    def scored(spec: M.MemberSpec) -> DataFrame:
        layout = F.lit("-".join(map(str, spec.params["hidden"]))).alias("layout")
        found = M.fit_shaped(fit_rows, spec).transform(new)
        return found.select("id", "label", M.positive_probability().alias("p"), layout, F.lit(spec.seed).alias("seed"))

    parts = fitted(reduce(DataFrame.unionByName, M.together(scored, specs, spark, M.at_once(fit_rows))), "seeds")
    single = auc(parts, "p", "label", by=["layout", "seed"])
    averaged = auc(parts.groupBy("id", "label", "layout").agg(F.avg("p").alias("p")), "p", "label", by=["layout"])
    spread = single.groupBy("layout").agg(F.avg("auc").alias("mean"), F.max("auc").alias("best"), F.min("auc").alias("worst"), (F.max("auc") - F.min("auc")).alias("spread"))
    return spread.join(averaged.select("layout", F.col("auc").alias("averaged")), "layout")


@query("factorization_machine", "I9", note="value embeddings over one-hot fields")
def factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(survey(spark, sf_dir))
    spec = M.MemberSpec("fm", "factorization", ("age",), ("class", "r6", "r1", "r7"), {"factorSize": 8, "maxIter": 30, "stepSize": 0.1}, SEED)
    text = rows.withColumns({c: F.col(c).cast("string") for c in ("r6", "r1", "r7")})
    scored = M.score(M.fit_member(text.where(is_train()), spec), text.where(~is_train()), spec, ["id", "label"])
    return auc(scored, "p", "label")


@query("segment_models", "I12", note="one model per class, class column removed, pooled AUC and AUC per segment")
def segment_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = replace(LOGISTIC, categorical=("class", "travel_type"))
    pooled = fitted(M.segment_models(_folds(spark, sf_dir), spec, "class", ["Business", "Eco", "Eco Plus"], "fold", FOLDS), "segments")
    both = pooled.select("segment", "label", "p").unionByName(pooled.select(F.lit("pooled").alias("segment"), "label", "p"))
    return auc(both, "p", "label", by=["segment"])


LINEAR = replace(LOGISTIC, numeric=("r6", "age"), categorical=())  # leaves something for the trees to learn
RESIDUAL = M.MemberSpec("residual", "histogram", CORE, ("class",), {"maxIter": 10, "maxDepth": 4, "stepSize": 0.3}, SEED)


@query("two_stage_margin_boosting", "I13", note="linear margin first, log-loss boosting that starts at it")
def two_stage_margin_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fitted(M.margin_boosting(_folds(spark, sf_dir), LINEAR, RESIDUAL, "fold", FOLDS)[0], "margin")
    both = scored.select(F.lit("linear").alias("stage"), "label", F.col("p_linear").alias("p")).unionByName(scored.select(F.lit("boosted").alias("stage"), "label", "p"))
    return auc(both, "p", "label", by=["stage"])


@query(
    "margin_boosting_facts", "I13",
    sql=survey_sql("select r.rounds, count(*) as n_rows, count(distinct tr.id) as n_ids, true as in_unit, r.rounds = 0 as equals_linear, r.rounds > 0 as loss_falls_every_round, r.rounds > 0 as better_out_of_fold from tr, (values (0), (10)) r(rounds) group by r.rounds", tr=TRAIN),
    note="with no rounds the linear stage itself; else the fit loss falls every round and the held-out loss is lower",
)
def margin_boosting_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, parts = _folds(spark, sf_dir), None
    for rounds in (0, 10):
        trees = replace(RESIDUAL, params={**RESIDUAL.params, "maxIter": rounds})
        scored, models = M.margin_boosting(frame, LINEAR, trees, "fold", FOLDS)
        falls = rounds > 0 and all(b[0] < a[0] for m in models for a, b in zip(m.losses, m.losses[1:]))

        def loss(p: str):
            return F.avg(-F.ln(F.when(F.col("label") == 1, F.col(p)).otherwise(1 - F.col(p))))

        part = scored.agg(
            F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.bool_and(F.col("p").between(0, 1)).alias("in_unit"),
            (F.max(F.abs(F.col("p") - F.col("p_linear"))) < 1e-9).alias("equals_linear"), F.lit(falls).alias("loss_falls_every_round"),
            (loss("p") < loss("p_linear") - 1e-9).alias("better_out_of_fold"),
        ).select(F.lit(rounds).alias("rounds"), "*")
        parts = part if parts is None else parts.unionByName(part)
    return parts


AUX_TARGETS = RAW_FEATURES
AUX_PARAMS = {"numTrees": 5, "maxDepth": 4}


@query("auxiliary_expectations", "I14", note="own-value probability, expected value and log-probability sum from full-train models")
def auxiliary_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(survey(spark, sf_dir).select("id", *RAW_FEATURES))
    return M.expectation_models(rows.where(is_train()), rows.where(~is_train()), AUX_TARGETS, NUMERIC, CATEGORICAL, SEED, ["id"], AUX_PARAMS)


@query("auxiliary_expectations_oof", "I15", note="the same by folds for train rows, fixed column order")
def auxiliary_expectations_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.oof_expectations(_folds(spark, sf_dir), AUX_TARGETS, NUMERIC, CATEGORICAL, "fold", FOLDS, SEED, ["id"], AUX_PARAMS)


@query("column_predictability", "I17", note="accuracy of predicting each column from the others")
def column_predictability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(survey(spark, sf_dir).select("id", *RAW_FEATURES))
    table = M.expectation_models(rows.where(is_train()), rows.where(~is_train()), AUX_TARGETS, NUMERIC, CATEGORICAL, SEED, ["id"], AUX_PARAMS)
    return table.agg(*[F.avg(f"aux_hit_{t}").alias(t) for t in AUX_TARGETS]).unpivot([], AUX_TARGETS, "feature", "accuracy")


@query("cross_validated_member", "I18", note="5 folds, out-of-fold scores and fold-averaged scores of new rows")
def cross_validated_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = fitted(M.cross_validate(_folded(spark, sf_dir), BOOSTED, "fold", FOLDS, "id", _score_rows(spark, sf_dir)), "cv")
    oof = predictions.where("split = 'train'").select("id", "member", "split", "p")
    return oof.unionByName(M.averaged_scores(predictions).select("id", "member", F.lit("score").alias("split"), "p"))


@query(
    "resumable_folds", "I20",
    sql=survey_sql(f"select run, folds_fitted, n_rows from (values ('first', {FOLDS}), ('again', 0), ('changed', {FOLDS})) r(run, folds_fitted), (select count(*) as n_rows from tr) n", tr=TRAIN),
    note="second run finds every fold and fits none; a changed spec fits all",
)
def resumable_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, frame = scratch_path(spark, "resumable"), _folds(spark, sf_dir)
    rows = []
    for run, spec in [("first", LOGISTIC), ("again", LOGISTIC), ("changed", replace(LOGISTIC, params={"regParam": 0.1}))]:
        predictions, fitted_now = M.resumable_cross_validate(frame, spec, "fold", FOLDS, root)
        rows.append((run, len(fitted_now), predictions.count()))
    return spark.createDataFrame(rows, "run string, folds_fitted int, n_rows bigint")


@query(
    "cross_validated_member_facts", "I18",
    sql=survey_sql(
        "select 'score' as split, count(*) as n_rows, count(distinct id) as n_ids, true as in_unit from survey where id % 10 >= 7 union all select 'train', count(*), count(distinct id), true from tr",
        tr=TRAIN,
    ),
    note="each labelled row scored once, each new row once after averaging",
)
def cross_validated_member_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cross_validated_member(spark, sf_dir)
    return found.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.bool_and(F.col("p").between(0, 1)).alias("in_unit"))


ENCODED = (("r6",), ("o_custkey",), ("r1", "r6"), ("class", "travel_type"))
AUTO_ENCODED = (("class",), ("o_custkey",))


def _encoder_sql() -> str:
    """Every value from the sums it may use: those of all fit rows, for fit rows without their own inner fold."""
    ctes = {
        "b": f"select *, id % 10 < 7 as train, {hash_fold_sql()} as cell from survey",
        "al": "select cast(sum(label) as double) as s, count(*) as n from b where train",
        "ce": "select cell, cast(sum(label) as double) as s, count(*) as n from b where train group by cell",
        "pri": "select b.id, (al.s - case when b.train then ce.s else 0 end) / (al.n - case when b.train then ce.n else 0 end) as pr from b, al, ce where b.cell = ce.cell",
    }
    columns, joins = [], []
    for auto, sets in ((False, ENCODED), (True, AUTO_ENCODED)):
        for keys in sets:
            name = encoded_name(list(keys), auto)
            kk = ", ".join(keys)
            ctes[f"w_{name}"] = f"select {kk}, cast(sum(label) as double) as s, count(*) as n from b where train group by {kk}"
            ctes[f"i_{name}"] = f"select {kk}, cell, cast(sum(label) as double) as s, count(*) as n from b where train group by {kk}, cell"
            on = " and ".join(f"x.{k} = b.{k}" for k in keys)
            joins.append(f"left join w_{name} on {on.replace('x.', f'w_{name}.')}")
            joins.append(f"left join i_{name} on b.train and i_{name}.cell = b.cell and {on.replace('x.', f'i_{name}.')}")
            n, t = (f"(coalesce(w_{name}.{c}, 0) - coalesce(i_{name}.{c}, 0))" for c in ("n", "s"))
            if auto:
                mine, mean = f"{n} * pr * (1 - pr)", f"({t} / {n})"
                weight = f"coalesce({mine} / nullif({mine} + {mean} * (1 - {mean}), 0), 1)"
                value = f"case when {n} = 0 then pr else {weight} * {mean} + (1 - {weight}) * pr end"
            else:
                value = f"({t} + pr * {SMOOTHING}) / ({n} + {SMOOTHING})"
            columns.append(f"{rd(value, 9)} as {name}")
    return survey_sql(f"select b.id, {', '.join(columns)} from b join pri on pri.id = b.id {' '.join(joins)}", **ctes)


def _encoders(fit: DataFrame) -> list:
    return [FoldTargetEncoder(keySets=sets, auto=auto, seed=SEED, smoothing=SMOOTHING).fit(fit) for sets, auto in ((ENCODED, False), (AUTO_ENCODED, True))]


@query("in_fold_encoder", "I18", "G4", "G5", "G7", sql=_encoder_sql(), note="pipeline stage: fit rows cross-fitted over inner folds, other rows by the full map")
def in_fold_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(survey(spark, sf_dir).withColumn(FIT_ROWS, is_train()))
    names = []
    for model in _encoders(rows.where(is_train())):
        rows = model.transform(rows)
        names += model.outputs()
    return rows.select("id", *[r(n, 9).alias(n) for n in names])


@query(
    "in_fold_encoder_leak", "I18", "G4",
    sql=survey_sql("select encoding, false as own_value_moved, true as others_moved from (values " + ", ".join(f"('{encoded_name(list(k), a)}')" for a, sets in ((False, ENCODED), (True, AUTO_ENCODED)) for k in sets) + ") v(encoding)"),
    note="one label flipped: the row's own values stay, values of other rows move",
)
def in_fold_encoder_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = dealt(survey(spark, sf_dir).where(is_train()).withColumn(FIT_ROWS, F.lit(True)))
    own = F.col("id") == train.agg(F.min("id")).first()[0]
    flipped = train.withColumn("label", F.when(own, 1 - F.col("label")).otherwise(F.col("label")))
    before, after, names = train, flipped, []
    for a, b in zip(_encoders(train), _encoders(flipped)):
        before, after = a.transform(before), b.transform(after)
        names += a.outputs()
    both = before.select("id", own.alias("own"), *names).join(after.select("id", *[F.col(n).alias(f"_{n}") for n in names]), "id")
    moved = [F.struct(F.lit(n).alias("encoding"), (F.col(n) != F.col(f"_{n}")).alias("moved")) for n in names]
    long = both.select("own", F.inline(F.array(*moved)))
    return long.groupBy("encoding").agg(F.bool_or(F.col("own") & F.col("moved")).alias("own_value_moved"), F.bool_or(~F.col("own") & F.col("moved")).alias("others_moved"))


@query(
    "in_fold_member", "I18", "G5", "G7",
    sql=survey_sql("select split, n_rows, n_ids, true as in_unit, true as reloaded_alike from (select 'score' as split, count(*) as n_rows, count(distinct id) as n_ids from survey where id % 10 >= 7 union all select 'train', count(*), count(distinct id) from tr) x", tr=TRAIN),
    note="member whose encoders are fitted in every fold; the saved pipeline scores new rows alike",
)
def in_fold_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml import PipelineModel

    columns = list(dict.fromkeys([*CORE, *CATEGORICAL, "o_custkey"]))
    frame, new, path = _folded(spark, sf_dir, columns), dealt(_score_rows(spark, sf_dir)), scratch_path(spark, "encoded")
    spec = replace(LOGISTIC, name="encoded", encoded=ENCODED, auto_encoded=AUTO_ENCODED)
    found = fitted(M.cross_validate(frame, spec, "fold", FOLDS, "id", new), "cv")
    means = found.where("split = 'train'").select("id", "split", "p").unionByName(M.averaged_scores(found).select("id", F.lit("score").alias("split"), "p"))
    model = M.fit_member(frame, spec)
    model.write().overwrite().save(path)
    one, two = (M.score(m, new, spec, ["id"]) for m in (model, PipelineModel.load(path)))
    differ = one.join(two.select("id", F.col("p").alias("q")), "id").where("p <> q").count()
    return means.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.bool_and(F.col("p").between(0, 1)).alias("in_unit"), F.lit(differ == 0).alias("reloaded_alike")
    )


@query("permutation_importance", "I21", note="AUC lost per shuffled column; the shuffle is a join of two hash orders")
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(survey(spark, sf_dir))
    model = M.fit_member(rows.where(is_train()), LOGISTIC)
    return M.permutation_importance(model, rows.where(~is_train()), LOGISTIC, LOGISTIC.features, 5, SEED)


@query("l1_feature_selection", "I22", note="penalty sweep with refit on the kept columns")
def l1_feature_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(survey(spark, sf_dir))
    spec = M.MemberSpec("l1", "logistic", tuple(NUMERIC), (), {"maxIter": 20}, SEED)
    return M.l1_selection(rows.where(is_train()), rows.where(~is_train()), spec, [0.001, 0.003, 0.01, 0.03, 0.05, 0.1])


@query("feature_ablation", "I23", note="base, base plus each group, all groups")
def feature_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _folds(spark, sf_dir)
    added = D.add_derived(frame, ["mean_service_rating", "age_squared", "any_delay"])
    base = replace(LOGISTIC, numeric=("r6", "age"), categorical=())
    return M.feature_ablation(added, base, {"ratings": ("r1", "r7", "r8"), "derived": ("mean_service_rating", "age_squared", "any_delay")}, "fold", FOLDS)


@query("random_search_with_confirm", "I25", note="small-budget draws, best ones refitted at full budget")
def random_search_with_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(survey(spark, sf_dir))
    ranges = {"regParam": [0.0, 0.001, 0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]}
    return M.random_search(rows.where(is_train()), rows.where(~is_train()), LOGISTIC, ranges, 40, 5, {"maxIter": 3}, {"maxIter": 20}, SEED)


@query("budgeted_search", "I26", note="a budget of 30 trials, ranked trial table")
def budgeted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(survey(spark, sf_dir))
    ranges = {"regParam": [0.0, 0.001, 0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]}
    return M.random_search(rows.where(is_train()), rows.where(~is_train()), LOGISTIC, ranges, 30, 0, {"maxIter": 10}, {}, SEED)


SEARCH = {"regParam": [0.001, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]}


def _distinct_draws(n: int) -> int:
    return len({tuple(sorted(d.items())) for d in M.random_parameters(SEARCH, n, SEED)})


@query(
    "resumed_search", "I25", "I26",
    sql=plain_sql(
        f"select run, cast(n_trials as bigint) as n_trials, fits, true as equals_uninterrupted from (values ('interrupted', 4, {_distinct_draws(4)}), "
        f"('resumed', 8, {_distinct_draws(8) - _distinct_draws(4)}), ('again', 8, 0)) r(run, n_trials, fits)"
    ),
    note="a search stopped after four trials goes on from its ledger and ends with the ranking of an uninterrupted one",
)
def resumed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ledger = dealt(survey(spark, sf_dir).select("id", "label", *LOGISTIC.features)), scratch_path(spark, "ledger")
    given = (rows.where(is_train()), rows.where(~is_train()), LOGISTIC, SEARCH)
    whole = M.random_search(*given, 8, 0, {"maxIter": 3}, {}, SEED).collect()  # one row per trial
    out = []
    for run, n in (("interrupted", 4), ("resumed", 8), ("again", 8)):
        table, fits = M.searched(*given, n, 0, {"maxIter": 3}, {}, SEED, ledger)
        found = table.collect()
        out.append((run, len(found), fits, {r.trial: r.auc for r in found} == {r.trial: r.auc for r in whole if r.trial < n}))
    return spark.createDataFrame(out, "run string, n_trials bigint, fits int, equals_uninterrupted boolean")


@query("ordinal_model", "I29", note="cumulative binary models, ranked by expected level")
def ordinal_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(survey(spark, sf_dir))
    level = D.ordinal_bin(F.coalesce(mean_rating(RATINGS), F.lit(2.5))) - 1
    scored = M.ordinal_scores(rows.where(is_train()), rows.where(~is_train()), replace(LOGISTIC, params={"maxIter": 10}), level, 3, ["id", "label"])
    return auc(scored, "p", "label")


@query("regression_as_ranker", "I30", note="AUC of a regression on a continuous proxy")
def regression_as_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import LinearRegression

    rows = fitted(M.numeric_input(survey(spark, sf_dir), NUMERIC).withColumn("proxy", F.coalesce(mean_rating(RATINGS), F.lit(2.5)) / 5))
    spec = M.MemberSpec("proxy", "logistic", CORE, (), {}, SEED)
    model = Pipeline(stages=[*M.preparation(spec), LinearRegression(featuresCol="features", labelCol="proxy")]).fit(rows.where(is_train()))
    return auc(model.transform(rows.where(~is_train())), "prediction", "label")


def _validated(frame: DataFrame, to_score: DataFrame) -> DataFrame:
    """Out-of-fold scores of the frame and its models' scores of the new rows."""
    return fitted(M.cross_validate(frame, LOGISTIC, "fold", FOLDS, "id", to_score), "cv")


def _averaged(found: DataFrame) -> DataFrame:
    return M.averaged_scores(found).select("id", "p")


def _confident(scores: DataFrame, to_score: DataFrame, high: float, low: float) -> DataFrame:
    return fitted(Ps.select_confident(to_score.drop("label").join(scores, "id"), "p", high, low).withColumn("fold", F.lit(-1)), "confident")


@query("pseudo_label_retrain", "I32", note="union with confident rows, scored on genuine rows only, kept when better")
def pseudo_label_retrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, to_score = _folds(spark, sf_dir), dealt(_score_rows(spark, sf_dir))
    found = _validated(frame, to_score)  # the plain member, and what the new rows are chosen by
    union = dealt(Ps.augment(frame, _confident(_averaged(found), to_score, 0.9, 0.05)), "augmented")
    parts = [p.withColumn("member", F.lit(n)) for n, p in (("plain", found.where("split = 'train'")), ("pseudo", M.cross_validate(union, LOGISTIC, "fold", FOLDS)))]
    table = M.member_auc(parts[0].unionByName(parts[1])).withColumn("n_fit", F.when(F.col("member") == "plain", F.lit(frame.count())).otherwise(F.lit(union.count())))
    plain, pseudo = (table.where(F.col("member") == n).select("auc").scalar() for n in ("plain", "pseudo"))
    return table.withColumn("kept", (F.col("member") == "pseudo") == (pseudo > plain))


@query("pseudo_label_rounds", "I33", note="two rounds x thresholds, gain over the plain member")
def pseudo_label_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = replace(LOGISTIC, kind="shared_logistic")
    used = {"id", "label", "fold", *spec.inputs}
    frame, to_score = (f.select(*[c for c in f.columns if c in used]) for f in (_folds(spark, sf_dir), _score_rows(spark, sf_dir)))
    to_score = dealt(to_score)
    start = M.cross_validate(frame, spec, "fold", FOLDS, "id", to_score)
    plain, scores = whole_auc(start, "p", "label"), fitted(_averaged(start), "scores")

    def rounds(high: float) -> list[tuple]:
        rows, chosen_by = [], scores
        for number in (1, 2):
            confident = _confident(chosen_by, to_score, high, 1 - high)
            current = Ps.augment(frame, confident).drop("is_pseudo")
            # the models that a round is judged by choose the rows of the next one
            validated = M.cross_validate(current, spec, "fold", FOLDS, "id", to_score if number == 1 else None)
            found, chosen_by = whole_auc(validated, "p", "label"), _averaged(validated)
            rows.append((number, high, confident.count(), found, found - plain))
        return rows

    thresholds = [0.85, 0.9, 0.95]
    rows = [row for found in M.together(rounds, thresholds, spark, len(thresholds)) for row in found]
    return spark.createDataFrame(rows, "round int, high double, n_pseudo bigint, auc double, gain double")


@query("second_table_teacher", "F9", note="model fitted on the second table only, its logit as a column")
def second_table_teacher(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = M.fit_member(dealt(second_survey(spark, sf_dir).select("id", "label", *BOOSTED.features)), BOOSTED)
    return M.score(model, survey(spark, sf_dir).where(is_train()), BOOSTED, ["id"]).select("id", logit("p").alias("teacher_logit"))


@query("second_table_expectations", "F10", note="column predictors fitted on the second table only")
def second_table_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = survey(spark, sf_dir).where(is_train()).select("id", *RAW_FEATURES), dealt(second_survey(spark, sf_dir).select("id", *RAW_FEATURES))
    return M.expectation_models(second, first, AUX_TARGETS, NUMERIC, CATEGORICAL, SEED, ["id"], AUX_PARAMS)


@query("model_bundle", "A14", note="pipeline, contract and metrics saved, loaded and scored again")
def model_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = dealt(survey(spark, sf_dir)), scratch_path(spark, "bundle")
    train, held = rows.where(is_train()), rows.where(~is_train())
    model = M.fit_member(train, LOGISTIC)
    metrics = auc(M.score(model, held, LOGISTIC, ["label"]), "p", "label")
    sinks.save_bundle(model, build_contract(train, LOGISTIC.features, list(LOGISTIC.categorical)), metrics, path)
    loaded, contract, stored = sinks.load_bundle(spark, path)
    again = auc(M.score(loaded, held, LOGISTIC, ["label"]), "p", "label").select(F.col("auc").alias("auc_after_load"))
    return stored.withColumns({"auc_after_load": again.scalar(), "features": contract.agg(F.count("*")).scalar()})


@query("refit_on_all_rows", "A15", note="second fit over every labelled row, stored and used for new rows")
def refit_on_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = dealt(survey(spark, sf_dir)), scratch_path(spark, "refit")
    M.fit_member(rows.where(is_train()), BOOSTED).write().overwrite().save(path)
    from pyspark.ml import PipelineModel

    return M.score(PipelineModel.load(path), rows.where(~is_train()), BOOSTED, ["id"])


@query("feature_set_exhaustion", "K15", note="same model and folds on growing column sets")
def feature_set_exhaustion(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = {"one rating": ("r6",), "ratings": tuple(RATINGS), "numeric": tuple(NUMERIC)}
    specs = [replace(LOGISTIC, name=n, numeric=c, categorical=()) for n, c in sets.items()]
    specs.append(replace(LOGISTIC, name="all raw", numeric=tuple(NUMERIC), categorical=tuple(CATEGORICAL)))
    table = M.compare_members(_folds(spark, sf_dir), specs, "fold", FOLDS)
    return table.withColumn("delta", F.col("auc") - table.where("member = 'one rating'").select("auc").scalar())


@query("clip_and_drop_sensitivity", "K16", note="raw, clipped and filtered training rows, same held-out rows")
def clip_and_drop_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(survey(spark, sf_dir))
    train, held = rows.where(is_train()), rows.where(~is_train())
    spec = replace(LOGISTIC, numeric=(*CORE, "arr_delay", "distance"))
    frames = {
        "raw": train, "clipped": fitted(D.percentile_clip(train, train, CONTINUOUS, 0.01, 0.99)),
        "filtered": D.hard_cap_filter(train, {"dep_delay": 12, "arr_delay": 10}),
    }
    parts = None
    for name, frame in frames.items():
        part = M.score(M.fit_member(frame, spec), held, spec, ["label"]).withColumn("training", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    return auc(parts, "p", "label", by=["training"])

