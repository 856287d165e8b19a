"""Facts about fitted models that SQL can state: row counts, label counts, ranges, orders, and what must beat what.

A fit itself has no SQL twin; what it must satisfy on any table has. Every query runs the registered one it speaks of.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.ranks import auc
from tabloom.plans import models, profiles, stacks
from tabloom.plans.common import CATEGORICAL, RATINGS, TRAIN, auc_sql, unpivot_sql
from tabloom.plans.member_data import MEMBER_SQL, MEMBERS, member_scores
from tabloom.plans.registry import query, survey_sql
from tabloom.sources.survey import RAW_FEATURES, is_train, survey

HELD = "select * from survey where id % 10 >= 7"


def facts(name: str, *ops: str, sql: str, note: str) -> Callable:
    return query(f"{name}_facts", *ops, sql=sql, note=note)


def _label_counts(where: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    group = f" group by {by}" if by else ""
    return f"select {key}cast(sum(label) as bigint) as n_pos, cast(sum(1 - label) as bigint) as n_neg from {where}{group}"


def _beats_column(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Label counts, and whether the AUC is above that of r6, the strongest single column, on the same rows."""
    return found.select("n_pos", "n_neg", (F.col("auc") > auc(rows, "r6", "label").select("auc").scalar()).alias("beats_column"))


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey(spark, sf_dir).where(~is_train())


BEATS = survey_sql(f"select *, true as beats_column from ({_label_counts('te')}) x", te=HELD)

for _name, _ops, _fn in (
    ("boosted_trees", ("I6", "H7"), models.boosted_trees_early_stop), ("factorization_machine", ("I9",), models.factorization_machine),
):

    @facts(_name, *_ops, sql=BEATS, note="label counts of the held-out rows; better than the strongest single column")
    def _beats(spark: SparkSession, sf_dir: str, fn: Callable = _fn) -> DataFrame:
        return _beats_column(fn(spark, sf_dir), _held(spark, sf_dir))


RANKS = survey_sql(f"select *, true as better_than_chance from ({_label_counts('te')}) x", te=HELD)

for _name, _op, _fn in (("ordinal_model", "I29", models.ordinal_model), ("regression_as_ranker", "I30", models.regression_as_ranker)):

    @facts(_name, _op, sql=RANKS, note="label counts of the held-out rows; the predicted mean rating ranks the label better than chance")
    def _ranks(spark: SparkSession, sf_dir: str, fn: Callable = _fn) -> DataFrame:
        return fn(spark, sf_dir).select("n_pos", "n_neg", (F.col("auc") > 0.5).alias("better_than_chance"))


@facts(
    "model_registry", "I1", "I24",
    sql=survey_sql("select kind, true as better_than_chance, true as in_unit from (values ('logistic'), ('tree'), ('forest'), ('boosted'), ('perceptron'), ('factorization'), ('histogram')) v(kind)"),
    note="every registered estimator ranks better than chance",
)
def model_registry_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.model_registry_comparison(spark, sf_dir)
    return found.select("kind", (F.col("auc") > 0.6).alias("better_than_chance"), (F.col("auc").between(0, 1) & F.col("accuracy").between(0, 1)).alias("in_unit"))


def _strongest(table: DataFrame, by: Column, name: str = "feature") -> Column:
    """Name of the raw column behind the largest value."""
    return F.regexp_replace(F.max_by(name, by), "^_i_", "")


@facts(
    "logistic_coefficients", "I4",
    sql=survey_sql("select 'r6' as strongest_rating, true as positive, cast(17 + sum(n) as bigint) as n_terms from (" + " union all ".join(f"select count(distinct {c}) + 1 as n from tr" for c in CATEGORICAL) + ") x", tr=TRAIN),
    note="one term per number and per level (and one for unseen levels); the strongest rating is the one with the largest weight in the label",
)
def logistic_coefficients_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.logistic_coefficients(spark, sf_dir)
    rating = F.col("feature").rlike("^_i_r[0-9]+$")
    top = F.max_by(F.struct("feature", "coefficient"), F.when(rating, F.abs("coefficient")))
    return found.agg(top.alias("top"), F.count("*").alias("n")).select(
        F.regexp_replace("top.feature", "^_i_", "").alias("strongest_rating"), (F.col("top.coefficient") > 0).alias("positive"), F.col("n").cast("long").alias("n_terms")
    )


@facts(
    "forest_importance", "I5", sql=survey_sql("select model, 'r6' as strongest, true as sums_to_one, true as none_negative from (values ('tree'), ('forest')) v(model)"),
    note="impurity importances are shares",
)
def forest_importance_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.forest_importance(spark, sf_dir)
    return found.groupBy("model").agg(
        _strongest(found, F.col("importance")).alias("strongest"), (F.abs(F.sum("importance") - 1) < 1e-6).alias("sums_to_one"), F.bool_and(F.col("importance") >= 0).alias("none_negative")
    )


@facts(
    "perceptron_seed_spread", "I7", "I8",
    sql=survey_sql("select layout, true as ordered, true as spread_fits, true as average_not_worst from (values " + ", ".join(f"('{'-'.join(map(str, x))}')" for x in models.LAYOUTS) + ") v(layout)"),
    note="best, mean and worst seed in order; the seed average is not below the worst seed",
)
def perceptron_seed_spread_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.perceptron_seed_spread(spark, sf_dir).select(
        "layout", ((F.col("worst") <= F.col("mean")) & (F.col("mean") <= F.col("best"))).alias("ordered"),
        (F.abs(F.col("best") - F.col("worst") - F.col("spread")) < 1e-12).alias("spread_fits"), (F.col("averaged") >= F.col("worst")).alias("average_not_worst"),
    )


@facts(
    "segment_models", "I12", sql=survey_sql(f"select *, true as better_than_chance from ({_label_counts('tr', 'class').replace('class, ', 'class as segment, ', 1)} union all select 'pooled', * from ({_label_counts('tr')}) p) x", tr=TRAIN),
    note="every row scored once, in its segment",
)
def segment_models_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.segment_models(spark, sf_dir).select("segment", "n_pos", "n_neg", (F.col("auc") > 0.6).alias("better_than_chance"))


@facts(
    "two_stage_margin_boosting", "I13",
    sql=survey_sql(f"select stage, n_pos, n_neg, stage = 'boosted' as better_stage from ({_label_counts('tr')}) x, (values ('linear'), ('boosted')) s(stage)", tr=TRAIN),
    note="every labelled row scored out of fold; the boosted stage ranks better than the linear one it starts at",
)
def two_stage_margin_boosting_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.two_stage_margin_boosting(spark, sf_dir).collect()  # two rows
    best = max(found, key=lambda r: r.auc).stage
    return spark.createDataFrame([(r.stage, r.n_pos, r.n_neg, r.stage == best) for r in found], "stage string, n_pos bigint, n_neg bigint, better_stage boolean")


AUX_FACTS = "select {rows} as n_rows, {rows} as n_ids, true as probabilities_in_unit, true as log_sum_fits, {missing} as missing_arrivals"


def _aux_facts(table: DataFrame) -> DataFrame:
    p = [F.col(f"aux_p_{t}") for t in RAW_FEATURES]
    total = sum((F.coalesce(F.ln(F.when(x.isNotNull(), F.greatest(x, F.lit(1e-6)))), F.lit(0.0)) for x in p), F.lit(0.0))
    inside = F.lit(True)
    for x in p:
        inside = inside & (x.isNull() | x.between(0, 1 + 1e-9))
    return table.agg(
        F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.bool_and(inside).alias("probabilities_in_unit"),
        (F.max(F.abs(F.col("aux_sum_logp") - total)) < 1e-6).alias("log_sum_fits"), F.count_if(F.col("aux_p_arr_delay").isNull()).alias("missing_arrivals"),
    )


for _name, _op, _fn, _where in (
    ("auxiliary_expectations", "I14", models.auxiliary_expectations, "id % 10 >= 7"), ("auxiliary_expectations_oof", "I15", models.auxiliary_expectations_oof, "id % 10 < 7"),
    ("second_table_expectations", "F10", models.second_table_expectations, "id % 10 < 7"),
):

    @facts(
        _name, _op, sql=survey_sql(AUX_FACTS.format(rows="count(*)", missing="cast(sum(case when arr_delay is null then 1 else 0 end) as bigint)") + f" from survey where {_where}"),
        note="each row once, probabilities, the log sum, and no own probability for a missing value",
    )
    def _aux(spark: SparkSession, sf_dir: str, fn: Callable = _fn) -> DataFrame:
        return _aux_facts(fn(spark, sf_dir))


@facts(
    "column_predictability", "I17",
    sql=survey_sql(
        f"select feature, true as in_unit, case when starts_with(feature, 'r') then true end as near_majority from ({unpivot_sql('survey', RAW_FEATURES, cast='varchar')}) x group by feature",
    ),
    note="accuracies are shares; a rating is predicted at least nearly as well as by its most frequent value",
)
def column_predictability_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _held(spark, sf_dir).select(RATINGS).unpivot([], RATINGS, "feature", "v").groupBy("feature", "v").count()
    majority = counts.groupBy("feature").agg((F.max("count") / F.sum("count")).alias("share"))
    found = models.column_predictability(spark, sf_dir).join(majority, "feature", "left")
    return found.select("feature", F.col("accuracy").between(0, 1).alias("in_unit"), (F.col("accuracy") > F.col("share") - 0.1).alias("near_majority"))


@facts(
    "permutation_importance", "I21", sql=survey_sql("select feature, feature = 'r6' as strongest from (values " + ", ".join(f"('{f}')" for f in models.LOGISTIC.features) + ") v(feature)"),
    note="every feature of the model; the strongest column loses most",
)
def permutation_importance_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.permutation_importance(spark, sf_dir).collect()  # one row per feature
    best = max(found, key=lambda r: r.mean_drop).feature
    return spark.createDataFrame([(r.feature, r.feature == best) for r in found], "feature string, strongest boolean")


@facts(
    "l1_feature_selection", "I22", sql=survey_sql("select 7 as n_penalties, 17 as kept_without_penalty, true as fewer_with_penalty, true as r6_stays"),
    note="a larger penalty never keeps more columns",
)
def l1_feature_selection_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sorted(models.l1_feature_selection(spark, sf_dir).collect(), key=lambda r: r.penalty)  # one row per penalty
    fewer = all(a.kept >= b.kept for a, b in zip(found, found[1:]))
    stays = all("r6" in r.features.split(",") for r in found if r.kept)
    return spark.createDataFrame([(len(found), found[0].kept, fewer, stays)], "n_penalties int, kept_without_penalty int, fewer_with_penalty boolean, r6_stays boolean")


@facts(
    "feature_ablation", "I23", sql=survey_sql("select variant, n_features, variant = 'base' as zero_delta, variant <> 'base' as helps from (values ('base', 2), ('+ratings', 5), ('+derived', 5), ('all', 8)) v(variant, n_features)"),
    note="columns per variant, deltas against the base; every added group carries signal",
)
def feature_ablation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.feature_ablation(spark, sf_dir)
    return found.select("variant", "n_features", (F.abs("delta") < 1e-12).alias("zero_delta"), (F.col("delta") > 1e-12).alias("helps"))


@facts(
    "random_search", "I25", sql=survey_sql("select stage, n_trials, true as better_than_chance, true as confirmed_were_best from (values ('search', cast(40 as bigint)), ('confirm', cast(5 as bigint))) v(stage, n_trials)"),
    note="number of trials; the confirmed ones led the search",
)
def random_search_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.random_search_with_confirm(spark, sf_dir).collect()  # one row per trial
    search = {r.trial: r.auc for r in found if r.stage == "search"}
    confirm = [r.trial for r in found if r.stage == "confirm"]
    best = min(search[t] for t in confirm) >= sorted(search.values(), reverse=True)[len(confirm) - 1]
    rows = [(s, sum(r.stage == s for r in found), all(r.auc > 0.6 for r in found if r.stage == s), best) for s in ("search", "confirm")]
    return spark.createDataFrame(rows, "stage string, n_trials bigint, better_than_chance boolean, confirmed_were_best boolean")


@facts("budgeted_search", "I26", sql=survey_sql("select cast(30 as bigint) as n_trials, cast(30 as bigint) as n_distinct, true as better_than_chance"), note="as many trials as the budget says")
def budgeted_search_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.budgeted_search(spark, sf_dir).agg(F.count("*").alias("n_trials"), F.count_distinct("trial").alias("n_distinct"), F.bool_and(F.col("auc") > 0.6).alias("better_than_chance"))


@facts(
    "pseudo_label_retrain", "I32", sql=survey_sql(f"select member, n_pos, n_neg, true as fit_rows, cast(1 as bigint) as n_kept from ({_label_counts('tr')}) x, (values ('plain'), ('pseudo')) m(member)", tr=TRAIN),
    note="both members scored on the genuine rows only; the union has more fit rows; at most one decision",
)
def pseudo_label_retrain_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.pseudo_label_retrain(spark, sf_dir).collect()  # two rows
    size = {r.member: r.n_fit for r in found}
    better = max(found, key=lambda r: (r.auc, r.member == "plain")).member
    rows = [(r.member, r.n_pos, r.n_neg, size["pseudo"] >= size["plain"] == r.n_pos + r.n_neg, sum(q.kept == (q.member == better) for q in found) // 2) for r in found]
    return spark.createDataFrame(rows, "member string, n_pos bigint, n_neg bigint, fit_rows boolean, n_kept bigint")


@facts(
    "pseudo_label_rounds", "I33", sql=survey_sql("select round, high, true as better_than_chance from (values (1), (2)) r(round), (values (cast(0.85 as double)), (cast(0.9 as double)), (cast(0.95 as double))) h(high)"),
    note="every round at every threshold",
)
def pseudo_label_rounds_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.pseudo_label_rounds(spark, sf_dir).select("round", "high", (F.col("auc") > 0.6).alias("better_than_chance"))


@facts(
    "second_table_teacher", "F9", sql=survey_sql("select count(*) as n_rows, count(distinct id) as n_ids, true as finite, true as ranks from tr", tr=TRAIN),
    note="a logit for every row of the first table; it ranks that table's labels better than chance",
)
def second_table_teacher_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = models.second_table_teacher(spark, sf_dir)
    ranked = auc(table.join(survey(spark, sf_dir).select("id", "label"), "id"), "teacher_logit", "label").select("auc").scalar()
    return table.agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.bool_and(F.abs("teacher_logit") < 50).alias("finite")).withColumn("ranks", ranked > 0.6)


@facts("model_bundle", "A14", sql=survey_sql(f"select *, true as same_after_load, cast({len(models.LOGISTIC.features)} as bigint) as features from ({_label_counts('te')}) x", te=HELD), note="the loaded bundle scores alike")
def model_bundle_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.model_bundle(spark, sf_dir).select("n_pos", "n_neg", (F.col("auc") == F.col("auc_after_load")).alias("same_after_load"), F.col("features").cast("long").alias("features"))


@facts("refit_on_all_rows", "A15", sql=survey_sql("select count(*) as n_rows, count(distinct id) as n_ids, true as in_unit from te", te=HELD), note="each new row scored once")
def refit_on_all_rows_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.refit_on_all_rows(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.bool_and(F.col("p").between(0, 1)).alias("in_unit"))


@facts(
    "feature_set_exhaustion", "K15", sql=survey_sql("select member, member = 'one rating' as zero_delta, member <> 'one rating' as helps from (values ('one rating'), ('ratings'), ('numeric'), ('all raw')) v(member)"),
    note="growing column sets, each better than the single rating",
)
def feature_set_exhaustion_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.feature_set_exhaustion(spark, sf_dir).select("member", (F.abs("delta") < 1e-12).alias("zero_delta"), (F.col("delta") > 1e-12).alias("helps"))


@facts(
    "clip_and_drop_sensitivity", "K16", sql=survey_sql(f"select training, x.*, true as better_than_chance from ({_label_counts('te')}) x, (values ('raw'), ('clipped'), ('filtered')) t(training)", te=HELD),
    note="the same held-out rows for every way of training",
)
def clip_and_drop_sensitivity_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.clip_and_drop_sensitivity(spark, sf_dir).select("training", "n_pos", "n_neg", (F.col("auc") > 0.6).alias("better_than_chance"))


# ---- blends and selections: what they reach is compared with the members' own AUCs, which SQL knows

BEST_MEMBER = "select max(auc) as best from (" + auc_sql("pred", "p", by=["member"]) + ") a"


def _best_member(spark: SparkSession, sf_dir: str) -> Column:
    return auc(member_scores(spark, sf_dir), "p", "label", by=["member"]).agg(F.max("auc")).scalar()


@facts(
    "nested_rank_blend", "J8", sql=survey_sql(f"select x.*, true as near_or_above_best_member, true as weights_sum_to_one from ({_label_counts('tr')}) x, ({BEST_MEMBER}) b where b.best > 0", **MEMBER_SQL),
    note="every row scored by weights of the other folds",
)
def nested_rank_blend_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stacks.nested_rank_blend(spark, sf_dir)
    total = sum((F.col(f"w_{m}") for m in MEMBERS), F.lit(0.0))
    return found.select("n_pos", "n_neg", (F.col("auc") > _best_member(spark, sf_dir) - 1e-3).alias("near_or_above_best_member"), (F.abs(total - 1) < 1e-9).alias("weights_sum_to_one"))


@facts(
    "coordinate_ascent_blend", "J9", sql=survey_sql(f"select cast({len(MEMBERS)} as bigint) as n_members, true as weights_sum_to_one, true as none_negative, true as better_than_chance"),
    note="weights are shares; scored on rows of the other half",
)
def coordinate_ascent_blend_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks.coordinate_ascent_blend(spark, sf_dir).agg(
        F.count("*").alias("n_members"), (F.abs(F.sum("weight") - 1) < 1e-9).alias("weights_sum_to_one"), F.bool_and(F.col("weight") >= 0).alias("none_negative"), (F.max("held_out_auc") > 0.6).alias("better_than_chance")
    )


@facts(
    "greedy_forward_selection", "J11",
    sql=survey_sql(f"select 1 as first_step, member as first_member, true as rises_every_step, true as no_repeats from (select arg_max(member, auc) as member from ({auc_sql('pred', 'p', by=['member'])}) a) x", **MEMBER_SQL),
    note="the strongest single member comes first, and every step adds",
)
def greedy_forward_selection_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trail = sorted(stacks.greedy_forward_selection(spark, sf_dir).collect(), key=lambda r: r.step)  # one row per member
    rises = all(a.auc < b.auc for a, b in zip(trail, trail[1:]))
    row = (min(1, len(trail)), trail[0].member, rises, len({r.member for r in trail}) == len(trail))
    return spark.createDataFrame([row], "first_step int, first_member string, rises_every_step boolean, no_repeats boolean")


@facts(
    "leave_group_out_stack", "J12", sql=survey_sql("select cast(3 as bigint) as n_stacks, true as all_members_lead, true as better_than_chance"),
    note="the stack of all members against the stacks without each group",
)
def leave_group_out_stack_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = {r.stack: r.auc for r in stacks.leave_group_out_stack(spark, sf_dir).collect()}  # one row per group and one for all
    whole = next(v for k, v in found.items() if k in ("all", "full"))
    return spark.createDataFrame([(len(found), whole >= max(found.values()) - 1e-4, min(found.values()) > 0.5)], "n_stacks bigint, all_members_lead boolean, better_than_chance boolean")


@facts(
    "latent_factor_profile", "C26", sql=survey_sql("select true as largest_share, true as shares_ordered, true as participation_in_range, true as aucs_in_unit"),
    note="the first of 13 components has at least its equal share; participation lies between 1 and 13",
)
def latent_factor_profile_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = len(RATINGS)
    return profiles.latent_factor_profile(spark, sf_dir).select(
        F.col("pc1_share").between(1 / k, 1).alias("largest_share"), ((F.col("top3_share") >= F.col("pc1_share")) & (F.col("top3_share") >= 3 / k) & (F.col("top3_share") <= 1)).alias("shares_ordered"),
        F.col("participation_ratio").between(1, k + 1e-9).alias("participation_in_range"), (F.col("pc1_auc").between(0, 1) & F.col("mean_auc").between(0, 1)).alias("aucs_in_unit"),
    )
