"""Queries for fitted blends and stacks over the stored prediction table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import stack as S
from tabloom.operators.lookup import fitted
from tabloom.operators.ranks import auc
from tabloom.operators.target_encode import apply_target_table, fit_target_table
from tabloom.plans.common import FOLDED, FOLDS, SMOOTHING
from tabloom.plans.member_data import MEMBERS
from tabloom.plans.registry import query, survey_sql
from tabloom.plans.scoring import wide_members
from tabloom.session import scratch_path
from tabloom.sources.sinks import wide_predictions, write_scored
from tabloom.sources.survey import is_train, survey

NAMES = list(MEMBERS)
KEEP = ["id", "label", "fold"]


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.logit_table(wide_members(spark, sf_dir), NAMES, KEEP)


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.plans.member_data import member_scores

    ranked = S.rank_members(member_scores(spark, sf_dir)).select(*KEEP, "member", F.col("rank").alias("p"))
    return fitted(wide_predictions(ranked, NAMES, KEEP), "ranks")


@query("newton_stacker", "J4", note="iterative; compared with spark.ml LogisticRegression in the tests")
def newton_stacker(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = S.newton_fits(_logits(spark, sf_dir), NAMES, "label", "fold", {"all": (None, NAMES)})["all"]
    rows = [(m, float(w)) for m, w in zip([*NAMES, "bias"], fit.weights)]
    return spark.createDataFrame(rows, "term string, weight double").withColumns(
        {"loss": F.lit(fit.loss), "gradient": F.lit(fit.gradient), "iterations": F.lit(fit.iterations), "n_rows": F.lit(fit.rows)}
    )


@query("nested_stack_scores", "J5", note="weights of the other folds; bias kept")
def nested_stack_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = S.nested_stack_scores(_logits(spark, sf_dir), NAMES, "label", "fold", FOLDS, {"all": NAMES}, ["id"])
    return scores


@query("rank_blend_weights", "J7", note="search on binned AUC, reported AUC exact")
def rank_blend_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = _ranks(spark, sf_dir)
    weights = S.coordinate_ascent(ranks, NAMES, "label", "fold", {"all": None})["all"]
    blended = ranks.select("label", S.blend_with(ranks, NAMES, "fold", {f: weights for f in range(FOLDS)}).alias("p"))
    found = auc(blended.withColumn("p", F.round("p", 9)), "p", "label").select("auc")
    return spark.createDataFrame([(m, float(w)) for m, w in zip(NAMES, weights)], "member string, weight double").withColumn("auc", found.scalar())


@query("nested_rank_blend", "J8", note="weights of the other folds, the exact AUC of the pooled scores, and the weights over all rows")
def nested_rank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = _ranks(spark, sf_dir)
    weights = S.coordinate_ascent(ranks, NAMES, "label", "fold", {f: f for f in range(FOLDS)})
    scored = ranks.select(*KEEP, F.round(S.blend_with(ranks, NAMES, "fold", weights), 9).alias("p"))
    every = S.coordinate_ascent(ranks, NAMES, "label", "fold", {"all": None})["all"]
    return auc(scored, "p", "label").withColumns({f"w_{m}": F.lit(float(w)) for m, w in zip(NAMES, every)})


@query("coordinate_ascent_blend", "J9", note="fit on one half of the folds, scored on the other rows")
def coordinate_ascent_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.operators.folds import hash_folds

    wide = fitted(hash_folds(wide_members(spark, sf_dir), "id", 2, "half", "half"), "halves")
    weights = S.coordinate_ascent(wide, NAMES, "label", "half", {0: 0}, grid=11)[0]
    scored = wide.where("half = 0").select("label", F.round(S.blend_with(wide, NAMES, "half", {0: weights, 1: weights}), 9).alias("p"))
    found = auc(scored, "p", "label").select("auc")
    return spark.createDataFrame([(m, float(w)) for m, w in zip(NAMES, weights)], "member string, weight double").withColumn("held_out_auc", found.scalar())


@query("greedy_forward_selection", "J11", note="all candidates and folds of a step share each Newton pass")
def greedy_forward_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    trail = S.greedy_selection(_logits(spark, sf_dir), NAMES, "label", "fold", FOLDS)
    return spark.createDataFrame(trail, "step int, member string, auc double")


@query("leave_group_out_stack", "J12", note="nested score without each group of members")
def leave_group_out_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = {"ratings": ["m_r6", "m_r1_r7"], "profile": ["m_class", "m_age"]}
    found = S.leave_group_out(_logits(spark, sf_dir), NAMES, "label", "fold", FOLDS, groups)
    return spark.createDataFrame(list(found.items()), "stack string, auc double")


def _score_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member logits of the rows to score, each member's rates fitted on all labelled rows."""
    rows = survey(spark, sf_dir)
    train = fitted(rows.where(is_train()).select("label", *sorted({c for keys in MEMBERS.values() for c in keys})), "train")
    scored = rows.where(~is_train()).select("id", *train.columns[1:])
    for member, keys in MEMBERS.items():
        table = fit_target_table(train, keys, "label", SMOOTHING, member)
        scored = apply_target_table(scored, table, train, keys, "label", member)
    return S.logit_table(scored, NAMES, ["id"])


@query("view_export", "J15", note="weights from out-of-fold logits, applied to the rows to score and checked against the table's own ids")
def view_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = S.newton_fits(_logits(spark, sf_dir), NAMES, "label", "fold", {"all": (None, NAMES)})["all"]
    new = _score_logits(spark, sf_dir)
    template = survey(spark, sf_dir).where(~is_train()).select("id", F.lit(0.0).alias("label"))
    path = scratch_path(spark, "view")
    write_scored(new.select("id", S.apply_stack(new, NAMES, fit).alias("label")), template, path)
    return spark.read.schema("id bigint, label double").csv(path, header=True)


# What SQL can state about fitted stacks: sizes, ids, ranges, convergence.


@query(
    "nested_stack_facts", "J4", "J5",
    sql=survey_sql(
        f"select count(*) as n_rows, count(distinct id) as n_ids, count(distinct fold) as n_folds, cast(sum(label) as bigint) as positives, true as in_unit, true as settled, cast({FOLDS} + 1 as bigint) as n_fits from tr",
        tr=FOLDED,
    ),
    note="each labelled row scored once by a settled fit of the other folds",
)
def nested_stack_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, fits = S.nested_stack_scores(_logits(spark, sf_dir), NAMES, "label", "fold", FOLDS, {"all": NAMES}, ["id"])
    settled = all(fit.gradient < 1e-8 for fit in fits.values())
    return scores.agg(
        F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.count_distinct("fold").alias("n_folds"),
        F.sum("label").cast("bigint").alias("positives"), F.bool_and(F.col("p").between(0, 1)).alias("in_unit"),
        F.lit(settled).alias("settled"), F.lit(len(fits)).cast("bigint").alias("n_fits"),
    )


@query(
    "rank_blend_facts", "J7",
    sql=survey_sql(f"select cast({len(NAMES)} as bigint) as n_members, true as none_negative, true as sum_is_one, true as not_below_uniform from (select 1)"),
    note="weights on the simplex, exact AUC at least that of equal weights",
)
def rank_blend_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = _ranks(spark, sf_dir)
    weights = S.coordinate_ascent(ranks, NAMES, "label", "fold", {"all": None})["all"]
    exact = S.exact_aucs(ranks, NAMES, "label", "fold", {"found": (None, weights), "uniform": (None, weights * 0 + 1 / len(NAMES))})
    row = (len(weights), bool((weights >= 0).all()), bool(abs(weights.sum() - 1) < 1e-9), exact["found"] >= exact["uniform"])
    return spark.createDataFrame([row], "n_members bigint, none_negative boolean, sum_is_one boolean, not_below_uniform boolean")


@query(
    "view_export_facts", "J15",
    sql=survey_sql("select count(*) as n_rows, cast(sum(id) as bigint) as id_sum, true as in_unit from survey where id % 10 >= 7"),
    note="exactly the rows to score are exported",
)
def view_export_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view_export(spark, sf_dir)
    return found.agg(F.count("*").alias("n_rows"), F.sum("id").alias("id_sum"), F.bool_and(F.col("label").between(0, 1)).alias("in_unit"))
