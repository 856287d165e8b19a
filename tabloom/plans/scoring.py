"""Queries for evaluation, error reading, blends and rank transforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import evaluate as E
from tabloom.operators import pseudo as Ps
from tabloom.operators import stack as S
from tabloom.operators.folds import stratified_folds
from tabloom.operators.lookup import fitted
from tabloom.operators.ranks import auc
from tabloom.operators.stats import all_pairs, correlation_matrix
from tabloom.operators.target_encode import apply_target_table, fit_target_table, oof_rates
from tabloom.plans.common import CATEGORICAL, FOLDED, FOLDS, NUMERIC, SMOOTHING, TRAIN, auc_sql, r, rd, strat_fold_sql
from tabloom.plans.member_data import MEMBER_SQL, MEMBERS, member_scores
from tabloom.plans.registry import plain_sql, query, survey_sql
from tabloom.sources.sinks import wide_predictions
from tabloom.sources.survey import is_train, survey
from tabloom.sources.tables import read_table


def _pred_sql(select: str, **ctes: str) -> str:
    return survey_sql(select, **MEMBER_SQL, **ctes)


def wide_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_predictions(member_scores(spark, sf_dir), list(MEMBERS), ["id", "label", "fold"])


def _one(spark: SparkSession, sf_dir: str, member: str = "m_r6") -> DataFrame:
    return member_scores(spark, sf_dir).where(F.col("member") == member)


def _auc_table(table: DataFrame) -> DataFrame:
    return table.withColumn("auc", r("auc"))


@query("roc_auc", "K1", sql=_pred_sql(f"select n_pos, n_neg, {rd('auc')} as auc from a", a=auc_sql("pred", "p", where="member = 'm_r1_r7'")))
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _auc_table(auc(_one(spark, sf_dir, "m_r1_r7"), "p", "label"))


@query("grouped_auc_by_member", "K2", sql=_pred_sql(f"select member, n_pos, n_neg, {rd('auc')} as auc from a", a=auc_sql("pred", "p", by=["member"])))
def grouped_auc_by_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _auc_table(auc(member_scores(spark, sf_dir), "p", "label", by=["member"]))


@query(
    "grouped_auc_by_segment", "K2",
    sql=_pred_sql(f"select class, member, n_pos, n_neg, {rd('auc')} as auc from a", seg="select p.*, s.class from pred p join survey s on s.id = p.id", a=auc_sql("seg", "p", by=["class", "member"])),
)
def grouped_auc_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = member_scores(spark, sf_dir).join(survey(spark, sf_dir).select("id", "class"), "id")
    return _auc_table(auc(rows, "p", "label", by=["class", "member"]))


@query("hard_labels", "K3", sql=_pred_sql("select id, member, case when p >= 0.4 then 1 else 0 end as predicted from pred"))
def hard_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return member_scores(spark, sf_dir).select("id", "member", E.hard_label("p", 0.4).alias("predicted"))


def _confusion_sql(source: str, flagged: str, label: str, by: str, no_flag: float = 0.0) -> str:
    g = f"{by}, " if by else ""
    return f"""select {g}tp, fp, fn, tn, {rd('(tp + tn) / cast(tp + fp + fn + tn as double)')} as accuracy, {rd(f'case when tp + fp = 0 then {no_flag} else tp / cast(tp + fp as double) end')} as precision,
        {rd('case when tp + fn = 0 then 0 else tp / cast(tp + fn as double) end')} as recall, {rd('case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / cast(2 * tp + fp + fn as double) end')} as f1
        from (select {g}count(*) filter (where {flagged} and {label} = 1) as tp, count(*) filter (where {flagged} and {label} <> 1) as fp,
        count(*) filter (where not {flagged} and {label} = 1) as fn, count(*) filter (where not {flagged} and {label} <> 1) as tn from {source} {'group by ' + by if by else ''}) c"""


RATES = ["accuracy", "precision", "recall", "f1"]


def _rounded(table: DataFrame, columns: list[str] = RATES, digits: int = 6) -> DataFrame:
    return table.withColumns({c: r(c, digits) for c in columns})


@query("confusion_and_rates", "K4", sql=_pred_sql(_confusion_sql("pred", "p >= 0.4", "label", "member")))
def confusion_and_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.confusion(member_scores(spark, sf_dir), "p", "label", 0.4, ["member"]))


@query("confusion_of_document_labels", "K4", sql=plain_sql(_confusion_sql("labels", "quality >= 1", "toxic", "")))
def confusion_of_document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.confusion(read_table(spark, sf_dir, "labels"), "quality", "toxic", 1))


@query("always_negative_baseline", "K5", sql=survey_sql(_confusion_sql("tr", "false", "label", "", 1.0), tr=FOLDED))
def always_negative_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir).where(is_train()).select("label", F.lit(0.0).alias("p"))
    return _rounded(E.confusion(rows, "p", "label", 0.5, no_flag_precision=1.0))


# The one-column rules.
RULES = {
    "always negative": "false",
    **{f"r6 = {v}": f"r6 = {v}" for v in range(6)},
    "class = Business": "class = 'Business'",
    "travel_type = Business travel": "travel_type = 'Business travel'",
    "customer_type = Loyal Customer": "customer_type = 'Loyal Customer'",
    "gender = Female": "gender = 'Female'",
    "r1 = 5": "r1 = 5",
}
RULE_ROWS = " union all ".join(f"select '{n}' as rule, {c} as flag, label from tr" for n, c in RULES.items())
RULE_TABLE = _confusion_sql("rr", "flag", "label", "rule", 1.0)


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = survey(spark, sf_dir).where(is_train())
    return E.rule_scores(train, {n: F.expr(c) for n, c in RULES.items()}, "label")


@query(
    "one_column_rule_scores", "K6",
    sql=survey_sql(f"select rule, accuracy, precision, recall, tp + fp as rows_flagged, {rd('(1 + case when tp + fn = 0 then 0 else tp / cast(tp + fn as double) end - fp / cast(fp + tn as double)) / 2')} as auc from t", tr="select * from survey where id % 10 < 7", rr=RULE_ROWS, t=RULE_TABLE),
)
def one_column_rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rules(spark, sf_dir), ["accuracy", "precision", "recall", "auc"]).select("rule", "accuracy", "precision", "recall", "rows_flagged", "auc")


@query("rule_table_ranked", "K7", sql=survey_sql("select rule, accuracy, cast(row_number() over (order by accuracy desc, rule) as integer) as place from t", tr="select * from survey where id % 10 < 7", rr=RULE_ROWS, t=RULE_TABLE))
def rule_table_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    ranked = E.ranked_rules(_rounded(_rules(spark, sf_dir), ["accuracy"]))
    # one row per rule
    return ranked.select("rule", "accuracy", F.row_number().over(W.orderBy(F.desc("accuracy"), "rule")).alias("place"))


WRONG = "(p >= 0.5) <> (label = 1)"
CONFIDENCE = "case when label = 1 then 1 - p else p end"


@query("worst_mistakes", "K8", sql=_pred_sql(f"select id, label, p, {rd(CONFIDENCE, 9)} as confidence from pred where member = 'm_r6' and {WRONG} order by {CONFIDENCE} desc, id limit 20"))
def worst_mistakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.worst_mistakes(_one(spark, sf_dir), "id", "p", "label").select("id", "label", "p", r("confidence", 9).alias("confidence"))


@query("wrong_row_counts", "K8", sql=_pred_sql(f"select member, count(*) as n_wrong from pred where {WRONG} group by member"))
def wrong_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.wrong_rows(member_scores(spark, sf_dir), "p", "label").groupBy("member").agg(F.count("*").alias("n_wrong"))


@query(
    "sorted_extremes", "K9",
    sql=_pred_sql("(select id, label, p, 'lowest' as \"end\" from pred where member = 'm_r1_r7' order by p, id limit 10) union all (select id, label, p, 'highest' from pred where member = 'm_r1_r7' order by p desc, id limit 10)"),
)
def sorted_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sorted_extremes(_one(spark, sf_dir, "m_r1_r7"), "id", "p").select("id", "label", "p", "end")


def _hard_sql(lo: float, hi: float) -> str:
    return f"case when label = 1 and p < {lo} then 'hard positive' when label = 1 and p > {hi} then 'easy positive' when label = 0 and p > {hi} then 'hard negative' when label = 0 and p < {lo} then 'easy negative' end"


@query("hard_and_easy_groups", "K10", sql=_pred_sql(f"select member, {_hard_sql(0.3, 0.5)} as kind, count(*) as n from pred where {_hard_sql(0.3, 0.5)} is not null group by 1, 2"))
def hard_and_easy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = member_scores(spark, sf_dir).withColumn("kind", E.hardness("p", "label", 0.3, 0.5)).where("kind is not null")
    return rows.groupBy("member", "kind").agg(F.count("*").alias("n"))


GROUPED = {"g": f"select s.*, {_hard_sql(0.3, 0.5).replace('label', 'pr.label')} as kind from survey s join pred pr on pr.id = s.id and pr.member = 'm_r6'"}


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _one(spark, sf_dir).select("id", "p")
    return survey(spark, sf_dir).join(scores, "id").withColumn("kind", E.hardness("p", "label", 0.3, 0.5))


@query(
    "numeric_group_contrast", "K11",
    sql=_pred_sql(" union all ".join(
        f"""select '{c}' as feature, {rd(f"avg({c}) filter (where kind = 'hard positive')", 4)} as mean_a, {rd(f"avg({c}) filter (where kind = 'easy negative')", 4)} as mean_b,
        {rd(f"abs(avg({c}) filter (where kind = 'hard positive') - avg({c}) filter (where kind = 'easy negative'))", 4)} as abs_difference from g""" for c in NUMERIC), **GROUPED),
)
def numeric_group_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = E.numeric_contrast(_kinds(spark, sf_dir), "kind", "hard positive", "easy negative", NUMERIC)
    return _rounded(table, ["mean_a", "mean_b", "abs_difference"], 4)


@query(
    "mode_group_contrast", "K11",
    sql=_pred_sql("select kind, feature, value as mode, " + rd("n / cast(tot as double)") + " as share from (select *, row_number() over (partition by kind, feature order by n desc, value) as rn, sum(n) over (partition by kind, feature) as tot from (" + " union all ".join(f"select kind, '{c}' as feature, {c} as value, count(*) as n from g where kind is not null group by kind, {c}" for c in CATEGORICAL) + ") x) y where rn = 1", **GROUPED),
)
def mode_group_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.mode_contrast(_kinds(spark, sf_dir), "kind", CATEGORICAL), ["share"])


@query(
    "single_most_confident_mistakes", "K12",
    sql=_pred_sql("(select 'positive' as mistake, pr.id, pr.p, pr.label, s.class, s.r6, s.age from pred pr join survey s on s.id = pr.id where member = 'm_r6' and pr.label = 1 order by p, pr.id limit 1) union all (select 'negative', pr.id, pr.p, pr.label, s.class, s.r6, s.age from pred pr join survey s on s.id = pr.id where member = 'm_r6' and pr.label = 0 order by p desc, pr.id limit 1)"),
)
def single_most_confident_mistakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _one(spark, sf_dir).select("id", "label", "p").join(survey(spark, sf_dir).select("id", "class", "r6", "age"), "id")
    return E.single_worst(rows, "id", "p", "label")


@query(
    "perfect_fix_headroom", "K13",
    sql=_pred_sql(f"select {rd('a.auc')} as current_auc, {rd('b.auc')} as fixed_auc, {rd('b.auc - a.auc')} as available from a, b",
                  one="select * from pred where member = 'm_r6'", fixed=f"select label, case when {_hard_sql(0.3, 0.5)} = 'hard positive' then 1.0 when {_hard_sql(0.3, 0.5)} = 'hard negative' then 0.0 else p end as p from one",
                  a=auc_sql("one", "p"), b=auc_sql("fixed", "p")),
)
def perfect_fix_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.headroom(_one(spark, sf_dir), "p", "label", 0.3, 0.5), ["current_auc", "fixed_auc", "available"])


DRAWS = 20


def _drawn_sql(votes: int, draws: int) -> str:
    hits = " + ".join(f"case when cast(('0x' || substr(md5(concat('c-', d, '-{v}:', cast(id as varchar))), 1, 8)) as bigint) / 4294967296.0 < p then 1 else 0 end" for v in range(votes))
    return f"select d as draw, p, case when ({hits}) * 2 >= {votes} then 1 else 0 end as y from one, (select unnest(range(0, {draws})) as d) z"


@query(
    "bernoulli_draw_ceiling", "K14",
    sql=_pred_sql(f"select cast(draw as integer) as draw, {rd('auc')} as auc from a", one="select * from pred where member = 'm_r1_r7'", dr=_drawn_sql(1, DRAWS), a=auc_sql("dr", "p", "y", by=["draw"])),
)
def bernoulli_draw_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _auc_table(E.draw_ceiling(_one(spark, sf_dir, "m_r1_r7"), "id", "p", DRAWS, "c"))


@query(
    "majority_draw_ceiling", "K14",
    sql=_pred_sql(f"select votes, {rd('avg(auc)')} as auc from (select 3 as votes, auc from a3 union all select 5, auc from a5) x group by votes",
                  one="select * from pred where member = 'm_r1_r7'", d3=_drawn_sql(3, 10), a3=auc_sql("d3", "p", "y", by=["draw"]), d5=_drawn_sql(5, 10), a5=auc_sql("d5", "p", "y", by=["draw"])),
)
def majority_draw_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _one(spark, sf_dir, "m_r1_r7")
    parts = [E.draw_ceiling(rows, "id", "p", 10, "c", votes).select(F.lit(votes).alias("votes"), "auc") for votes in (3, 5)]
    return parts[0].unionByName(parts[1]).groupBy("votes").agg(r(F.avg("auc")).alias("auc"))


@query(
    "evaluation_report", "K17",
    sql=_pred_sql(
        "select part, metric, value from (" + " union all ".join(f"select part, '{m}' as metric, cast({m} as double) as value from cm" for m in ["tp", "fp", "fn", "tn", *RATES])
        + f" union all select part, 'auc', {rd('auc')} from a) u",
        parts="select p.*, case when fold < 3 then 'validation' else 'test' end as part from pred p where member = 'm_r6'",
        cm=_confusion_sql("parts", "p >= 0.5", "label", "part"), a=auc_sql("parts", "p", by=["part"]),
    ),
)
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _one(spark, sf_dir).withColumn("part", F.when(F.col("fold") < 3, "validation").otherwise("test"))
    rates = E.metric_rows(_rounded(E.confusion(rows, "p", "label", 0.5, ["part"])), ["part"], ["tp", "fp", "fn", "tn", *RATES])
    return rates.unionByName(E.metric_rows(_auc_table(auc(rows, "p", "label", by=["part"])), ["part"], ["auc"]))


@query(
    "fold_spread_summary", "I27",
    sql=_pred_sql(f"select member, {rd('avg(auc)')} as mean, {rd('stddev_pop(auc)')} as std, {rd('min(auc)')} as low, {rd('max(auc)')} as high, {rd('max(auc) - min(auc)')} as spread from a group by member", a=auc_sql("pred", "p", by=["member", "fold"])),
)
def fold_spread_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = E.fold_spread(auc(member_scores(spark, sf_dir), "p", "label", by=["member", "fold"]), ["member"])
    return _rounded(table, ["mean", "std", "low", "high", "spread"])


LOGIT = "ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6)))"


@query("mean_logit_blend", "J2", sql=_pred_sql(f"select id, label, {rd(f'avg({LOGIT})')} as margin, {rd(f'1 / (1 + exp(-avg({LOGIT})))')} as p from pred group by id, label"))
def mean_logit_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.mean_logit_blend(member_scores(spark, sf_dir), ["id", "label"]), ["margin", "p"])


WEIGHTS = {"m_r6": 5.0, "m_class": 3.0, "m_r1_r7": 2.0}


@query("fixed_weight_blend", "J3", sql=_pred_sql(f"select id, {rd('0.5 * m_r6 + 0.3 * m_class + 0.2 * m_r1_r7')} as p, {rd('(m_r6 + m_class + m_r1_r7 + m_age) / 4')} as uniform from wide"))
def fixed_weight_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = member_scores(spark, sf_dir)
    fixed = S.weighted_blend(scores, ["id"], WEIGHTS)
    uniform = S.weighted_blend(scores, ["id"], {m: 1.0 for m in MEMBERS}).withColumnRenamed("p", "uniform")
    return _rounded(fixed.join(uniform, "id"), ["p", "uniform"])


GRID = [0.3, 0.4, 0.5, 0.6, 0.7]


@query(
    "weight_grid_auc", "J3",
    sql=_pred_sql(f"select weight, {rd('auc')} as auc from a", grid=" union all ".join(f"select {w}::double as weight, label, round({w}::double * m_r6 + (1 - {w}::double) * m_class, 9) as p from wide" for w in GRID), a=auc_sql("grid", "p", by=["weight"])),
)
def weight_grid_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = S.weight_grid(wide_members(spark, sf_dir), "m_r6", "m_class", GRID, ["label"]).withColumn("p", F.round("p", 9))
    return _auc_table(auc(grid, "p", "label", by=["weight"])).select("weight", "auc")


RANKED = "select id, label, fold, member, p, (rank() over (partition by member order by p) + (count(*) over (partition by member, p) - 1) / 2.0) / count(*) over (partition by member) as rnk from pred"


@query("rank_transform", "J6", sql=_pred_sql(f"select id, member, {rd('rnk', 9)} as rank from rk", rk=RANKED))
def rank_transform_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rank_members(member_scores(spark, sf_dir)).select("id", "member", r("rank", 9).alias("rank"))


@query(
    "member_rank_correlation", "J13",
    sql=_pred_sql("select a, b, " + rd("c") + " as corr, c < 0.995 as diverse from (" + " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as c from w" for a, b in all_pairs(list(MEMBERS))) + ") x",
                  rk=RANKED, w="select id, " + ", ".join(f"max(case when member = '{m}' then rnk end) as {m}" for m in MEMBERS) + " from rk group by id"),
)
def member_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = S.rank_members(member_scores(spark, sf_dir)).select("id", "member", F.col("rank").alias("p"))
    table = correlation_matrix(wide_predictions(ranks, list(MEMBERS)), list(MEMBERS))
    return table.select("a", "b", r("corr").alias("corr"), (F.col("corr") < 0.995).alias("diverse"))


COMBINED = {
    "combo": f"select id, label, fold, 'mean_logit' as combiner, round(1 / (1 + exp(-avg({LOGIT}))), 9) as p from pred group by id, label, fold union all select id, label, fold, 'mean_rank', round(avg(rnk), 9) from rk group by id, label, fold",
}


@query("combiner_choice", "J10", sql=_pred_sql(f"select combiner, {rd('auc')} as auc from a order by auc desc, combiner limit 1", rk=RANKED, **COMBINED, a=auc_sql("combo", "p", by=["combiner"])))
def combiner_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = member_scores(spark, sf_dir)
    keep = ["id", "label", "fold"]
    logits = S.mean_logit_blend(scores, keep).select(*keep, F.lit("mean_logit").alias("combiner"), F.round("p", 9).alias("p"))
    ranks = S.rank_members(scores).groupBy(*keep).agg(F.round(F.avg("rank"), 9).alias("p")).withColumn("combiner", F.lit("mean_rank"))
    table = _auc_table(auc(logits.unionByName(ranks), "p", "label", by=["combiner"])).select("combiner", "auc")
    return S.choose_best(table, "combiner", "auc")


VIEWS = {"base": ["m_r6", "m_class"], "with_r1_r7": ["m_r6", "m_class", "m_r1_r7"], "with_age": ["m_r6", "m_class", "m_age"]}


@query(
    "view_acceptance", "J14",
    sql=_pred_sql(
        f"""select "view", {rd('auc')} as auc, {rd('gain')} as gain, decision, decision = 'ACCEPT' and auc = max(case when decision = 'ACCEPT' then auc end) over () as is_best
        from (select "view", auc, auc - base as gain, case when auc - base >= 1e-4 then 'ACCEPT' else 'REJECT' end as decision from a, (select auc as base from a where "view" = 'base') b where "view" <> 'base') x""",
        blend=" union all ".join(f"select id, label, '{v}' as \"view\", round(1 / (1 + exp(-avg({LOGIT}))), 9) as p from pred where member in ({', '.join(repr(m) for m in ms)}) group by id, label" for v, ms in VIEWS.items()),
        a=auc_sql("blend", "p", by=['"view"']),
    ),
)
def view_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = member_scores(spark, sf_dir)
    blends = [S.mean_logit_blend(scores.where(F.col("member").isin(ms)), ["id", "label"]).withColumn("view", F.lit(v)) for v, ms in VIEWS.items()]
    table = auc(reduce(lambda a, b: a.unionByName(b), blends).withColumn("p", F.round("p", 9)), "p", "label", by=["view"]).select("view", "auc")
    base = table.where("view = 'base'").select("auc").scalar()
    return _rounded(S.view_decisions(table.where("view <> 'base'"), base, 1e-4), ["auc", "gain"])


@query(
    "pseudo_label_selection", "I31",
    sql=survey_sql(
        "select id, p, case when p > 0.5 then 1 else 0 end as label, true as is_pseudo from scored where p > 0.55 or p < 0.2 union all select id, cast(label as double), label, false from tr",
        tr=TRAIN, prior="select avg(cast(label as double)) as pr from tr",
        te=f"select r1, r7, (sum(cast(label as double)) + max(pr) * {SMOOTHING}) / (count(*) + {SMOOTHING}) as te from tr, prior group by r1, r7",
        scored="select id, round(coalesce(te, pr), 9) as p from (select * from survey where id % 10 >= 7) s left join te using (r1, r7), prior",
    ),
    note="rows to score, rated by the labelled ones, join them as training rows where the score is confident",
)
def pseudo_label_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = survey(spark, sf_dir), ["r1", "r7"]
    train, new = rows.where(is_train()), rows.where(~is_train()).select("id", *keys)
    scored = apply_target_table(new, fit_target_table(train, keys, "label", SMOOTHING), train, keys, "label").select("id", r("te", 9).alias("p"))
    return Ps.augment(train.select("id", F.col("label").cast("double").alias("p"), "label"), Ps.select_confident(scored, "p", 0.55, 0.2))


CUTS = [(0.95, 0.05), (0.6, 0.2), (0.5, 0.3)]


@query(
    "pseudo_label_counts", "I31",
    sql=_pred_sql(" union all ".join(f"select {h}::double as high, {lo}::double as low, count(*) filter (where p > {h}) as n_positive, count(*) filter (where p < {lo}) as n_negative, {rd(f'count(*) filter (where p > {h} or p < {lo}) / cast(count(*) as double)')} as share from pred where member = 'm_r1_r7'" for h, lo in CUTS)),
)
def pseudo_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Ps.confident_counts(_one(spark, sf_dir, "m_r1_r7"), "p", CUTS), ["share"])


HOT = "power(greatest(least(p / (1 - p + 1e-6), 1), 1e-6), 2)"
COLD = "power(greatest(least((1 - p) / (1 - p + 1e-6), 1), 1e-6), 2)"


@query(
    "soft_pseudo_labels", "I34",
    sql=_pred_sql(f"select id, 1 as label, {rd(f'{HOT} / ({HOT} + {COLD})')} as weight from pred where member = 'm_r6' union all select id, 0, {rd(f'{COLD} / ({HOT} + {COLD})')} from pred where member = 'm_r6'"),
)
def soft_pseudo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Ps.soft_targets(_one(spark, sf_dir).select("id", "p"), "p", 0.5)
    return rows.select("id", "label", r("weight").alias("weight"))


SEEDS = (1, 2, 3)


def _seeded_rate_sql(seed: int) -> str:
    """Out-of-fold rate of r6 with the folds of one seed."""
    return f"""select id, round((k.s - c.s + pr * {SMOOTHING}) / (k.n - c.n + {SMOOTHING}), 9) as p from f{seed} t
        join (select r6, fold, cast(sum(label) as double) as s, count(*) as n from f{seed} group by all) c on c.r6 = t.r6 and c.fold = t.fold
        join (select r6, cast(sum(label) as double) as s, count(*) as n from f{seed} group by all) k on k.r6 = t.r6
        join (select a.fold, (max(b.s) - a.s) / (max(b.n) - a.n) as pr from (select fold, cast(sum(label) as double) as s, count(*) as n from f{seed} group by fold) a,
              (select cast(sum(label) as double) as s, count(*) as n from f{seed}) b group by a.fold, a.s, a.n) q on q.fold = t.fold"""


@query(
    "seed_averaging", "I8",
    sql=survey_sql(
        f"select id, {rd('avg(p)', 5)} as p, count(*) as n from (" + " union all ".join(_seeded_rate_sql(s) for s in SEEDS) + ") x group by id",
        **{f"f{s}": f"select id, r6, label, {strat_fold_sql(s)} as fold from survey where id % 10 < 7" for s in SEEDS},
    ),
    note="one estimator, its folds drawn with several seeds, averaged",
)
def seed_averaging(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = fitted(survey(spark, sf_dir).where(is_train()).select("id", "label", "r6"), "train")
    runs = [oof_rates(stratified_folds(train, "id", "label", FOLDS, s), ["id"], {"rate": [F.col("r6")]}, "label", "fold", SMOOTHING) for s in SEEDS]
    every = reduce(lambda a, b: a.unionByName(b), [x.select("id", r("rate", 9).alias("p")) for x in runs])
    return every.groupBy("id").agg(r(F.avg("p"), 5).alias("p"), F.count("*").alias("n"))
