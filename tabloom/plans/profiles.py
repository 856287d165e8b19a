"""Queries for profiling and exploratory statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.ratings import mean_rating, worst_rating
from tabloom.operators import profile as P
from tabloom.operators import stats as St
from tabloom.operators.ranks import quantiles, spearman_with_label
from tabloom.plans.common import CATEGORICAL, CONTINUOUS, NUMERIC, RATINGS, TRAIN, r, rd, unpivot_sql
from tabloom.plans.member_data import MEMBER_SQL, member_scores
from tabloom.plans.registry import plain_sql, query, survey_sql
from tabloom.sources.survey import RAW_FEATURES, is_train, survey
from tabloom.sources.tables import read_table


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey(spark, sf_dir).where(is_train())


def _tr_sql(select: str, **ctes: str) -> str:
    return survey_sql(select, tr=TRAIN, **ctes)


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]
LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "row_and_null_counts", "C1",
    sql=survey_sql(" union all ".join(f"select count(*) as n_rows, '{c}' as column_name, count(*) filter (where {c} is null) as n_null from survey" for c in RAW_FEATURES)),
)
def row_and_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.null_counts(survey(spark, sf_dir), RAW_FEATURES)


def _line_value_sql(columns: list[str]) -> str:
    return " union all ".join(f"select '{c}' as feature, cast({c} as varchar) as value, count(*) as n from lineitem group by {c}" for c in columns)


@query(
    "column_summary", "C2",
    sql=plain_sql(" union all ".join(f"select '{c}' as feature, count({c}) as n, count(distinct {c}) as n_distinct, cast(min({c}) as varchar) as min_value, cast(max({c}) as varchar) as max_value from lineitem" for c in LINE)),
)
def column_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.column_summary(read_table(spark, sf_dir, "lineitem", LINE), LINE)


@query(
    "most_common_values", "C2",
    sql=plain_sql("select feature, value, n, cast(place as integer) as place from (select *, row_number() over (partition by feature order by n desc, value) as place from v) x where place <= 5", v=_line_value_sql(LINE)),
)
def most_common_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.common_values(read_table(spark, sf_dir, "lineitem", LINE), LINE)


@query(
    "numeric_describe", "C3",
    sql=plain_sql(" union all ".join(
        f"select '{c}' as feature, count({c}) as n, {rd(f'avg({c})', 4)} as mean, {rd(f'stddev_samp({c})', 4)} as std, min({c}) as min, "
        f"{rd(f'quantile_cont({c}, 0.25)', 4)} as q25, {rd(f'quantile_cont({c}, 0.5)', 4)} as q50, {rd(f'quantile_cont({c}, 0.75)', 4)} as q75, max({c}) as max from lineitem" for c in LINE_NUM)),
)
def numeric_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = P.describe(read_table(spark, sf_dir, "lineitem", LINE_NUM), LINE_NUM)
    return table.withColumns({c: r(c, 4) for c in ["mean", "std", "q25", "q50", "q75"]})


@query(
    "rating_value_count_matrix", "C4",
    sql=_tr_sql("select value, " + ", ".join(f"count(*) filter (where feature = '{c}') as {c}" for c in RATINGS) + " from long group by value", long=unpivot_sql("tr", RATINGS)),
)
def rating_value_count_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.value_count_matrix(_train(spark, sf_dir), RATINGS)


@query(
    "category_shares", "C5",
    sql=_tr_sql(" union all ".join(f"select '{c}' as feature, {c} as value, count(*) as n, {rd('count(*) / sum(count(*)) over ()')} as share from tr group by {c}" for c in CATEGORICAL)),
)
def category_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.category_shares(_train(spark, sf_dir), CATEGORICAL).withColumn("share", r("share"))


def _hist_sql(by: str = "") -> str:
    g = f"{by}, " if by else ""
    return " union all ".join(
        f"select {g}'{c}' as feature, bin, count(*) as n, {rd(f'count(*) / (sum(count(*)) over ({('partition by ' + by) if by else ''}) * w)', 9)} as density from "
        f"(select {g}cast(least(floor(({c} - lo) * 60 / (hi - lo)), 59) as integer) as bin, (hi - lo) / 60 as w from tr, (select cast(min({c}) as double) as lo, cast(max({c}) as double) as hi from tr) b where {c} is not null) x group by {g}bin, w"
        for c in CONTINUOUS
    )


@query("histogram", "C6", sql=_tr_sql(f"select * exclude (density) from ({_hist_sql()}) h"))
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.histogram(_train(spark, sf_dir), CONTINUOUS).drop("density")


@query("histogram_by_label", "C7", sql=_tr_sql(_hist_sql("label")))
def histogram_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.histogram(_train(spark, sf_dir), CONTINUOUS, by=["label"]).withColumn("density", r("density", 9))


FENCED = LINE_NUM


@query(
    "iqr_fence_profile", "C8",
    sql=_tr_sql(
        f"""select f.feature, {rd('q1')} as q1, {rd('q3')} as q3, {rd('q3 - q1')} as iqr, {rd('q3 + 1.5 * (q3 - q1)')} as fence, min(value) as min, max(value) as max,
        {rd('avg(case when value = 0 then 1.0 else 0.0 end)')} as share_zero, q3 > q1 as rule_valid,
        case when q3 > q1 then cast(count(*) filter (where value > q3 + 1.5 * (q3 - q1)) as double) end as rows_beyond
        from long l join (select feature, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from long where value is not null group by feature) f on f.feature = l.feature group by f.feature, q1, q3""",
        long=unpivot_sql("tr", CONTINUOUS),
    ),
)
def iqr_fence_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = P.fence_profile(_train(spark, sf_dir), CONTINUOUS)
    return table.withColumns({c: r(c) for c in ["q1", "q3", "iqr", "fence", "share_zero"]})


# Domain bounds of the continuous columns.
DOMAIN = {"age": (0, 120), "distance": (1, 20000), "dep_delay": (0, 1440), "arr_delay": (0, 1440)}
TIGHT = {"age": (7, 80), "distance": (100, 4500), "dep_delay": (0, 15), "arr_delay": (0, 14)}


@query(
    "domain_bound_profile", "C9",
    sql=_tr_sql(" union all ".join(f"select '{c}' as feature, count(*) filter (where {c} < {lo} or {c} > {hi}) as rows_outside from tr" for c, (lo, hi) in TIGHT.items())),
)
def domain_bound_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.domain_profile(_train(spark, sf_dir), TIGHT)


RAW_MEAN = "(" + " + ".join(RATINGS) + ") / 13.0"


@query(
    "tail_versus_body", "C10",
    sql=_tr_sql(
        f"""select l.feature, count(*) filter (where value >= hi) as n_extreme,
        {rd('avg(m) filter (where value >= hi)')} as score_extreme, {rd('avg(m) filter (where value > lo and value < hi)')} as score_ordinary,
        {rd('avg(label) filter (where value >= hi)')} as rate_extreme, {rd('avg(label) filter (where value > lo and value < hi)')} as rate_ordinary
        from long l join (select feature, quantile_cont(value, 0.001) as lo, quantile_cont(value, 0.999) as hi from long where value is not null group by feature) q on q.feature = l.feature group by l.feature""",
        long=unpivot_sql("tr", CONTINUOUS, [f"{RAW_MEAN} as m", "label"]),
    ),
)
def tail_versus_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = P.tail_profile(_train(spark, sf_dir), CONTINUOUS, "label", mean_rating(RATINGS, zero_missing=False))
    return table.withColumns({c: r(c) for c in ["score_extreme", "score_ordinary", "rate_extreme", "rate_ordinary"]})


PEARSON = St.all_pairs(NUMERIC) + [(c, "label") for c in NUMERIC]


@query("pearson_correlations", "C11", sql=_tr_sql(" union all ".join(f"select '{a}' as a, '{b}' as b, {rd(f'corr({a}, {b})')} as corr from tr" for a, b in PEARSON)))
def pearson_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _train(spark, sf_dir)
    both = St.correlation_matrix(train, NUMERIC).unionByName(St.correlations(train, NUMERIC, ["label"]))
    return both.withColumn("corr", r("corr"))


def _mid_sql(c: str) -> str:
    return f"case when {c} is not null then rank() over (order by {c} nulls last) + (count(*) over (partition by {c}) - 1) / 2.0 end as {c}"


@query(
    "spearman_correlations", "C12",
    sql=_tr_sql(" union all ".join(f"select '{a}' as a, '{b}' as b, {rd(f'corr({a}, {b})')} as corr from ranks" for a, b in St.all_pairs(NUMERIC)), ranks="select id, " + ", ".join(_mid_sql(c) for c in NUMERIC) + " from tr"),
)
def spearman_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return St.rank_correlations(_train(spark, sf_dir), "id", NUMERIC).withColumn("corr", r("corr"))


@query(
    "spearman_with_label", "C12",
    sql=_tr_sql(" union all ".join(f"select '{c}' as feature, {rd('corr(a, b)')} as spearman from (select rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as a, rank() over (order by label) + (count(*) over (partition by label) - 1) / 2.0 as b from tr where {c} is not null) x" for c in NUMERIC)),
)
def spearman_with_label_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spearman_with_label(_train(spark, sf_dir), NUMERIC, "label").withColumn("spearman", r("spearman"))


@query("label_rate_by_category", "C13", sql=_tr_sql(" union all ".join(f"select '{c}' as feature, cast({c} as varchar) as value, {rd('avg(label)')} as label_rate, count(*) as n from tr group by {c}" for c in CATEGORICAL + RATINGS)))
def label_rate_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.label_rate_by_category(_train(spark, sf_dir), CATEGORICAL + RATINGS, "label").withColumn("label_rate", r("label_rate"))


@query("row_normalised_crosstab", "C14", sql=_tr_sql("select class, " + ", ".join(f"""{rd(f"avg(case when travel_type = '{v}' then 1.0 else 0.0 end)")} as {n}""" for v, n in [("Business travel", "business"), ("Personal Travel", "personal")]) + " from tr group by class"))
def row_normalised_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = P.crosstab_shares(_train(spark, sf_dir), "class", "travel_type", ["Business travel", "Personal Travel"])
    return table.select("class", r("Business travel").alias("business"), r("Personal Travel").alias("personal"))


@query(
    "two_group_comparison", "C15",
    sql=_tr_sql(
        f"""select feature, {rd('avg(value) filter (where label = 0)', 3)} as negative_mean, {rd('avg(value) filter (where label = 1)', 3)} as positive_mean,
        {rd('quantile_cont(value, 0.5) filter (where label = 0)', 3)} as negative_median, {rd('quantile_cont(value, 0.5) filter (where label = 1)', 3)} as positive_median,
        {rd('avg(value) filter (where label = 1) - avg(value) filter (where label = 0)', 3)} as difference from long where value is not null group by feature""",
        long=unpivot_sql("tr", NUMERIC, ["label"]),
    ),
)
def two_group_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = St.two_group_means(_train(spark, sf_dir), NUMERIC, "label")
    return table.select("feature", *[r(c, 3).alias(c) for c in table.columns if c != "feature"])


@query("category_rate_spread", "C15", sql=_tr_sql(" union all ".join(f"select '{c}' as feature, {rd('max(x) - min(x)', 4)} as difference from (select avg(label) as x from tr group by {c}) y" for c in CATEGORICAL)))
def category_rate_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return St.category_rate_spread(_train(spark, sf_dir), CATEGORICAL, "label").withColumn("difference", r("difference", 4))


TEST_SQL = {
    "long": unpivot_sql("tr", NUMERIC, ["label"]),
    "cells": "select feature, value, cast(sum(label) as double) as pos, cast(sum(1 - label) as double) as neg from long where value is not null group by feature, value",
    "run": "select *, coalesce(sum(neg) over (partition by feature order by value rows between unbounded preceding and 1 preceding), 0) as below from cells",
    "sums": "select feature, sum(pos) as n1, sum(neg) as n2, sum(pos * (below + neg / 2)) as u, sum(power(pos + neg, 3) - (pos + neg)) as ties from run group by feature",
    "zed": "select *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) as z, 2 * u / (n1 * n2) - 1 as d from sums",
    "eff": "select *, sqrt((n1 + n2 + 1 - d * d * (n1 + n2)) / (12 * n1 * n2)) as se, case when abs(d) < 0.147 then 'negligible' when abs(d) < 0.33 then 'small' when abs(d) < 0.474 then 'medium' else 'large' end as effect from zed",
}


@query("mann_whitney_u", "C16", sql=_tr_sql(f"select feature, cast(n1 as bigint) as n_pos, cast(n2 as bigint) as n_neg, u, {rd('z', 5)} as z from eff", **TEST_SQL))
def mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return St.rank_sum_tests(_train(spark, sf_dir), NUMERIC, "label").select("feature", "n_pos", "n_neg", "u", r("z", 5).alias("z"))


@query("mann_whitney_p_values", "C16", note="two-sided p from erfc; U and z are compared by mann_whitney_u")
def mann_whitney_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = St.rank_sum_tests(_train(spark, sf_dir), NUMERIC, "label")
    return tests.select("feature", "z", St.normal_two_sided_p("z").alias("p"))


@query(
    "cliffs_delta_interval", "C17", "C18", "C19",
    sql=_tr_sql(f"select feature, {rd('d')} as delta, {rd(f'd - {St.Z_975} * se')} as delta_low, {rd(f'd + {St.Z_975} * se')} as delta_high, effect from eff", **TEST_SQL),
)
def cliffs_delta_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = St.rank_sum_tests(_train(spark, sf_dir), NUMERIC, "label")
    return tests.select("feature", r("delta").alias("delta"), r("delta_low").alias("delta_low"), r("delta_high").alias("delta_high"), "effect")


@query("strong_signals", "C20", sql=_tr_sql(f"select feature, {rd('d')} as delta, effect from eff where effect in ('medium', 'large')", **TEST_SQL))
def strong_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = St.rank_sum_tests(_train(spark, sf_dir), NUMERIC, "label")
    return St.strong_signals(tests).select("feature", r("delta").alias("delta"), "effect")


CHI_COLUMNS = [*CATEGORICAL, "r6", "distance"]
CHI_SQL = {
    "cells": " union all ".join(f"select '{c}' as feature, cast({c} as varchar) as value, cast(sum(label) as double) as pos, cast(sum(1 - label) as double) as neg from tr group by {c}" for c in CHI_COLUMNS),
    "m": "select feature, sum(pos) as p, sum(neg) as q, count(*) - 1 as dof from cells group by feature",
    "e": "select c.feature, dof, p + q as n, unnest([pos, neg]) as o, unnest([(pos + neg) * p / (p + q), (pos + neg) * q / (p + q)]) as e from cells c join m on m.feature = c.feature",
    "chi": "select feature, dof, n, sum(power(case when dof = 1 then abs(o - e) - least(0.5, abs(o - e)) else abs(o - e) end, 2) / e) as chi2 from e group by feature, dof, n",
}


@query("chi_square_and_cramers_v", "C21", "C22", sql=_tr_sql(f"select feature, {rd('chi2', 4)} as chi2, dof, {rd('sqrt(chi2 / n)')} as cramers_v from chi", **CHI_SQL))
def chi_square_and_cramers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return St.chi_square(_train(spark, sf_dir), CHI_COLUMNS, "label").select("feature", r("chi2", 4).alias("chi2"), "dof", r("cramers_v").alias("cramers_v"))


@query("chi_square_p_values", "C21", note="upper tail in closed form; the statistic is compared by chi_square_and_cramers_v")
def chi_square_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = St.chi_square(_train(spark, sf_dir), CHI_COLUMNS, "label")
    return table.select("feature", "chi2", "dof", St.chi_square_p("chi2", "dof").alias("p"))


@query(
    "top_value_coverage", "C23",
    sql=plain_sql("select (select count(distinct user_id) from events) as n_distinct, (select cast(sum(n) as bigint) from (select count(*) as n from events group by user_id order by n desc, user_id limit 20) t) as n_covered, (select count(*) from events) as n_rows"),
)
def top_value_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_value_coverage(read_table(spark, sf_dir, "events", ["user_id"]), "user_id")


VECTOR = ["class", "travel_type", "customer_type", "r6", "r1", "r7", "arr_delay"]


@query(
    "contradictory_duplicates", "C24",
    sql=_tr_sql(f"select count(*) filter (where n > 1) as repeated_vectors, count(*) filter (where n > 1 and k > 1) as conflicting_vectors, cast(coalesce(sum(n) filter (where n > 1 and k > 1), 0) as bigint) as rows_in_conflict from (select count(*) as n, count(distinct label) as k from tr group by {', '.join(VECTOR)}) v"),
)
def contradictory_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.contradictions(_train(spark, sf_dir), VECTOR, "label")


ANSWERED_SUM = " + ".join(RATINGS)
ANSWERED_N = " + ".join(f"(case when {c} > 0 then 1 else 0 end)" for c in RATINGS)
WORST = "least(" + ", ".join(f"nullif({c}, 0)" for c in RATINGS) + ")"
SIGNATURE = f"round(cast({ANSWERED_SUM} as double) / nullif({ANSWERED_N}, 0), 1) as m, {WORST} as w"
RATIO_SQL = {"sig": f"select {SIGNATURE}, label from tr", "g": "select m, w, count(*) as n, avg(label) as rate, var_samp(label) as v from sig group by m, w"}


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _train(spark, sf_dir)
    return P.variance_ratios(train, [F.round(mean_rating(RATINGS), 1), worst_rating(RATINGS)], "label", min_rows=20)


@query("bernoulli_variance_ratio", "C25", sql=_tr_sql(f"select m as s0, cast(w as bigint) as s1, n, {rd('rate')} as rate, {rd('v / (rate * (1 - rate))')} as ratio from g where n >= 20 and rate between 0.03 and 0.97", **RATIO_SQL))
def bernoulli_variance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratios(spark, sf_dir).select("s0", "s1", "n", r("rate").alias("rate"), r("ratio").alias("ratio"))


@query("bernoulli_variance_summary", "C25", sql=_tr_sql(f"select count(*) as groups, {rd('quantile_cont(v / (rate * (1 - rate)), 0.5)')} as median_ratio, {rd('avg(case when v / (rate * (1 - rate)) > 1.5 then 1.0 else 0.0 end)')} as share_above from g where n >= 20 and rate between 0.03 and 0.97", **RATIO_SQL))
def bernoulli_variance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = _ratios(spark, sf_dir)
    median = quantiles(ratios, [], "ratio", [0.5]).select(F.get("q", F.lit(0)))
    return ratios.agg(F.count("*").alias("groups"), r(F.avg((F.col("ratio") > 1.5).cast("double"))).alias("share_above")).withColumn("median_ratio", r(median.scalar()))


@query("latent_factor_profile", "C26", note="13x13 eigendecomposition of a one-row aggregate; first component")
def latent_factor_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return St.latent_factor_profile(_train(spark, sf_dir), RATINGS, "label")


@query(
    "label_rate_by_score_zone", "C27",
    sql=survey_sql(f"select cast(case when p <= 0.2 then 0 when p <= 0.5 then 1 else 2 end as integer) as zone, count(*) as n, {rd('avg(label)', 4)} as positive_rate from pred where member = 'm_r6' and p between 0 and 1 group by 1", **MEMBER_SQL),
)
def label_rate_by_score_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = member_scores(spark, sf_dir).where("member = 'm_r6'")
    return P.score_zones(scores, "p", "label", [0.0, 0.2, 0.5, 1.0]).withColumn("positive_rate", r("positive_rate", 4))
