"""Queries for row-wise derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import ratings as R
from tabloom.functions import scalars as S
from tabloom.operators import derive as D
from tabloom.operators.profile import quantile_lookup
from tabloom.plans.common import CONTINUOUS, RATINGS, TRAIN, r, rd
from tabloom.plans.member_data import MEMBER_SQL, member_scores
from tabloom.plans.profiles import ANSWERED_N, ANSWERED_SUM, RAW_MEAN, WORST
from tabloom.plans.registry import query, survey_sql
from tabloom.sources.survey import is_train, survey

MEAN = f"(cast({ANSWERED_SUM} as double) / nullif({ANSWERED_N}, 0))"
SQUARES = " + ".join(f"{c} * {c}" for c in RATINGS)
STD = f"case when {ANSWERED_N} >= 2 then sqrt((({ANSWERED_N}) * ({SQUARES}) - ({ANSWERED_SUM}) * ({ANSWERED_SUM})) / cast(({ANSWERED_N}) * ({ANSWERED_N} - 1) as double)) end"
CLASS_CODE = "case class when 'Eco' then 1 when 'Eco Plus' then 2 else 0 end"
ARR = "coalesce(arr_delay, 0)"


def count_sql(test: str) -> str:
    return "(" + " + ".join(f"(case when {c} {test} then 1 else 0 end)" for c in RATINGS) + ")"


def bin_sql(column: str, edges: list[int]) -> str:
    arms = " ".join(f"when {column} <= {hi} then {i}" for i, hi in enumerate(edges[1:]))
    return f"case when {column} is null or {column} <= {edges[0]} then -1 {arms} else -1 end"


DERIVED_SQL = {
    "mean_service_rating": rd(MEAN),
    "worst_service_rating": f"cast({WORST} as double)",
    "count_of_ratings_at_or_below_2": count_sql("between 1 and 2"),
    "count_of_5s": count_sql("= 5"),
    "count_of_1s": count_sql("= 1"),
    "rating_std": rd(STD),
    "boarding_x_class": f"r6 * 10 + {CLASS_CODE}",
    "boarding_x_travel_type": "r6 * 10 + case when travel_type = 'Personal Travel' then 1 else 0 end",
    "class_x_customer_type": f"{CLASS_CODE} * 10 + case when customer_type = 'disloyal Customer' then 1 else 0 end",
    "age_bin": bin_sql("age", D.AGE_EDGES),
    "distance_bin": bin_sql("distance", D.DISTANCE_EDGES),
    "any_delay": f"case when dep_delay > 0 or {ARR} > 0 then 1 else 0 end",
    "dep_delayed": "case when dep_delay > 0 then 1 else 0 end",
    "arr_delayed": f"case when {ARR} > 0 then 1 else 0 end",
    "delay_over_15min": f"case when dep_delay > 15 or {ARR} > 15 then 1 else 0 end",
    "age_squared": "age * age",
    "distance_squared": "distance * distance",
    "age_over_distance": rd("cast(age as double) / (distance + 1)", 9),
    "delay_over_distance": rd(f"(dep_delay + {ARR}) / (distance + 1)", 9),
}
DIGITS = {"mean_service_rating": 6, "rating_std": 6, "age_over_distance": 9, "delay_over_distance": 9}


def _derived(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    frame = D.add_derived(survey(spark, sf_dir), names)
    return frame.select("id", *[r(n, DIGITS[n]).alias(n) if n in DIGITS else F.col(n) for n in names])


def _register(query_name: str, ops: list[str], names: list[str]) -> None:
    sql = survey_sql("select id, " + ", ".join(f"{DERIVED_SQL[n]} as {n}" for n in names) + " from survey")
    query(query_name, *ops, sql=sql)(lambda spark, sf_dir: _derived(spark, sf_dir, names))


_ALL = list(DERIVED_SQL)
_register("rating_aggregates", ["D1", "D2", "D3", "D4", "D5"], _ALL[:6])
_register("category_interactions", ["D6", "D7", "D8"], _ALL[6:9])
_register("right_closed_bins", ["D9", "D10"], _ALL[9:11])
_register("delay_flags", ["D11", "D12"], _ALL[11:15])
_register("squares_and_ratios", ["D13", "D14", "D15"], _ALL[15:])
_register("derived_feature_registry", ["D16"], _ALL)


@query(
    "missing_code_recode", "D17",
    sql=survey_sql(f"select id, {rd(f'coalesce({MEAN}, 3.0)')} as mean_service_rating, {ARR} as arr_delay, " + ", ".join(f"cast(nullif({c}, 0) as double) as {c}" for c in RATINGS) + " from survey"),
)
def missing_code_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = D.recode_missing(survey(spark, sf_dir), RATINGS, "arr_delay", 3.0)
    return frame.select("id", r("mean_service_rating").alias("mean_service_rating"), "arr_delay", *[F.col(c).cast("double").alias(c) for c in RATINGS])


STATUS = "case when arr_delay is null then 'unknown' when arr_delay > 0 then 'delayed' else 'on_time' end"


@query("arrival_delay_status", "D18", sql=survey_sql(f"select id, {STATUS} as status from survey"))
def arrival_delay_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey(spark, sf_dir).select("id", D.arrival_status("arr_delay").alias("status"))


@query("arrival_delay_status_shares", "D18", sql=survey_sql(f"select {STATUS} as status, count(*) as n, {rd('count(*) / sum(count(*)) over ()')} as share from survey group by 1"))
def arrival_delay_status_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = survey(spark, sf_dir).groupBy(D.arrival_status("arr_delay").alias("status")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", r(F.col("n") / counts.agg(F.sum("n")).scalar()))


def _bounds(lo: float, hi: float) -> str:
    return "select " + ", ".join(f"quantile_cont(cast({c} as double), {lo}) as {c}_lo, quantile_cont(cast({c} as double), {hi}) as {c}_hi" for c in CONTINUOUS) + " from survey where id % 10 < 7"


@query("outlier_bounds", "D19", sql=survey_sql(" union all ".join(f"select '{c}' as feature, {rd(f'{c}_lo')} as low, {rd(f'{c}_hi')} as high from b" for c in CONTINUOUS), b=_bounds(0.01, 0.99)))
def outlier_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.operators.ranks import column_quantiles

    table = column_quantiles(survey(spark, sf_dir).where(is_train()), CONTINUOUS, [0.01, 0.99])
    return table.select("feature", r(F.get("q", F.lit(0))).alias("low"), r(F.get("q", F.lit(1))).alias("high"))


@query("outlier_flags", "D20", sql=survey_sql("select id, " + ", ".join(f"case when {c} < {c}_lo or {c} > {c}_hi then 1 else 0 end as {c}_is_outlier" for c in CONTINUOUS) + " from survey, b", b=_bounds(0.01, 0.99)))
def outlier_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir)
    return D.outlier_flags(rows, rows.where(is_train()), CONTINUOUS).select("id", *[f"{c}_is_outlier" for c in CONTINUOUS])


@query("percentile_clipping", "D21", sql=survey_sql("select id, " + ", ".join(f"{rd(f'case when {c} is not null then least(greatest({c}, {c}_lo), {c}_hi) end')} as {c}" for c in CONTINUOUS) + " from survey, b", b=_bounds(0.05, 0.95)))
def percentile_clipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir)
    return D.percentile_clip(rows, rows.where(is_train()), CONTINUOUS, 0.05, 0.95).select("id", *[r(c).alias(c) for c in CONTINUOUS])


@query("hard_cap_filter", "D22", sql=survey_sql("select id, distance, dep_delay, arr_delay from survey where distance <= 4500 and dep_delay <= 12 and (arr_delay is null or arr_delay <= 10)"))
def hard_cap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.hard_cap_filter(survey(spark, sf_dir), {"distance": 4500, "dep_delay": 12, "arr_delay": 10}).select("id", "distance", "dep_delay", "arr_delay")


@query(
    "decimal_digits", "D23",
    sql="select p_partkey, " + ", ".join(
        f"cast((cast(round_even(abs(cast({c} as double)) * 10000, 0) as bigint) // {10 ** (e + 4)}) % 10 as integer) as {D.digit_name(c, e)}" for c in ["p_retailprice", "p_size"] for e in D.DIGIT_EXPONENTS
    ) + " from part",
)
def decimal_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.sources.tables import read_table

    columns = ["p_retailprice", "p_size"]
    frame = D.add_digits(read_table(spark, sf_dir, "part", ["p_partkey", *columns]), columns)
    return frame.drop(*columns)


@query(
    "modular_keys", "D24",
    sql=survey_sql("select id, distance % 10 as distance_mod10, distance % 100 as distance_mod100, distance // 10 as distance_div10, distance % 1000 as distance_mod1000, age % 10 as age_mod10, age // 5 as age_div5, least(dep_delay, 60) // 5 as delay_div5 from survey"),
)
def modular_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey(spark, sf_dir).select("id", *[c.alias(n) for n, c in D.modular_keys().items()])


@query(
    "delay_ratios_and_differences", "D27",
    sql=survey_sql(f"""select id, {rd(f'(dep_delay + {ARR}) / (distance / 1000.0)')} as delay_per_1000, {rd(f'{ARR} - dep_delay')} as arrival_minus_departure, {rd(f'dep_delay + {ARR}')} as total_delay,
        case when dep_delay > 0 and {ARR} > 0 then 1 else 0 end as delayed_both_ends, {rd(f'{ARR} / (dep_delay + 1)')} as delay_ratio, {rd('distance / (age + 1.0)')} as distance_per_age from survey"""),
)
def delay_ratios_and_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = {"delayed_both_ends"}
    return survey(spark, sf_dir).select("id", *[(c if n in exact else r(c)).alias(n) for n, c in D.ratios_and_differences().items()])


@query(
    "total_delay_and_distance_band", "D28",
    sql=survey_sql(f"select id, dep_delay + {ARR} as total_delay_minutes, case when distance <= 0 then null when distance <= 1000 then 'under_1000' when distance <= 3000 then '1000_to_3000' when distance <= 5000 then '3000_to_5000' else 'over_5000' end as flight_distance_band from survey"),
)
def total_delay_and_distance_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey(spark, sf_dir).select(
        "id",
        (F.coalesce("dep_delay", F.lit(0)) + F.coalesce("arr_delay", F.lit(0.0))).alias("total_delay_minutes"),
        S.right_closed_band("distance", D.BAND_EDGES, D.BAND_NAMES).alias("flight_distance_band"),
    )


@query(
    "rating_distribution_shape", "D29",
    sql=survey_sql(f"select id, greatest({', '.join(RATINGS)}) as max_rating, cast(list_sort([{', '.join(RATINGS)}])[7] as double) as median_rating, {count_sql('>= 4')} as count_at_4_or_5, {count_sql('= 3')} as count_at_3 from survey"),
)
def rating_distribution_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey(spark, sf_dir).select("id", *[c.alias(n) for n, c in D.rating_shape(RATINGS).items()])


RAW_STD = f"sqrt((13 * ({SQUARES}) - ({ANSWERED_SUM}) * ({ANSWERED_SUM})) / 156.0)"


@query(
    "rating_extras", "D30",
    sql=survey_sql(f"select id, {count_sql('= 5')} as count_at_5, {rd(RAW_STD)} as spread, {count_sql('= 0')} as count_at_0, {rd(f'''{RAW_MEAN} * case when class = 'Business' then 1 else 0 end''')} as mean_x_class from survey"),
)
def rating_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = {"spread", "mean_x_class"}
    extras = D.add_rating_extras(survey(spark, sf_dir), RATINGS)
    return extras.select("id", *[(r(n) if n in rounded else F.col(n)).alias(n) for n in ("count_at_5", "spread", "count_at_0", "mean_x_class")])


@query("zero_indicators", "D31", sql=survey_sql("select id, " + ", ".join(f"case when {c} = 0 then 1 else 0 end as {c}_was_zero" for c in RATINGS if c != "r11") + " from survey"))
def zero_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = D.add_zero_indicators(survey(spark, sf_dir), RATINGS)
    return frame.select("id", *[c for c in frame.columns if c.endswith("_was_zero")])


PRODUCTS = ["r1", "r6", "r7", "r8", "age", "distance", "dep_delay"]


@query("pairwise_products", "D32", sql=survey_sql("select id, " + ", ".join(f"{a} * {b} as {a}_x_{b}" for i, a in enumerate(PRODUCTS) for b in PRODUCTS[i + 1 :]) + " from survey"))
def pairwise_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey(spark, sf_dir).select("id", *[c.alias(n) for n, c in D.pairwise_products(PRODUCTS).items()])


@query(
    "class_relative_features", "D33",
    sql=survey_sql("select id, " + ", ".join(f"{rd(f'{c} - m_{c}')} as {c}_rel" for c in RATINGS) + " from survey join m on m.class = survey.class", tr=TRAIN, m="select class, " + ", ".join(f"avg({c}) as m_{c}" for c in RATINGS) + " from tr group by class"),
)
def class_relative_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir)
    return D.class_relative(rows, rows.where(is_train()), "class", RATINGS).select("id", *[r(f"{c}_rel").alias(f"{c}_rel") for c in RATINGS])


@query(
    "mean_rating_square_standardised", "D34",
    sql=survey_sql(
        f"select id, {rd('m * m')} as mean_sq, {rd('(m - a) / (s + 1e-6)', 5)} as mean_z, {rd('(m * m - a2) / (s2 + 1e-6)', 5)} as mean_sq_z from x, (select avg(m) as a, stddev_samp(m) as s, avg(m * m) as a2, stddev_samp(m * m) as s2 from x where id % 10 < 7) f",
        x=f"select id, coalesce({MEAN}, 3.0) as m from survey",
    ),
)
def mean_rating_square_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.coalesce(R.mean_rating(RATINGS), F.lit(3.0))
    rows = survey(spark, sf_dir).select("id", mean.alias("mean")).withColumn("mean_sq", F.col("mean") * F.col("mean"))
    z = D.standardise(rows, rows.where(is_train()), ["mean", "mean_sq"], eps=1e-6)
    return z.select("id", r("mean_sq").alias("mean_sq"), r("mean_z", 5).alias("mean_z"), r("mean_sq_z", 5).alias("mean_sq_z"))


@query(
    "log_and_logit_transforms", "D35", "J1",
    sql=survey_sql(f"select p.id, member, {rd('ln(1 + s.distance)')} as log_distance, {rd('ln(1 + s.dep_delay)')} as log_delay, {rd('ln(p / (1 - p))', 5)} as logit, {rd('1 / (1 + exp(-ln(p / (1 - p))))', 5)} as back from (select id, member, least(greatest(p, 1e-6), 1 - 1e-6) as p from pred) p join survey s on s.id = p.id", **MEMBER_SQL),
)
def log_and_logit_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = member_scores(spark, sf_dir).select("id", "member", "p")
    raw = survey(spark, sf_dir).select("id", "distance", "dep_delay")
    return scores.join(raw, "id").select(
        "id", "member", r(F.log1p("distance")).alias("log_distance"), r(F.log1p("dep_delay")).alias("log_delay"),
        r(S.logit("p"), 5).alias("logit"), r(S.sigmoid(S.logit("p")), 5).alias("back"),
    )
