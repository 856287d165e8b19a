"""Queries for categorical encodings, group statistics and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.scalars import code_of
from tabloom.operators import derive as D
from tabloom.operators import encode as E
from tabloom.operators import group_stats as G
from tabloom.operators.lookup import fitted
from tabloom.plans.common import CATEGORICAL, CONTINUOUS, FOLDED, NUMERIC, RATINGS, SECOND, SMOOTHING, TRAIN, hash_hex_sql, r, rd
from tabloom.plans.member_data import folded_train
from tabloom.plans.registry import plain_sql, query, survey_sql
from tabloom.sources.survey import RAW_FEATURES, is_train, second_survey, survey
from tabloom.sources.tables import read_table

LEVELS = {
    "gender": ["Female", "Male"],
    "customer_type": ["Loyal Customer", "disloyal Customer"],
    "travel_type": ["Business travel", "Personal Travel"],
    "class": ["Business", "Eco", "Eco Plus"],
}


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = survey(spark, sf_dir)
    return rows, rows.where(is_train())


def _levels_sql(c: str, source: str, extra: str = "") -> str:
    return f"select '{c}' as feature, cast({c} as varchar) as level, cast(row_number() over (order by cast({c} as varchar)) - 1 as integer) as code from {source} where {c} is not null {extra} group by {c}"


VOC = {"tr": TRAIN, "voc": " union all ".join(_levels_sql(c, "tr") for c in CATEGORICAL)}


def _code_sql(c: str, source: str = "voc") -> str:
    return f"(select v.code from {source} v where v.feature = '{c}' and v.level = survey.{c})"


@query("pinned_category_codes", "E1", sql=survey_sql("select id, " + ", ".join(f"cast({_code_sql(c)} as integer) as {c}_code" for c in CATEGORICAL) + " from survey", **VOC))
def pinned_category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = _split(spark, sf_dir)
    return E.pinned_codes(rows, train, CATEGORICAL).select("id", *[F.col(f"{c}_code").cast("int").alias(f"{c}_code") for c in CATEGORICAL])


@query("category_vocabulary", "E2", sql=survey_sql("select feature, level, code from voc", **VOC))
def category_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.vocabulary(_split(spark, sf_dir)[1], CATEGORICAL)


def _column(text: str) -> str:
    return text.replace(" ", "_")


@query("one_hot_encoding", "E3", sql=survey_sql("select id, " + ", ".join(f"case when {c} = '{v}' then 1 else 0 end as {_column(c + '_' + v)}" for c, vs in LEVELS.items() for v in [*vs, 'Absent']) + " from survey"))
def one_hot_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = {c: [*vs, "Absent"] for c, vs in LEVELS.items()}
    return survey(spark, sf_dir).select("id", *[v.alias(_column(n)) for n, v in E.one_hot(levels).items()])


@query(
    "restored_encoding", "E4",
    sql=survey_sql(f"select id, cast({_code_sql('class')} as double) as class_code, cast({_code_sql('gender')} as double) as gender_code from survey", tr=TRAIN,
                   voc=_levels_sql("class", "tr", "and class <> 'Eco Plus'") + " union all " + _levels_sql("gender", "tr", "and class <> 'Eco Plus'")),
)
def restored_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = _split(spark, sf_dir)
    levels = E.vocabulary(train.where("class <> 'Eco Plus'"), ["class", "gender"])
    coded = E.apply_vocabulary(rows, levels, ["class", "gender"])
    return coded.select("id", F.col("class_code").cast("double").alias("class_code"), F.col("gender_code").cast("double").alias("gender_code"))


@query(
    "ordinal_map", "E5",
    sql=survey_sql("select id, case class when 'Business' then 0 when 'Eco' then 1 when 'Eco Plus' then 2 else 0 end as class_code, case travel_type when 'Business travel' then 0 else 1 end as travel_code, case customer_type when 'Loyal Customer' then 0 else 1 end as customer_code from survey"),
)
def ordinal_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey(spark, sf_dir).select(
        "id", code_of("class", D.CLASS_CODES).alias("class_code"), code_of("travel_type", D.TRAVEL_CODES).alias("travel_code"),
        code_of("customer_type", D.CUSTOMER_CODES).alias("customer_code"),
    )


def _key_sql(columns: list[str], sep: str) -> str:
    """Twin of ``text_key``."""
    parts = [rf"coalesce(replace(replace(cast({c} as varchar), '\', '\\'), '{sep}', '\{sep}'), '\N')" for c in columns]
    return f"concat_ws('{sep}', {', '.join(parts)})"


FACTOR = _key_sql(["class", "arr_delay"], "|")


@query("factorise", "E6", sql=survey_sql("select id, code from survey join k on k.kv = " + FACTOR, k=f"select kv, row_number() over (order by {hash_hex_sql('kv', 'factorise')}, kv) - 1 as code from (select distinct {FACTOR} as kv from survey) d"))
def factorise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.factorise(survey(spark, sf_dir).select("id", "class", "arr_delay"), ["class", "arr_delay"]).select("id", "code")


@query("composite_key_groups", "E7", sql=survey_sql(f"select {FACTOR} as composite, count(*) as n, {rd('avg(label)')} as rate from survey group by 1"))
def composite_key_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = survey(spark, sf_dir).groupBy("class", "arr_delay").agg(F.count("*").alias("n"), r(F.avg("label")).alias("rate"))
    return grouped.select(E.composite_key(["class", "arr_delay"]).alias("composite"), "n", "rate")


# The column pairs that are encoded jointly.
PAIRS = [
    ("class", "travel_type"), ("customer_type", "travel_type"), ("class", "customer_type"), ("gender", "class"), ("r1", "r6"),
    ("r1", "travel_type"), ("r6", "travel_type"), ("r7", "r8"), ("class", "r1"), ("class", "r6"),
]


@query("pair_keys", "E8", sql=survey_sql("select id, " + ", ".join(f"{_key_sql([a, b], '_')} as pair_{a}_{b}" for a, b in PAIRS) + " from survey"))
def pair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey(spark, sf_dir).select("id", *[v.alias(n) for n, v in E.pair_keys(PAIRS).items()])


COUNTED = ["age", "distance", "arr_delay", "o_custkey"]


def _cnt(c: str, source: str = "tr") -> str:
    return f"coalesce((select count(*) from {source} t where t.{c} = survey.{c}), 0)"


@query("value_counts", "E9", sql=survey_sql("select id, " + ", ".join(f"cast(coalesce(n_{c}, 0) as bigint) as cnt_{c}" for c in COUNTED) + " from survey " + " ".join(f"left join (select {c} as k_{c}, count(*) as n_{c} from tr where {c} is not null group by {c}) on k_{c} = {c}" for c in COUNTED), tr=TRAIN))
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = _split(spark, sf_dir)
    return E.add_value_counts(rows, train, COUNTED).select("id", *[f"cnt_{c}" for c in COUNTED])


@query(
    "frequency_and_rarity", "E10",
    sql=survey_sql("select id, " + ", ".join(f"{rd(f'coalesce(n_{c}, 0) / nt', 9)} as freq_{c}, {rd(f'-ln(greatest(coalesce(n_{c}, 0) / nt, 1.0 / nt))')} as rarity_{c}" for c in COUNTED) + " from survey " + " ".join(f"left join (select {c} as k_{c}, cast(count(*) as double) as n_{c} from tr where {c} is not null group by {c}) on k_{c} = {c}" for c in COUNTED) + ", (select cast(count(*) as double) as nt from tr) z", tr=TRAIN),
)
def frequency_and_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = _split(spark, sf_dir)
    out = E.add_frequencies(rows, train, COUNTED)
    return out.select("id", *[r(f"freq_{c}", 9).alias(f"freq_{c}") for c in COUNTED], *[r(f"rarity_{c}").alias(f"rarity_{c}") for c in COUNTED])


@query("category_frequency", "E11", sql=plain_sql(f"select event_id, event_type, {rd('count(*) over (partition by event_type) / cast(count(*) over () as double)', 9)} as share from events"))
def category_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events", ["event_id", "event_type"])
    return E.category_share(events, "event_type").withColumn("share", r("share", 9))


@query("pooled_counts", "E12", sql=survey_sql(" union all ".join(f"select '{c}' as feature, cast({c} as varchar) as value, count(*) as n from survey where {c} is not null group by {c}" for c in ["age", "distance", "class"])))
def pooled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = _split(spark, sf_dir)
    return E.pooled_counts([train, rows.where(~is_train())], ["age", "distance", "class"])


TWINS = ["age", "distance", "dep_delay", "arr_delay"]


def _twin_sql(c: str) -> str:
    return f"cast(cast(coalesce({c}, 0) as integer) as varchar)"


TWIN_VOC = " union all ".join(f"select '{c}_cat_' as feature, level, cast(row_number() over (order by level) - 1 as integer) as code from (select distinct {_twin_sql(c)} as level from survey) l" for c in TWINS)


@query("categorical_twins", "D25", sql=survey_sql("select id, " + ", ".join(f"{_twin_sql(c)} as {c}_cat_, cast(v_{c}.code as double) as {c}_cat__code" for c in TWINS) + " from survey " + " ".join(f"left join voc v_{c} on v_{c}.feature = '{c}_cat_' and v_{c}.level = {_twin_sql(c)}" for c in TWINS), voc=TWIN_VOC))
def categorical_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir)
    names = E.twin_names(TWINS)
    twins = rows.select("id", *[v.alias(n) for n, v in names.items()])
    coded = E.apply_vocabulary(twins, E.twin_vocabulary([rows.where(is_train()), rows.where(~is_train())], TWINS), list(names))
    return coded.select("id", *names, *[F.col(f"{n}_code").cast("double").alias(f"{n}_code") for n in names])


@query("twin_vocabulary", "D26", sql=survey_sql("select feature, level, code from voc", voc=TWIN_VOC))
def twin_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir)
    return E.twin_vocabulary([rows.where(is_train()), rows.where(~is_train())], TWINS)


ROUTE_NUM = [c for c in NUMERIC if c != "distance"]
ROUTE_SQL = {
    "tr": TRAIN,
    "g": "select " + ", ".join(f"avg({c}) as g_{c}" for c in ROUTE_NUM) + ", avg(label) as g_rate from tr",
    "route": "select o_custkey as k, count(*) as n, " + ", ".join(f"avg({c}) as m_{c}" for c in ROUTE_NUM) + f", (sum(label) + {SMOOTHING} * (select g_rate from g)) / (count(*) + {SMOOTHING}) as rate from tr group by o_custkey",
}


@query("route_table", "F1", sql=survey_sql("select k as o_custkey, n as route_size, " + ", ".join(f"{rd(f'm_{c}')} as route_mean_{c}" for c in ROUTE_NUM) + f", {rd('rate')} as route_rate from route", **ROUTE_SQL))
def route_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = G.route_table(_split(spark, sf_dir)[1], "o_custkey", ROUTE_NUM, "label", SMOOTHING)
    return table.select("o_custkey", "route_size", *[r(c).alias(c) for c in table.columns if c not in ("o_custkey", "route_size")])


@query(
    "route_features", "F2",
    sql=survey_sql("select id, coalesce(n, 0) as route_size, " + ", ".join(f"{rd(f'coalesce({c} - coalesce(m_{c}, g_{c}), 0)')} as routediff_{c}" for c in ROUTE_NUM) + f", {rd('coalesce(rate, g_rate)')} as route_rate from survey left join route on k = o_custkey, g", **ROUTE_SQL),
)
def route_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = _split(spark, sf_dir)
    table = G.route_table(train, "o_custkey", ROUTE_NUM, "label", SMOOTHING)
    out = G.apply_route(rows, table, train, "o_custkey", ROUTE_NUM, "label")
    return out.select("id", "route_size", *[r(f"routediff_{c}").alias(f"routediff_{c}") for c in ROUTE_NUM], r("route_rate").alias("route_rate"))


@query("route_profile_all_rows", "F3", sql=survey_sql("select id, " + ", ".join(f"{rd(f'avg({c}) over (partition by distance)')} as fdm_{c}" for c in ROUTE_NUM) + ", count(*) over (partition by distance) as fd_cnt from survey"))
def route_profile_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.key_profile_columns(survey(spark, sf_dir), "distance", ROUTE_NUM)
    return out.select("id", *[r(f"fdm_{c}").alias(f"fdm_{c}") for c in ROUTE_NUM], "fd_cnt")


@query(
    "second_table_lookup", "F4",
    sql=survey_sql("select id, " + ", ".join(f"{rd(f'x_{c}')} as om_{c}" for c in RAW_FEATURES) + " from tr " + " ".join(f"left join (select {c} as k_{c}, avg(label) as x_{c} from second where {c} is not null group by {c}) on k_{c} = {c}" for c in RAW_FEATURES), tr=TRAIN, second=SECOND),
)
def second_table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, train = _split(spark, sf_dir)
    rates = G.second_table_rates(second_survey(spark, sf_dir), RAW_FEATURES, "label")
    return G.apply_second_table_rates(train, rates, RAW_FEATURES).select("id", *[r(f"om_{c}").alias(f"om_{c}") for c in RAW_FEATURES])


@query("unseen_key_count", "F5", sql=survey_sql("select count(*) as n_rows, count(distinct o_custkey) as n_keys from survey where id % 10 >= 7 and o_custkey not in (select o_custkey from survey where id % 10 < 7)"))
def unseen_key_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = _split(spark, sf_dir)
    return G.unseen_keys(rows.where(~is_train()), train, "o_custkey")


@query("id_realignment_join", "F6", sql=survey_sql(f"select id, fold, {', '.join(CATEGORICAL)} from tr", tr=FOLDED))
def id_realignment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = folded_train(spark, sf_dir, []).select("id", "fold")
    return G.realign(prepared, survey(spark, sf_dir), "id", CATEGORICAL)


@query("anti_join_coverage", "F7", sql=plain_sql("select source, count(*) as n_unlabelled from documents where doc_id not in (select doc_id from labels) group by source"))
def anti_join_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents", ["doc_id", "source"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id"])
    return documents.join(labels, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n_unlabelled"))


MERGED = ["class", "travel_type", "r6", "r1", "age"]


@query("second_table_merge", "F8", sql=survey_sql(f"select {', '.join(MERGED)}, cast(label as integer) as answer from tr union select {', '.join(MERGED)}, cast(label as integer) from second", tr=TRAIN, second=SECOND))
def second_table_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("label") == 1, "satisfied").otherwise("neutral or dissatisfied").alias("answer")
    first, second = survey(spark, sf_dir).where(is_train()).select(*MERGED, answer), second_survey(spark, sf_dir).select(*MERGED, answer)
    return G.merge_tables([first, second.select("answer", *MERGED, F.lit("b").alias("file"))], "answer", {"satisfied": 1, "neutral or dissatisfied": 0})


EXPECT = {"r6": ["class", "r1"], "r1": ["class", "r6"], "r7": ["travel_type", "r8"]}


def _expect_sql(t: str, keys: list[str]) -> str:
    ks = ", ".join(keys)
    return f"""select distinct {ks}, {t}, fold, coalesce((vn - n) / nullif(kn - fn, 0), 0) as p, (ks - fs) / nullif(kn - fn, 0) as ev from (
        select {ks}, {t}, fold, cast(count(*) over (partition by {ks}, {t}) as double) as vn, count(*) over (partition by {ks}, {t}, fold) as n,
        count(*) over (partition by {ks}) as kn, count(*) over (partition by {ks}, fold) as fn,
        cast(sum({t}) over (partition by {ks}) as double) as ks, sum({t}) over (partition by {ks}, fold) as fs from tr) x"""


@query(
    "conditional_frequency_expectation", "I16",
    sql=survey_sql(
        "select tr.id, " + ", ".join(f"{rd(f'x_{t}.p')} as aux_p_{t}, {rd(f'x_{t}.ev')} as aux_ev_{t}" for t in EXPECT)
        + ", " + rd(" + ".join(f"ln(greatest(x_{t}.p, 1e-6))" for t in EXPECT)) + " as aux_sum_logp from tr "
        + " ".join(f"left join x_{t} on " + " and ".join(f"x_{t}.{k} = tr.{k}" for k in [*keys, t, "fold"]) for t, keys in EXPECT.items()),
        tr=FOLDED, **{f"x_{t}": _expect_sql(t, keys) for t, keys in EXPECT.items()},
    ),
)
def conditional_frequency_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.expectation_columns(fitted(folded_train(spark, sf_dir), "folds"), EXPECT, "fold")
    return out.select("id", *[r(f"aux_{k}_{t}").alias(f"aux_{k}_{t}") for t in EXPECT for k in ("p", "ev")], r("aux_sum_logp").alias("aux_sum_logp"))
