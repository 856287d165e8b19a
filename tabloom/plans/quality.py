"""Queries for the data-quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import gates as G
from tabloom.plans.common import CATEGORICAL, CONTINUOUS, FOLDED, NUMERIC, RATINGS, r, rd
from tabloom.plans.member_data import folded_train
from tabloom.plans.registry import plain_sql, query, survey_sql
from tabloom.plans.scans import SHARES, SPLIT_SQL, labelled_splits
from tabloom.sources.contract import build_contract, column_table
from tabloom.sources.survey import RAW_FEATURES, is_train, survey, survey_split
from tabloom.sources.tables import read_table


def _filled_sql(table: str, column: str) -> str:
    return f"(select count({column}) from {table})"


@query(
    "required_columns_gate", "B1",
    sql=plain_sql("select subject, detail, coalesce(n_values, 0) as n_values, detail <> 'required' or coalesce(n_values, 0) > 0 as passed from x", x=" union all ".join(
        f"select '{c}' as subject, '{kind}' as detail, {_filled_sql('orders', c) if c not in ('o_label', 'o_comment') else 'null'} as n_values"
        for c, kind in [(c, "required") for c in ["o_orderkey", "o_custkey", "o_totalprice", "o_label"]] + [("o_comment", "optional"), ("o_orderdate", "optional"), ("o_orderstatus", "extra"), ("o_orderpriority", "extra")])),
)
def required_columns_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.required_columns(read_table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice", "o_label"], ["o_comment", "o_orderdate"])


@query(
    "columns_in_one_table", "B1",
    sql=" union all ".join(f"select '{c}' as column_name, '{side}' as side, {_filled_sql(t, c)} as n_values" for t, side, cs in [("documents", "left only", ["text", "lang", "source", "n_chars"]), ("labels", "right only", ["quality", "toxic"])] for c in cs),
)
def columns_in_one_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.compare_columns(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def _range_sql(columns: list[str], low: float, high: float) -> str:
    return " union all ".join(
        f"select 'value_range' as check_name, '{c}' as subject, count(*) filter (where {c} not between {low} and {high}) = 0 as passed, cast(count(*) filter (where {c} not between {low} and {high}) as double) as observed from survey"
        for c in columns
    )


@query("value_range_gate", "B2", sql=survey_sql(_range_sql(RATINGS + CONTINUOUS, 0, 5)))
def value_range_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.value_range(survey(spark, sf_dir), RATINGS + CONTINUOUS, 0, 5)


@query(
    "offending_values", "B2",
    sql=survey_sql("select feature, value, n from (" + " union all ".join(f"select '{c}' as feature, cast({c} as double) as value, count(*) as n from survey where {c} not between 1 and 5 group by {c}" for c in RATINGS) + ") o"),
)
def offending_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.offending_values(survey(spark, sf_dir), RATINGS, 1, 5)


def _missing_sql(columns: list[str], limit: float, rounding: int = 9) -> str:
    return " union all ".join(
        f"select 'missing_share' as check_name, '{c}' as subject, avg(case when {c} is null then 1.0 else 0.0 end) <= {limit} as passed, {rd(f'avg(case when {c} is null then 1.0 else 0.0 end)', rounding)} as observed from survey"
        for c in columns
    )


@query("missing_share_gate", "B3", sql=survey_sql(_missing_sql(RAW_FEATURES, 0.004)))
def missing_share_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.missing_share(survey(spark, sf_dir), RAW_FEATURES, 0.004).withColumn("observed", r("observed", 9))


@query("unique_key_gate", "B4", sql=plain_sql("select l_orderkey, count(*) as n from lineitem group by l_orderkey having count(*) > 1 order by l_orderkey limit 5"))
def unique_key_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.repeated_keys(read_table(spark, sf_dir, "lineitem", ["l_orderkey"]), "l_orderkey")


@query(
    "key_profile", "B5",
    sql=plain_sql("""select count(*) as n_rows, count(distinct l_orderkey) as n_distinct, count(*) - count(distinct l_orderkey) as n_repeated,
        min(l_orderkey) as first_key, max(l_orderkey) as last_key, max(l_orderkey) - min(l_orderkey) + 1 = count(distinct l_orderkey) as gapless from lineitem"""),
)
def key_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.key_profile(read_table(spark, sf_dir, "lineitem", ["l_orderkey"]), "l_orderkey")


@query(
    "key_order_breaks", "B5",
    sql=plain_sql("""select cast(count(*) as bigint) as breaks, count(*) = 0 as increasing from (
        select o_custkey <= lag(o_custkey) over (order by o_orderkey) as b from orders) x where b"""),
)
def key_order_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.order_breaks(read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]), "o_orderkey", "o_custkey")


@query("key_overlap", "B6", "F7", sql=plain_sql("select count(*) as n_overlap from documents where doc_id in (select doc_id from labels)"))
def key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.key_overlap(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "doc_id")


@query(
    "key_ranges_disjoint", "B7",
    sql=survey_sql("""select min(id) filter (where id % 10 < 7) as left_min, max(id) filter (where id % 10 < 7) as left_max,
        min(id) filter (where id % 10 >= 7) as right_min, max(id) filter (where id % 10 >= 7) as right_max,
        max(id) filter (where id % 10 < 7) < min(id) filter (where id % 10 >= 7) or max(id) filter (where id % 10 >= 7) < min(id) filter (where id % 10 < 7) as disjoint from survey"""),
)
def key_ranges_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir)
    return G.key_ranges(rows.where(is_train()), rows.where(~is_train()), "id")


DUP = ["class", "customer_type", "travel_type", "gender", "age", "r6"]


@query("duplicate_rows", "B8", sql=survey_sql(f"select cast(sum(n - 1) as bigint) as n_duplicates, cast(sum(n) as bigint) as n_rows from (select count(*) as n from survey group by {', '.join(DUP)}) d"))
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.duplicate_rows(survey(spark, sf_dir).select("id", "label", *DUP), ["id", "label"])


@query(
    "row_count_tolerance", "B9",
    sql=survey_sql(
        "select 'row_count' as check_name, split as subject, abs(n - want) <= 0.01 * want as passed, cast(n as double) as observed from (select split, count(*) as n, case split when 'train' then 0.7 else 0.15 end * sum(count(*)) over () as want from s group by split) x",
        s=SPLIT_SQL,
    ),
)
def row_count_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.row_count_tolerance(labelled_splits(spark, sf_dir, []), "split", SHARES)


@query(
    "label_rate_stability", "B10",
    sql=survey_sql(f"""select cast(tile as integer) as tile, {rd('rate')} as label_rate, n, max(rate) over () - min(rate) over () < 0.05 as passed
        from (select tile, avg(label) as rate, count(*) as n from (select label, ntile(10) over (order by id) as tile from survey) t group by tile) x"""),
)
def label_rate_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.label_rate_stability(survey(spark, sf_dir), "id", "label").withColumn("label_rate", r("label_rate"))


@query(
    "base_rate_parity", "B11",
    sql=survey_sql(f"select 'base_rate_parity' as check_name, 'split' as subject, gap <= 0.01 as passed, {rd('gap')} as observed from (select max(rate) - min(rate) as gap from (select avg(label) as rate from s group by split) x) y", s=SPLIT_SQL),
)
def base_rate_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.base_rate_parity(labelled_splits(spark, sf_dir, []), "split", "label").withColumn("observed", r("observed"))


@query(
    "quality_report", "B12",
    sql=survey_sql(
        f"""{_range_sql(RATINGS, 0, 5)} union all {_missing_sql(CONTINUOUS, 0.01, 6)}
        union all select 'unique_key', 'id', count(*) = 0, cast(count(*) as double) from (select id from survey group by id having count(*) > 1) k"""
    ),
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir)
    report = G.quality_report(G.value_range(rows, RATINGS, 0, 5), G.missing_share(rows, CONTINUOUS, 0.01), G.unique_key(rows, "id"))
    return G.require(report).withColumn("observed", r("observed"))


@query(
    "feature_contract_gate", "B13",
    sql=survey_sql("""select * from (values ('missing', 'r13'), ('unlisted', 'extra'), ('banned', 'id'), ('order', 'age'), ('order', 'distance'), ('pending_used', 'r12')) t(violation, feature)
        union all select 'no_levels', 'gender' where (select count(*) from survey where gender is not null) = 0"""),
)
def feature_contract_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir)
    contract = build_contract(rows.where(is_train()), ["id", *RAW_FEATURES], CATEGORICAL)
    order = [c if c not in ("age", "distance") else {"age": "distance", "distance": "age"}[c] for c in ["id", *RAW_FEATURES] if c != "r13"]
    scored = rows.select(*order, "label", F.lit(1).alias("extra"))
    return G.contract_violations(contract, column_table(scored), banned=["id", "label"], pending=["r12"])


@query(
    "feature_null_gate", "B14",
    sql=survey_sql("select feature, n_null from (" + " union all ".join(f"select '{c}' as feature, count(*) filter (where {c} is null) as n_null from survey" for c in RAW_FEATURES) + ") x where n_null > 0"),
)
def feature_null_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.feature_nulls(survey(spark, sf_dir), RAW_FEATURES)


@query(
    "unseen_category_gate", "B15",
    sql=survey_sql(" union all ".join(f"select '{c}' as feature, cast({c} as varchar) as value, count(*) as n from survey where id % 10 >= 7 and {c} not in (select {c} from survey where id % 10 < 7 and {c} is not null) group by {c}" for c in ["o_custkey", "class", "distance"])),
)
def unseen_category_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir)
    return G.unseen_values(rows.where(~is_train()), rows.where(is_train()), ["o_custkey", "class", "distance"])


@query(
    "oof_coverage_gate", "B16",
    sql=plain_sql("""select count(*) filter (where o.o_orderkey is not null and n is null) as n_missing, count(*) filter (where o.o_orderkey is not null and n > 1) as n_repeated,
        count(*) filter (where o.o_orderkey is null) as n_foreign,
        count(*) filter (where (o.o_orderkey is not null and n is null) or (o.o_orderkey is not null and n > 1) or o.o_orderkey is null) = 0 as passed
        from orders o full join (select l_orderkey, count(*) as n from lineitem group by l_orderkey) l on o_orderkey = l_orderkey"""),
)
def oof_coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = read_table(spark, sf_dir, "lineitem", ["l_orderkey"]).withColumnRenamed("l_orderkey", "o_orderkey")
    return G.oof_coverage(scored, read_table(spark, sf_dir, "orders", ["o_orderkey"]), "o_orderkey")


@query(
    "oof_coverage_of_folds", "B16",
    sql=survey_sql("select cast(0 as bigint) as n_missing, count(*) - count(distinct id) as n_repeated, cast(0 as bigint) as n_foreign, true as passed from tr", tr=FOLDED),
)
def oof_coverage_of_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = survey(spark, sf_dir).where(is_train()).select("id")
    return G.oof_coverage(folded_train(spark, sf_dir, []), train, "id")
