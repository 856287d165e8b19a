"""Queries for scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.folds import stratified_split
from tabloom.operators.ranks import auc
from tabloom.plans.common import CATEGORICAL, CONTINUOUS, RATINGS, SEED, auc_sql, hash_hex_sql, r, rd
from tabloom.plans.member_data import MEMBER_SQL, MEMBERS, member_scores
from tabloom.plans.registry import plain_sql, query, survey_sql
from tabloom.session import scratch_path
from tabloom.sources import contract as C
from tabloom.sources import sinks as S
from tabloom.sources import tables as T
from tabloom.sources.survey import RAW_FEATURES, is_train, survey, survey_split

# Split shares.
SHARES = {"train": 0.70, "validation": 0.15, "test": 0.15}

SPLIT_SQL = f"""select *, case when pos < floor(cnt * 0.7) then 'train' when pos < floor(cnt * 0.85) then 'validation' else 'test' end as split
  from (select *, row_number() over (partition by label order by {hash_hex_sql()}, id) - 1 as pos, count(*) over (partition by label) as cnt
        from survey where id % 10 < 7) p"""


def labelled_splits(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    labelled = survey(spark, sf_dir).where(is_train()).select("id", "label", *columns)
    return stratified_split(labelled, "id", "label", SHARES, SEED)


@query("csv_table_scan", "A1", sql=survey_sql("select * exclude (o_custkey) from survey"))
def csv_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = survey(spark, sf_dir).drop("o_custkey")
    path = scratch_path(spark, "csv")
    S.save_csv(table, path)
    return T.read_csv_table(spark, path, table.schema)


@query(
    "typed_pruned_scan", "A2",
    sql=survey_sql("""select cast(age as float) as age, cast(distance as float) as distance, cast(arr_delay as float) as arr_delay,
        cast(r6 as float) as r6, class, cast(label as tinyint) as label from survey"""),
)
def typed_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.typed_scan(survey(spark, sf_dir), ["age", "distance", "arr_delay", "r6", "class"], "label", ["class"])


@query(
    "row_limited_scan", "A3",
    sql=survey_sql("select id, age, distance, class from survey where id % 10 >= 7 order by id limit 1000"),
)
def row_limited_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir).where(~is_train()).select("id", "age", "distance", "class")
    return T.first_rows(rows, "id", 1000)


@query("multi_split_union_scan", "A4", sql=survey_sql("select id, label, age, class, split from s", s=SPLIT_SQL))
def multi_split_union_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    labelled_splits(spark, sf_dir, ["age", "class"]).write.partitionBy("split").parquet(path)
    return T.union_splits({name: spark.read.parquet(f"{path}/split={name}") for name in SHARES}, "id")


@query(
    "scoring_rows_scan", "A5",
    sql=survey_sql("select id, age, distance, arr_delay, class, r6 from survey where id % 10 >= 7"),
)
def scoring_rows_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "by-split")
    survey_split(spark, sf_dir).write.partitionBy("split").parquet(path)
    return T.scoring_rows(spark.read.parquet(path), ["id", "age", "distance", "arr_delay", "class", "r6"])


@query("table_sink", "A6", sql=plain_sql("select * from part"))
def table_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.save_table(T.read_table(spark, sf_dir, "part"), scratch_path(spark, "table"))


@query("split_id_sink_replay", "A7", sql=survey_sql("select id, distance, split from s", s=SPLIT_SQL))
def split_id_sink_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "split-ids")
    S.save_split_ids(labelled_splits(spark, sf_dir, []), "id", path)
    return S.replay_split(survey(spark, sf_dir).select("id", "distance"), "id", path)


@query(
    "feature_contract_round_trip", "A8",
    sql=survey_sql(
        "select feature, position, kind, levels, reason from ("
        + " union all ".join(
            f"select '{f}' as feature, {i} as position, 'category' as kind, (select string_agg(distinct {f}, '|' order by {f}) from survey where id % 10 < 7) as levels, cast(null as varchar) as reason"
            if f in CATEGORICAL
            else f"select '{f}' as feature, {i} as position, 'number' as kind, cast(null as varchar) as levels, cast(null as varchar) as reason"
            for i, f in enumerate(RAW_FEATURES)
        )
        + " union all select 'id', -1, 'dropped', null, 'row key') c"
    ),
)
def feature_contract_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = survey(spark, sf_dir).where(is_train())
    path = scratch_path(spark, "contract")
    C.save_contract(C.build_contract(train, RAW_FEATURES, CATEGORICAL, {"id": "row key"}), path)
    return C.load_contract(spark, path).withColumn("levels", F.array_join("levels", "|"))


@query(
    "split_report", "A9",
    sql=survey_sql(f"select split, count(*) as n, {rd('avg(label)', 4)} as label_rate from s group by split", s=SPLIT_SQL),
)
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = labelled_splits(spark, sf_dir, [])
    return splits.groupBy("split").agg(F.count("*").alias("n"), r(F.avg("label"), 4).alias("label_rate"))


def _prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "predictions")
    S.write_predictions(member_scores(spark, sf_dir).withColumn("split", F.lit("train")), path)
    return S.read_predictions(spark, path)


@query("member_prediction_table", "A10", sql=survey_sql("select id, 'train' as split, fold, label, member, p from pred", **MEMBER_SQL))
def member_prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prediction_table(spark, sf_dir).select("id", "split", "fold", "label", "member", "p")


@query(
    "fold_count_mismatch", "A10", sql=survey_sql("select 'short' as member, cast(3 as bigint) as folds"),
    note="a member with predictions for three folds only, among whole ones",
)
def fold_count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = member_scores(spark, sf_dir)
    short = scores.where("member = 'm_r6' and fold < 3").withColumn("member", F.lit("short"))
    return S.fold_count_mismatch(scores.unionByName(short))


@query("member_export_wide", "A11", sql=survey_sql(f"select id, {', '.join(MEMBERS)} from wide", **MEMBER_SQL))
def member_export_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "export")
    S.save_csv(S.wide_predictions(member_scores(spark, sf_dir), list(MEMBERS)), path)
    return spark.read.schema("id bigint, " + ", ".join(f"{m} double" for m in MEMBERS)).csv(path, header=True)


@query(
    "run_roster_append", "A12",
    sql=survey_sql(
        f"select a.member, 'rate' as kind, {rd('auc')} as auc, cast(f.folds as bigint) as folds, 42 as seed from a join (select member, count(distinct fold) as folds from pred group by member) f on a.member = f.member",
        **MEMBER_SQL, a=auc_sql("pred", "p", by=["member"]),
    ),
)
def run_roster_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "roster")
    scores = member_scores(spark, sf_dir)
    folds = scores.groupBy("member").agg(F.count_distinct("fold").alias("folds"))
    rows = auc(scores, "p", "label", by=["member"]).join(folds, "member").select(
        "member", F.lit("rate").alias("kind"), r("auc").alias("auc"), "folds", F.lit(SEED).alias("seed")
    )
    first = F.col("member") == "m_r6"
    for run, part in (("first", rows.where(first)), ("second", rows.where(~first)), ("second", rows.where(~first))):  # a re-run adds nothing
        S.append_roster(part, path, run)
    return S.read_roster(spark, path)


@query(
    "scored_export", "A13",
    sql=survey_sql("select id, round((r6 + r1) / 10.0, 6) + 0.0e0 as label from survey where id % 10 >= 7"),
)
def scored_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir).where(~is_train())
    scored = rows.select(r((F.col("r6") + F.col("r1")) / 10).alias("label"), "id")
    template = rows.select("id", F.lit(0.0).alias("label"))
    path = scratch_path(spark, "scored")
    S.write_scored(scored, template, path)
    return spark.read.schema("id bigint, label double").csv(path, header=True)


@query(
    "scored_export_check", "A13",
    sql=survey_sql("""select (select count(*) from survey where r6 > 0) as rows_scored, (select count(*) from survey where id % 10 >= 7) as rows_wanted,
        (select count(*) from survey where id % 10 >= 7 and r6 = 0) as not_scored, (select count(*) from survey where r6 > 0 and id % 10 < 7) as not_wanted"""),
)
def scored_export_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir)
    return S.check_against_template(rows.where("r6 > 0"), rows.where(~is_train()))


@query(
    "step_metrics", "A16",
    sql=survey_sql("""select 'read' as step, 'rows' as fact, cast(count(*) as double) as value from survey
        union all select 'train', 'rows', cast(count(*) as double) from survey where id % 10 < 7
        union all select 'train', 'positives', cast(sum(label) as double) from survey where id % 10 < 7"""),
)
def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = S.StepMetrics(spark)
    rows = metrics.observe(survey(spark, sf_dir), "read")
    train = metrics.observe(rows.where(is_train()), "train", positives=F.sum("label"))
    S.save_table(train, scratch_path(spark, "observed"))
    return metrics.table()


FP_COLUMNS = ["id", *CONTINUOUS, *CATEGORICAL, *RATINGS]


@query(
    "table_fingerprint", "A17",
    sql=survey_sql(
        "select count(*) as rows, printf('%08x', cast(sum(cast(cast(('0x' || substr(md5(concat_ws('|', "
        + ", ".join(f"coalesce(cast({c} as varchar), '~')" for c in FP_COLUMNS)
        + ")), 1, 8)) as bigint) as hugeint)) % 4294967296 as bigint)) as digest from survey"
    ),
)
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fingerprint(survey(spark, sf_dir), FP_COLUMNS)
