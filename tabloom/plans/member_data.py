"""Members for the stacking and evaluation queries: out-of-fold rates of single columns.

Each member is the leak-safe rate of one column, so a member's score can be
recomputed in SQL; fitted spark.ml members go through the same prediction table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.folds import stratified_folds
from tabloom.operators.lookup import fitted
from tabloom.operators.target_encode import oof_rates
from tabloom.plans.common import FOLDED, FOLDS, SEED, SMOOTHING, r
from tabloom.sources.survey import is_train, survey

MEMBERS = {"m_r6": ["r6"], "m_class": ["class"], "m_r1_r7": ["r1", "r7"], "m_age": ["age"]}


def folded_train(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    train = survey(spark, sf_dir).where(is_train())
    if columns is not None:
        train = train.select("id", "label", *columns)
    return stratified_folds(train, "id", "label", FOLDS, SEED)


def member_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored prediction table (id, label, fold, member, p).

    p is rounded to 9 digits so that ties are the same everywhere.
    """
    train = fitted(folded_train(spark, sf_dir, sorted({c for keys in MEMBERS.values() for c in keys})), "folds")
    key_sets = {m: [F.col(k) for k in keys] for m, keys in MEMBERS.items()}
    rates = oof_rates(train, ["id"], key_sets, "label", "fold", SMOOTHING)
    return fitted(rates.select("id", "label", "fold", F.col("key_set").alias("member"), r("rate", 9).alias("p")), "members")


MEMBER_SQL = {
    "tr": FOLDED,
    "mlong": " union all ".join(
        f"select id, label, fold, '{m}' as member, concat_ws('|', {', '.join(f'cast({k} as varchar)' for k in keys)}) as kv from tr"
        for m, keys in MEMBERS.items()
    ),
    "mcells": "select member, kv, fold, cast(sum(label) as double) as s, count(*) as n from mlong group by all",
    "mfold": "select fold, cast(sum(label) as double) as s, count(*) as n from tr group by fold",
    "mpri": "select a.fold, (sum(b.s) - a.s) / (sum(b.n) - a.n) as pr from mfold a, mfold b group by a.fold, a.s, a.n",
    "mte": f"""select c.member, c.kv, c.fold,
        (sum(c.s) over w - c.s + pr * {SMOOTHING}) / (sum(c.n) over w - c.n + {SMOOTHING}) as te
        from mcells c join mpri on mpri.fold = c.fold window w as (partition by c.member, c.kv)""",
    "pred": """select l.id, l.label, l.fold, l.member, round(t.te, 9) + 0.0 as p
        from mlong l join mte t on l.member = t.member and l.kv = t.kv and l.fold = t.fold""",
    "wide": "select id, label, fold, " + ", ".join(f"max(case when member = '{m}' then p end) as {m}" for m in MEMBERS) + " from pred group by id, label, fold",
}
