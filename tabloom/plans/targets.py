"""Queries for leak-safe target encodings, folds, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import folds as Fo
from tabloom.operators import target_encode as T
from tabloom.operators.derive import modular_keys
from tabloom.operators.lookup import fitted
from tabloom.plans.common import FOLDED, FOLDS, SEED, SMOOTHING, TRAIN, hash_fold_sql, hash_hex_sql, hash_number_sql, r, rd
from tabloom.plans.encodings import PAIRS
from tabloom.plans.member_data import folded_train
from tabloom.plans.registry import plain_sql, query, survey_sql
from tabloom.plans.scans import SHARES, SPLIT_SQL, labelled_splits
from tabloom.sources.survey import RAW_FEATURES, is_train, survey
from tabloom.sources.tables import read_table

# The key sets that are encoded.
KEY_SETS = {
    "te_distance": ["distance"],
    "te_age": ["age"],
    "te_distance_age": ["distance", "age"],
    "te_distance_class": ["distance", "class"],
    "te_distance_travel": ["distance", "travel_type"],
    "te_profile": ["age", "class", "travel_type", "customer_type"],
}


def _oof_ctes(name: str, keys: list[str], prior: str = "fold") -> dict[str, str]:
    ks = ", ".join(keys)
    return {
        f"c_{name}": f"select {ks}, fold, cast(sum(label) as double) as s, count(*) as n from tr group by all",
        f"{name}": f"""select {', '.join('c.' + k for k in keys)}, c.fold,
            (sum(c.s) over w - c.s + {'pri.p' if prior == 'fold' else '(select avg(label) from tr)'} * {SMOOTHING}) / (sum(c.n) over w - c.n + {SMOOTHING}) as te
            from c_{name} c join pri on pri.fold = c.fold window w as (partition by {', '.join('c.' + k for k in keys)})""",
    }


PRIOR = {
    "per_fold": "select fold, cast(sum(label) as double) as s, count(*) as n from tr group by fold",
    "pri": "select a.fold, (sum(b.s) - a.s) / (sum(b.n) - a.n) as p from per_fold a, per_fold b group by a.fold, a.s, a.n",
}


def _on(name: str, keys: list[str], left: str = "tr", fold: bool = True) -> str:
    return " and ".join(f"{name}.{k} is not distinct from {left}.{k}" for k in [*keys, *(["fold"] if fold else [])])


@query("oof_route_target", "G1", sql=survey_sql(f"select tr.id, tr.fold, {rd('x.te', 9)} as te from tr join x on {_on('x', ['distance'])}", tr=FOLDED, **PRIOR, **_oof_ctes("x", ["distance"])))
def oof_route_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = folded_train(spark, sf_dir, ["distance"])
    return T.oof_target_encode(train, ["distance"], "label", "fold", SMOOTHING).select("id", "fold", r("te", 9).alias("te"))


def _full_cte(keys: list[str]) -> str:
    return f"select {', '.join(keys)}, (sum(label) + (select avg(label) from tr) * {SMOOTHING}) / (count(*) + {SMOOTHING}) as te from tr group by {', '.join(keys)}"


@query(
    "key_set_encoding_full_map", "G2",
    sql=survey_sql("select s.id, " + ", ".join(f"{rd(f'coalesce({n}.te, (select avg(label) from tr))', 9)} as {n}" for n in KEY_SETS) + " from survey s " + " ".join(f"left join {n} on {_on(n, ks, 's', False)}" for n, ks in KEY_SETS.items()) + " where s.id % 10 >= 7",
                   tr=TRAIN, **{n: _full_cte(ks) for n, ks in KEY_SETS.items()}),
)
def key_set_encoding_full_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir)
    train, out = rows.where(is_train()), rows.where(~is_train())
    for name, keys in KEY_SETS.items():
        table = T.fit_target_table(train, keys, "label", SMOOTHING, name)
        out = T.apply_target_table(out, table, train, keys, "label", name)
    return out.select("id", *[r(n, 9).alias(n) for n in KEY_SETS])


def _key_sets_sql(prior: str) -> str:
    ctes = {}
    for n, ks in KEY_SETS.items():
        ctes.update(_oof_ctes(n, ks, prior))
    select = "select tr.id, " + ", ".join(f"{rd(f'{n}.te', 9)} as {n}" for n in KEY_SETS) + " from tr " + " ".join(f"join {n} on {_on(n, ks)}" for n, ks in KEY_SETS.items())
    return survey_sql(select, tr=FOLDED, **PRIOR, **ctes)


def _key_sets(spark: SparkSession, sf_dir: str, prior: str) -> DataFrame:
    train = fitted(folded_train(spark, sf_dir, ["distance", "age", "class", "travel_type", "customer_type"]), "folds")
    out = T.encode_key_sets(train, KEY_SETS, "label", "fold", SMOOTHING, prior=prior)
    return out.select("id", *[r(n, 9).alias(n) for n in KEY_SETS])


@query("key_set_encoding_oof", "G3", sql=_key_sets_sql("fold"))
def key_set_encoding_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key_sets(spark, sf_dir, "fold")


@query(
    "key_set_encoding_all_rows", "G2", "G3",
    sql=survey_sql(
        "select s.id, " + ", ".join(f"{rd(f'coalesce({n}.te, f_{n}.te, (select avg(label) from tr))', 9)} as {n}" for n in ("te_distance", "te_distance_age"))
        + " from survey s left join tr t on t.id = s.id "
        + " ".join(f"left join {n} on {_on(n, KEY_SETS[n], 't')} left join f_{n} on s.id % 10 >= 7 and {_on('f_' + n, KEY_SETS[n], 's', False)}" for n in ("te_distance", "te_distance_age")),
        tr=FOLDED, **PRIOR, **{k: v for n in ("te_distance", "te_distance_age") for k, v in {**_oof_ctes(n, KEY_SETS[n]), f"f_{n}": _full_cte(KEY_SETS[n])}.items()},
    ),
)
def key_set_encoding_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir).select("id", "label", "distance", "age")
    frame = fitted(rows.join(folded_train(spark, sf_dir, []).select("id", "fold"), "id", "left"), "folds")
    sets = {n: KEY_SETS[n] for n in ("te_distance", "te_distance_age")}
    out = T.encode_key_sets(frame, sets, "label", "fold", SMOOTHING, is_train=is_train())
    return out.select("id", *[r(n, 9).alias(n) for n in sets])


@query("key_set_encoding_oof_global_prior", "G3", sql=_key_sets_sql("global"))
def key_set_encoding_oof_global_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key_sets(spark, sf_dir, "global")


def _nested_sql(keys: list[str]) -> str:
    """Written the long way: every context filters its fit rows, every value looks at the rows it may use."""
    kk = ", ".join(keys)
    same = " and ".join(f"f.{k} = r.{k}" for k in keys)
    ctes = {
        "base": f"select id, label, {kk}, id % 10 < 7 as train, case when id % 10 < 7 then fold end as outer_f, {hash_fold_sql(seed=7)} as inner_f from (select s.*, t.fold from survey s left join tr0 t on t.id = s.id) x",
        "ctx": f"select unnest(range(0, {FOLDS})) as context",
        "fit": f"select context, inner_f, {kk}, cast(sum(label) as double) as s, count(*) as n from base, ctx where train and outer_f <> context group by all",
        "keyall": f"select context, {kk}, sum(s) as s, sum(n) as n from fit group by all",
        "keyin": f"select context, inner_f, {kk}, sum(s) as s, sum(n) as n from fit group by all",
        "allin": "select context, inner_f, sum(s) as s, sum(n) as n from fit group by all",
        "alls": "select context, sum(s) as s, sum(n) as n from fit group by all",
        "rws": "select b.*, cast(c.context as integer) as ctx, case when not train then 'score' when outer_f = c.context then 'held_out' else 'fit' end as role from base b, ctx c",
    }
    body = f"""select r.id, r.ctx as context, r.role,
        {rd(f'''(coalesce(f.s, 0) - case when r.role = 'fit' then coalesce(i.s, 0) else 0 end
          + (a.s - case when r.role = 'fit' then ai.s else 0 end) / (a.n - case when r.role = 'fit' then ai.n else 0 end) * {SMOOTHING})
         / (coalesce(f.n, 0) - case when r.role = 'fit' then coalesce(i.n, 0) else 0 end + {SMOOTHING})''', 9)} as te
        from rws r left join keyall f on f.context = r.ctx and {same}
        left join keyin i on i.context = r.ctx and i.inner_f = r.inner_f and {same.replace('f.', 'i.')}
        join alls a on a.context = r.ctx left join allin ai on ai.context = r.ctx and ai.inner_f = r.inner_f"""
    return survey_sql(body, tr0=FOLDED, **ctes)


def _nested_rows(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    rows = survey(spark, sf_dir)
    outer = folded_train(spark, sf_dir, []).select("id", F.col("fold").alias("outer"))
    placed = rows.select("id", "label", *columns).join(outer, "id", "left")
    return fitted(Fo.hash_folds(placed, "id", FOLDS, 7, "inner"))


@query("nested_target_encoding", "G4", sql=_nested_sql(["o_custkey"]))
def nested_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nested_rows(spark, sf_dir, ["o_custkey"])
    out = T.nested_target_encode(rows, ["o_custkey"], "label", "outer", "inner", is_train(), FOLDS, SMOOTHING, "te")
    return out.select("id", "context", "role", r("te", 9).alias("te"))


@query("pair_target_encoding_nested", "G5", sql=_nested_sql(["r1", "r6"]))
def pair_target_encoding_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nested_rows(spark, sf_dir, ["r1", "r6"])
    out = T.nested_target_encode(rows, ["r1", "r6"], "label", "outer", "inner", is_train(), FOLDS, SMOOTHING, "te")
    return out.select("id", "context", "role", r("te", 9).alias("te"))


PAIR_SETS = {f"te2_{a}_{b}": [a, b] for a, b in PAIRS}


@query(
    "pair_target_encodings_oof", "G5",
    sql=survey_sql("select tr.id, " + ", ".join(f"{rd(f'{n}.te', 9)} as {n}" for n in PAIR_SETS) + " from tr " + " ".join(f"join {n} on {_on(n, ks)}" for n, ks in PAIR_SETS.items()),
                   tr=FOLDED, **PRIOR, **{k: v for n, ks in PAIR_SETS.items() for k, v in _oof_ctes(n, ks).items()}),
)
def pair_target_encodings_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = fitted(folded_train(spark, sf_dir, sorted({c for p in PAIRS for c in p})), "folds")
    sets = {n: [F.col(k) for k in ks] for n, ks in PAIR_SETS.items()}
    rates = T.oof_rates(train, ["id"], sets, "label", "fold", SMOOTHING)
    return rates.groupBy("id").pivot("key_set", list(sets)).agg(F.first(r("rate", 9)))


@query("category_target_encoding", "G6", sql=survey_sql(f"select s.id, {rd('c.te', 9)} as class_te, {rd('t.te', 9)} as travel_te from survey s join c on c.class = s.class join t on t.travel_type = s.travel_type", tr=TRAIN, c=_full_cte(["class"]), t=_full_cte(["travel_type"])))
def category_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir)
    train = rows.where(is_train())
    for name, keys in {"class_te": ["class"], "travel_te": ["travel_type"]}.items():
        rows = T.apply_target_table(rows, T.fit_target_table(train, keys, "label", SMOOTHING, name), train, keys, "label", name)
    return rows.select("id", r("class_te", 9).alias("class_te"), r("travel_te", 9).alias("travel_te"))


@query(
    "auto_smoothed_encoding", "G7",
    sql=survey_sql(f"select o_custkey, {rd('case when n * v + vk = 0 then m else n * v / (n * v + vk) * m + (1 - n * v / (n * v + vk)) * g end')} as te from (select o_custkey, count(*) as n, avg(label) as m, var_pop(label) as vk from tr group by o_custkey) k, (select avg(label) as g, var_pop(label) as v from tr) a", tr=TRAIN),
)
def auto_smoothed_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = survey(spark, sf_dir).where(is_train())
    return T.auto_smoothed_table(train, ["o_custkey"], "label").withColumn("te", r("te"))


@query(
    "auto_smoothed_encoding_oof", "G7",
    sql=survey_sql(
        f"""select tr.id, {rd('''case when k.n is null then a.g when k.n * a.v + k.vk = 0 then k.m else k.n * a.v / (k.n * a.v + k.vk) * k.m + (1 - k.n * a.v / (k.n * a.v + k.vk)) * a.g end''')} as te
        from tr left join k on k.f = tr.fold and k.o_custkey = tr.o_custkey join a on a.f = tr.fold""",
        tr=FOLDED,
        k=f"select f, o_custkey, count(*) as n, avg(label) as m, var_pop(label) as vk from tr, (select unnest(range(0, {FOLDS})) as f) z where fold <> f group by f, o_custkey",
        a=f"select f, avg(label) as g, var_pop(label) as v from tr, (select unnest(range(0, {FOLDS})) as f) z where fold <> f group by f",
    ),
)
def auto_smoothed_encoding_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.operators.lookup import join_fitted

    train = folded_train(spark, sf_dir, ["o_custkey"])
    table = T.auto_smoothed_oof_table(train, ["o_custkey"], "label", "fold")
    return join_fitted(train, table, ["o_custkey", "fold"]).select("id", r("te").alias("te"))


SEGMENT = ["travel_type", "class", "customer_type"]
COARSE_SQL = {"distance_div10": "distance // 10", "age_div5": "age // 5", "delay_div5": "least(dep_delay, 60) // 5"}
LOGIT_KEYS: dict[str, list[str]] = {
    **{c: [c] for c in RAW_FEATURES},
    **{c: [c] for c in COARSE_SQL},
    "segment": SEGMENT,
    **{f"segment_{c}": [*SEGMENT, c] for c in ["r1", "r6", "age_div5", "distance_div10"]},
    **{f"{a}_{b}": [a, b] for a, b in [("r1", "r6"), ("r6", "r7"), ("r6", "class")]},
}


def _kv(columns: list[str]) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(cast({COARSE_SQL.get(c, c)} as varchar), 'nan')" for c in columns) + ")"


@query(
    "rate_logits_at_many_keys", "G8",
    sql=survey_sql(
        "select id, " + ", ".join(f"max(case when ks = '{n}' then lg end) as {n}" for n in LOGIT_KEYS) + f" from (select l.id, l.ks, {rd('ln(greatest(least(te, 1 - 1e-4), 1e-4) / (1 - greatest(least(te, 1 - 1e-4), 1e-4)))')} as lg from long l join te on te.ks = l.ks and te.kv = l.kv and te.fold = l.fold) x group by id",
        tr=FOLDED, **PRIOR,
        long=" union all ".join(f"select id, label, fold, '{n}' as ks, {_kv(ks)} as kv from tr" for n, ks in LOGIT_KEYS.items()),
        cells="select ks, kv, fold, cast(sum(label) as double) as s, count(*) as n from long group by all",
        te=f"select c.ks, c.kv, c.fold, (sum(c.s) over w - c.s + p * {SMOOTHING}) / (sum(c.n) over w - c.n + {SMOOTHING}) as te from cells c join pri on pri.fold = c.fold window w as (partition by c.ks, c.kv)",
    ),
)
def rate_logits_at_many_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = fitted(folded_train(spark, sf_dir, RAW_FEATURES), "folds")
    coarse = modular_keys()
    sets = {n: [coarse[c] if c in COARSE_SQL else F.col(c) for c in ks] for n, ks in LOGIT_KEYS.items()}
    wide = T.rate_logit_columns(train, "id", sets, "label", "fold", SMOOTHING)
    return wide.select("id", *[r(n).alias(n) for n in LOGIT_KEYS])


@query("stratified_split", "H1", sql=survey_sql("select id, label, split from s", s=SPLIT_SQL))
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_splits(spark, sf_dir, [])


@query("threshold_split", "H1", sql=survey_sql(f"select id, case when {hash_number_sql()} < cast(0.7 * 4294967296 as bigint) then 'train' when {hash_number_sql()} < cast(floor(0.85 * 4294967296) as bigint) then 'validation' else 'test' end as split from survey"))
def threshold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fo.threshold_split(survey(spark, sf_dir), "id", SHARES, SEED).select("id", "split")


@query("stratified_kfold", "H2", sql=survey_sql("select id, label, fold from tr", tr=FOLDED))
def stratified_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded_train(spark, sf_dir, [])


@query("hash_kfold", "H3", sql=survey_sql(f"select id, {hash_fold_sql()} as fold from survey"))
def hash_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fo.hash_folds(survey(spark, sf_dir), "id", FOLDS, SEED).select("id", "fold")


@query("half_split", "H4", sql=survey_sql(f"select id, {hash_fold_sql(seed='half', k=2)} as half from survey"))
def half_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fo.hash_folds(survey(spark, sf_dir), "id", 2, "half", "half").select("id", "half")


@query("fixed_size_sample", "H5", sql=plain_sql(f"select l_orderkey, l_linenumber, l_quantity from lineitem order by {hash_hex_sql('l_orderkey * 8 + l_linenumber', 3)} limit 500", ))
def fixed_size_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])
    keyed = lines.withColumn("key", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return Fo.sample_rows(keyed, "key", 500, 3).select("l_orderkey", "l_linenumber", "l_quantity")


@query("per_group_sample", "H6", sql=survey_sql(f"select id, label from (select id, label, row_number() over (partition by label order by {hash_hex_sql(seed=5)}, id) as rn from survey) x where rn <= 2000"))
def per_group_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fo.sample_per_group(survey(spark, sf_dir).select("id", "label"), "id", ["label"], 2000, 5)


@query("carved_validation_slice", "H7", sql=survey_sql(f"select id, fold, {hash_number_sql(seed=9)} < cast(floor(0.1 * 4294967296) as bigint) as is_validation from tr where fold <> 0", tr=FOLDED))
def carved_validation_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = folded_train(spark, sf_dir, []).where("fold <> 0")
    return Fo.carve_validation(fit, "id", 0.1, 9).select("id", "fold", "is_validation")


