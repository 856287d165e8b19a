"""The end-to-end slice: gates, folds, leak-safe encoding, exact AUC by fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.operators.folds import stratified_folds
from tabloom.operators.lookup import fitted
from tabloom.operators.ranks import auc
from tabloom.operators.target_encode import oof_target_encode
from tabloom.plans.common import FOLDED, FOLDS, SEED, SMOOTHING, auc_sql, r, rd
from tabloom.plans.registry import query, survey_sql
from tabloom.sources.survey import is_train, survey

OOF_SQL = {
    "tr": FOLDED,
    "cells": "select distance, r6, fold, cast(sum(label) as double) as s, count(*) as n from tr group by all",
    "per_fold": "select fold, cast(sum(label) as double) as s, count(*) as n from tr group by fold",
    "pri": "select a.fold, (sum(b.s) - a.s) / (sum(b.n) - a.n) as p from per_fold a, per_fold b group by a.fold, a.s, a.n",
    "te": f"""select c.distance, c.r6, c.fold,
        (sum(c.s) over w - c.s + p * {SMOOTHING}) / (sum(c.n) over w - c.n + {SMOOTHING}) as te
        from cells c join pri on pri.fold = c.fold window w as (partition by c.distance, c.r6)""",
    "scored": "select tr.*, te.te from tr join te on tr.distance = te.distance and tr.r6 = te.r6 and tr.fold = te.fold",
}


@query(
    "oof_encoding_auc_by_fold", "G1", "H2", "K2",
    sql=survey_sql(
        f"select fold, n_pos, n_neg, {rd('auc')} as auc from a", **OOF_SQL,
        a=auc_sql("scored", "round(te, 9)", by=["fold"]),
    ),
    note="flagship: folds, out-of-fold encoding of two keys, exact AUC per fold",
)
def oof_encoding_auc_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = survey(spark, sf_dir).where(is_train()).select("id", "distance", "r6", "label")
    folded = fitted(stratified_folds(train, "id", "label", FOLDS, SEED), "folds")
    encoded = oof_target_encode(folded, ["distance", "r6"], "label", "fold", SMOOTHING)
    scored = encoded.withColumn("te", r("te", 9))
    return auc(scored, "te", "label", by=["fold"]).select("fold", "n_pos", "n_neg", r("auc").alias("auc"))
