"""spark.ml members: registry, cross-validation with resumable folds, importances, searches."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.hashing import hash_number
from tabloom.functions.scalars import logit, sigmoid
from tabloom.operators.boosting import Bins, Boosted, HistogramBooster, Settings, encode_batch, fit_bins, fit_boosted, score_boosted
from tabloom.operators.encoders import FIT_ROWS, FoldTargetEncoder, encoded_name
from tabloom.operators.factorization import FactorizationMachine
from tabloom.operators.folds import hash_order_position
from tabloom.operators.forest import Targets, distributions, grow
from tabloom.operators.logistic import fit_folds
from tabloom.operators.lookup import fitted
from tabloom.operators.ranks import auc, column_quantiles
from tabloom.sources.sinks import fingerprint


@dataclass(frozen=True)
class MemberSpec:
    """What a member is: estimator kind, features, parameters, seed.

    ``encoded`` lists column sets whose target encodings are fitted inside every fold and join the numeric features:
    ``tef_<column>``, ``te2_pair_<a>_<b>``; ``auto_encoded`` the same with automatic smoothing, ``tea_...``.
    """

    name: str
    kind: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    seed: int | None = None
    label: str = "label"
    weight: str | None = None
    encoded: tuple[tuple[str, ...], ...] = ()
    auto_encoded: tuple[tuple[str, ...], ...] = ()
    key: str = "id"

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @property
    def inputs(self) -> list[str]:
        """Every column that decides the result."""
        sets = [c for keys in (*self.encoded, *self.auto_encoded) for c in keys]
        return list(dict.fromkeys([*self.features, *sets]))

    @property
    def encodings(self) -> list[str]:
        return [*(encoded_name(list(k)) for k in self.encoded), *(encoded_name(list(k), True) for k in self.auto_encoded)]

    def fingerprint(self, **run) -> str:
        return hashlib.sha256(json.dumps({**asdict(self), **run}, sort_keys=True).encode()).hexdigest()[:16]


ESTIMATORS: dict[str, Callable[..., Estimator]] = {
    "logistic": LogisticRegression,
    "shared_logistic": LogisticRegression,  # cross-validated in shared passes, otherwise the same
    "tree": DecisionTreeClassifier,
    "forest": RandomForestClassifier,
    "boosted": GBTClassifier,
    "perceptron": MultilayerPerceptronClassifier,
    "factorization": FactorizationMachine,
    "histogram": HistogramBooster,
}
UNSEEDED = {"logistic", "shared_logistic"}  # deterministic estimators without a seed parameter
TREES = {"tree", "forest", "boosted"}
SCALED = {"logistic", "shared_logistic", "perceptron", "factorization"}
STORED = {"logistic", "shared_logistic", *TREES}  # these read their rows several times before they keep them; prepared rows are stored, not prepared each time


def build_model(kind: str, params: dict, seed: int | None, label: str = "label", weight: str | None = None) -> Estimator:
    """Estimator by name; an unknown name lists the options, a missing seed is an error."""
    if kind not in ESTIMATORS:
        raise ValueError(f"unknown model {kind!r}; choose one of {sorted(ESTIMATORS)}")
    if seed is None:
        raise ValueError("a seed is required")
    settings = {"labelCol": label, **params}
    if kind != "histogram":
        settings["featuresCol"] = "features"
    if kind not in UNSEEDED:
        settings["seed"] = seed
    if weight is not None and kind not in ("perceptron", "factorization"):
        settings["weightCol"] = weight
    return ESTIMATORS[kind](**settings)


def _encoders(spec: MemberSpec) -> list[FoldTargetEncoder]:
    kinds = ((spec.encoded, False), (spec.auto_encoded, True))
    return [FoldTargetEncoder(keySets=sets, keyCol=spec.key, labelCol=spec.label, auto=auto, seed=spec.seed) for sets, auto in kinds if sets]


def _filling(numeric: list[str], cats: list[str]) -> list:
    """Median imputation and codes: what is found column by column."""
    stages: list = []
    if numeric:
        stages.append(Imputer(strategy="median", inputCols=numeric, outputCols=[f"_i_{c}" for c in numeric]))
    if cats:
        stages.append(StringIndexer(inputCols=cats, outputCols=[f"_c_{c}" for c in cats], stringOrderType="alphabetAsc", handleInvalid="keep"))
    return stages


def _shaping(spec: MemberSpec) -> list:
    """The feature vector of filled columns; for linear kinds with indicators and scaling."""
    stages: list = []
    inputs = [f"_i_{c}" for c in (*spec.numeric, *spec.encodings)]
    if spec.categorical:
        cats = list(spec.categorical)
        coded = [f"_c_{c}" for c in cats]
        if spec.kind in SCALED:
            stages.append(OneHotEncoder(inputCols=coded, outputCols=[f"_h_{c}" for c in cats], dropLast=False))
            coded = [f"_h_{c}" for c in cats]
        inputs += coded
    if spec.kind in SCALED:
        stages.append(VectorAssembler(inputCols=inputs, outputCol="_raw"))
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    else:
        stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return stages


def preparation(spec: MemberSpec) -> list:
    """Codes, median imputation and, for linear kinds, indicators and scaling."""
    if spec.kind == "histogram":
        return []
    return [*_filling([*spec.numeric, *spec.encodings], list(spec.categorical)), *_shaping(spec)]


def numeric_input(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers as double, as the feature transformers want them."""
    return frame.withColumns({c: F.col(c).cast("double") for c in columns})


def prepared(train: DataFrame, spec: MemberSpec) -> PipelineModel:
    """The fitted preparation of a member; it depends on neither the seed nor the parameters."""
    return Pipeline(stages=preparation(spec)).fit(numeric_input(train, list(spec.numeric)))


def shared_preparations(frame: DataFrame, specs: list[MemberSpec], fold: str) -> tuple[DataFrame, Callable[[MemberSpec, int], PipelineModel | None]]:
    """The frame with numbers as double, and the preparation of a member on the fit rows of a fold, fitted once for all members that share it.

    Medians and codes are found column by column, so one fit per fold serves every member; vectors and scales serve the members with the
    same columns. Members that prepare themselves (histogram, encodings) get none, nor does a column that is a number here and a category there.
    """
    shared = [s for s in specs if s.kind != "histogram" and not s.encodings]
    numeric = list(dict.fromkeys(c for s in shared for c in s.numeric))
    cats = list(dict.fromkeys(c for s in shared for c in s.categorical))
    if len(shared) < 2 or {*numeric} & {*(c for s in specs for c in (*s.categorical, s.label))}:
        return frame, lambda spec, f: None
    frame = numeric_input(frame, numeric)
    filled: dict[int, list] = {}
    ready: dict[tuple, PipelineModel] = {}

    def find(spec: MemberSpec, f: int) -> PipelineModel | None:
        if spec.kind == "histogram" or spec.encodings:
            return None
        train, mark = frame.where(F.col(fold) != f), (f, spec.numeric, spec.categorical, spec.kind in SCALED)
        if f not in filled:
            filled[f] = Pipeline(stages=_filling(numeric, cats)).fit(train).stages
        if mark not in ready:
            ready[mark] = Pipeline(stages=[*filled[f], *_shaping(spec)]).fit(train)
        return ready[mark]

    return frame, find


def fit_member(train: DataFrame, spec: MemberSpec, ready: PipelineModel | None = None) -> PipelineModel:
    """The member fitted on ``train``; ``ready`` is its preparation if that has been fitted on these rows before."""
    params = dict(spec.params)
    encoders: list = []
    if spec.encodings:
        train = train.withColumn(FIT_ROWS, F.lit(True))  # values of the other inner folds for these rows
        for stage in _encoders(spec):
            encoders.append(stage.fit(train))
            train = encoders[-1].transform(train)
        extra = [spec.weight] if spec.weight else []
        train = fitted(train.select(*dict.fromkeys([spec.key, spec.label, *spec.inputs, *spec.encodings, *extra])), "encoded")
    if spec.kind == "histogram":
        params |= {"numericCols": [*spec.numeric, *spec.encodings], "categoricalCols": list(spec.categorical), "keyCol": spec.key}
    ready = ready or prepared(train, spec)
    shaped = ready.transform(numeric_input(train, list(spec.numeric)))
    if spec.kind in TREES and spec.categorical and "maxBins" not in params:
        # a split on a category needs a bin for each of its levels
        levels = train.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in spec.categorical]).first()
        most = max(levels[c] for c in spec.categorical)
        params["maxBins"] = max(32, int(most * 1.1) + 2)
    if spec.kind in STORED:
        extra = [spec.weight] if spec.weight else []
        shaped = fitted(shaped.select(*dict.fromkeys([spec.label, *extra, "features"])), "vectors")
    fitted_last = fit_shaped(shaped, replace(spec, params=params))
    return _without_summary(PipelineModel(stages=[*encoders, *ready.stages, fitted_last]))


def fit_shaped(shaped: DataFrame, spec: MemberSpec) -> Model:
    """The last stage of a member, fitted on rows that its preparation has been applied to."""
    params = dict(spec.params)
    if spec.kind == "perceptron" and "hidden" in params:
        hidden = params.pop("hidden")
        params["layers"] = [shaped.select("features").first()[0].size, *hidden, 2]
    return build_model(spec.kind, params, spec.seed, spec.label, spec.weight).fit(shaped)


PARALLEL = 2
FEW_ROWS = 2_000_000


def at_once(frame: DataFrame) -> int:
    """How many fits on these stored rows run together: more where the jobs of a fit are short and what it caches is small."""
    return PARALLEL if frame.count() > FEW_ROWS else 2 * PARALLEL


def together(work: Callable, jobs: list, spark: SparkSession, parallel: int = PARALLEL) -> list:
    """``work`` of every job, ``parallel`` at a time: the short jobs of one fit leave cores idle that another's can use."""
    with ThreadPool(max(1, parallel)) as pool:
        return pool.map(inheritable_thread_target(spark)(work), jobs, chunksize=1)


def _without_summary(model: PipelineModel) -> PipelineModel:
    """The model without its training summary.

    A summary holds the session, and the model travels to the tasks with it; once the session has
    used an observation (as ``StepMetrics`` does) that can no longer be serialised.
    """
    last = model.stages[-1]
    if getattr(last, "hasSummary", False):
        last._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.apply(None))
    return model


def positive_probability() -> Column:
    return vector_to_array("probability")[1]


def score(model: PipelineModel, frame: DataFrame, spec: MemberSpec, keep: list[str]) -> DataFrame:
    return model.transform(numeric_input(frame, list(spec.numeric))).select(*keep, positive_probability().alias("p"))


def cross_validate(
    frame: DataFrame, spec: MemberSpec, fold: str, folds: int, key: str = "id", to_score: DataFrame | None = None,
    ready: Callable[[MemberSpec, int], PipelineModel | None] | None = None,
) -> DataFrame:
    """(key, member, split, fold, label, p): every row scored once by a model that never saw it.

    Rows to score get one value per fold, to be averaged. Fold models differ in
    their seed by the fold number. ``ready`` names a fold's preparation if members share it.
    """
    if spec.kind == "histogram" and not spec.encodings and "validationIndicatorCol" not in spec.params:
        return _boosted_folds(frame, spec, fold, folds, key, to_score)
    if spec.kind == "shared_logistic" and not spec.encodings and spec.weight is None and not {*spec.params} - {"regParam", "maxIter", "tol"}:
        return _logistic_folds(frame, spec, fold, folds, key, to_score)

    def scored(f: int) -> DataFrame:
        own = replace(spec, seed=spec.seed + f)
        model = fit_member(frame.where(F.col(fold) != f), own, ready(spec, f) if ready else None)
        held = score(model, frame.where(F.col(fold) == f), own, [key, spec.label]).withColumn("split", F.lit("train"))
        if to_score is not None:
            new = score(model, to_score, own, [key]).withColumn(spec.label, F.lit(None).cast("int")).withColumn("split", F.lit("score"))
            held = held.unionByName(new)
        return held.select(key, F.lit(spec.name).alias("member"), "split", F.lit(f).alias("fold"), spec.label, "p")

    parts = together(scored, list(range(folds)), frame.sparkSession, at_once(frame))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def boosted_settings(params: dict) -> tuple[Settings, int]:
    """Settings and bins of the parameters of a histogram member."""
    stage = HistogramBooster(**params)
    return stage.settings(), stage.getOrDefault("maxBins")


def _boosted_folds(frame: DataFrame, spec: MemberSpec, fold: str, folds: int, key: str, to_score: DataFrame | None) -> DataFrame:
    """The models of all folds grow in the same passes. Bins are those of all rows: they know no label."""
    settings, n_bins = boosted_settings(spec.params)
    bins = fit_bins(frame, list(spec.numeric), list(spec.categorical), n_bins)
    models = fit_boosted(frame, bins, spec.label, settings, spec.seed, key, fold, list(range(folds)), spec.weight)
    scored = score_boosted(models, frame.where(F.col(fold).between(0, folds - 1)), [key, fold, spec.label])
    own = F.element_at("margins", F.col(fold) + 1)
    result = scored.select(key, F.lit(spec.name).alias("member"), F.lit("train").alias("split"), F.col(fold).cast("int").alias("fold"), spec.label, sigmoid(own).alias("p"))
    if to_score is not None:
        new = score_boosted(models, to_score, [key]).select(key, F.posexplode("margins").alias("fold", "margin"))
        label = F.lit(None).cast(frame.schema[spec.label].dataType).alias(spec.label)
        result = result.unionByName(new.select(key, F.lit(spec.name).alias("member"), F.lit("score").alias("split"), "fold", label, sigmoid("margin").alias("p")))
    return result


def _logistic_folds(frame: DataFrame, spec: MemberSpec, fold: str, folds: int, key: str, to_score: DataFrame | None) -> DataFrame:
    """The models of all folds are fitted in the same passes; rows are scored by plain expressions."""
    stage = LogisticRegression(**spec.params)
    settings = [stage.getOrDefault(p) for p in ("regParam", "maxIter", "tol")]
    models = fit_folds(frame, list(spec.numeric), list(spec.categorical), spec.label, fold, list(range(folds)), *settings)
    rows = frame.where(F.col(fold).between(0, folds - 1)).withColumn(fold, F.col(fold).cast("int"))
    result = rows.select(key, F.lit(spec.name).alias("member"), F.lit("train").alias("split"), F.col(fold).alias("fold"), spec.label, models.probability(F.col(fold)).alias("p"))
    if to_score is not None:
        new = to_score.select(key, *[c for c in spec.inputs if c != key], F.explode(F.lit(list(range(folds)))).alias("_fold"))
        label = F.lit(None).cast(frame.schema[spec.label].dataType).alias(spec.label)
        result = result.unionByName(new.select(key, F.lit(spec.name).alias("member"), F.lit("score").alias("split"), F.col("_fold").alias("fold"), label, models.probability(F.col("_fold")).alias("p")))
    return result


def averaged_scores(predictions: DataFrame, key: str = "id") -> DataFrame:
    """Mean over folds for the rows to score."""
    return predictions.where("split = 'score'").groupBy(key, "member").agg(F.avg("p").alias("p"))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The fold's predictions if a finished write exists."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def resumable_cross_validate(frame: DataFrame, spec: MemberSpec, fold: str, folds: int, root: str, key: str = "id") -> tuple[DataFrame, list[int]]:
    """Cross-validation that keeps finished folds below ``root``; returns predictions and the folds fitted now.

    A stored fold counts only if model, fold count and content (keys, folds, labels and features of
    all rows) are the same; anything else lies under another fingerprint or is refitted.
    """
    sizes = {row[fold]: row["n"] for row in frame.groupBy(fold).agg(F.count("*").alias("n")).collect()}  # one row per fold
    content = fingerprint(frame, [key, fold, spec.label, *spec.inputs]).first()
    mark = spec.fingerprint(folds=folds, rows=content["rows"], content=content["digest"])
    fitted_now, parts = [], []
    for f in range(folds):
        path = f"{root}/member={spec.name}/fingerprint={mark}/fold={f}"
        stored = _stored(frame.sparkSession, path)
        if stored is None or stored.count() != sizes.get(f, 0):
            own = replace(spec, seed=spec.seed + f)
            model = fit_member(frame.where(F.col(fold) != f), own)
            score(model, frame.where(F.col(fold) == f), own, [key, spec.label]).write.mode("overwrite").parquet(path)
            fitted_now.append(f)
            stored = frame.sparkSession.read.parquet(path)
        parts.append(stored.select(key, F.lit(spec.name).alias("member"), F.lit(f).alias("fold"), spec.label, "p"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result, fitted_now


def member_auc(predictions: DataFrame, by: list[str] = ("member",), label: str = "label") -> DataFrame:
    return auc(predictions.where(F.col(label).isNotNull()), "p", label, by=list(by))


def compare_members(frame: DataFrame, specs: list[MemberSpec], fold: str, folds: int, key: str = "id") -> DataFrame:
    """(member, kind, auc, accuracy, seconds): all specs on the same rows and folds, best first."""
    spark = frame.sparkSession
    rows, parts = [], []
    frame, ready = shared_preparations(frame, specs, fold)
    for spec in specs:
        started = time.monotonic()
        parts.append(fitted(cross_validate(frame, spec, fold, folds, key, ready=ready), "cv"))
        rows.append((spec.name, spec.kind, time.monotonic() - started))
    predictions = parts[0]
    for part in parts[1:]:
        predictions = predictions.unionByName(part)
    hits = predictions.groupBy("member").agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("label")).cast("double")).alias("accuracy"))
    info = spark.createDataFrame(rows, "member string, kind string, seconds double")
    return member_auc(predictions).join(hits, "member").join(info, "member").select("member", "kind", "auc", "accuracy", "seconds").orderBy(F.desc("auc"), "member")


def linear_terms(model: PipelineModel, frame: DataFrame, spec: MemberSpec) -> DataFrame:
    """(feature, coefficient) of a logistic member, largest magnitude first."""
    return _named(model, frame, spec, model.stages[-1].coefficients.toArray(), "coefficient")


def impurity_importance(model: PipelineModel, frame: DataFrame, spec: MemberSpec) -> DataFrame:
    return _named(model, frame, spec, model.stages[-1].featureImportances.toArray(), "importance")


def _named(model: PipelineModel, frame: DataFrame, spec: MemberSpec, values, out: str) -> DataFrame:
    """Vector slots by name, from the metadata the assembler left."""
    shaped = PipelineModel(stages=model.stages[:-1]).transform(numeric_input(frame, list(spec.numeric)))
    column = "_raw" if spec.kind in SCALED else "features"
    attrs = shaped.schema[column].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    rows = [(names.get(i, f"slot_{i}"), float(v)) for i, v in enumerate(values)]
    return frame.sparkSession.createDataFrame(rows, f"feature string, {out} double").orderBy(F.desc(F.abs(F.col(out))))


def permutation_importance(model: PipelineModel, frame: DataFrame, spec: MemberSpec, columns: list[str], repeats: int, seed: int, key: str = "id") -> DataFrame:
    """(feature, mean_drop, std_drop): AUC lost when one column is shuffled.

    The shuffle pairs the rows' positions in two hash orders, so a row gets the
    value of another row and each value is used once. All columns and repeats are
    scored together.
    """
    base = auc(score(model, frame, spec, [spec.label]), "p", spec.label).first()["auc"]
    parts = None
    for n in range(repeats):
        places = hash_order_position(frame.select(key), key, f"{seed}-{n}-a", out="here").select(key, "here")
        donors = hash_order_position(frame.select(key, *columns), key, f"{seed}-{n}-b", out="here").select(
            "here", *[F.col(c).alias(f"_d_{c}") for c in columns]
        )
        paired = fitted(frame.join(places, key).join(donors, "here").drop("here"), "permuted")
        for c in columns:
            swapped = paired.withColumn(c, F.col(f"_d_{c}"))
            part = score(model, swapped, spec, [spec.label]).select(F.lit(c).alias("feature"), F.lit(n).alias("repeat"), spec.label, "p")
            parts = part if parts is None else parts.unionByName(part)
    drops = auc(parts, "p", spec.label, by=["feature", "repeat"]).withColumn("drop", F.lit(base) - F.col("auc"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("mean_drop"), F.stddev_pop("drop").alias("std_drop"))


def l1_selection(train: DataFrame, held: DataFrame, spec: MemberSpec, penalties: list[float]) -> DataFrame:
    """(penalty, kept, auc, features): per L1 penalty the non-zero features and a refit on them; penalty 0 keeps all."""
    rows = []
    for penalty in [0.0, *penalties]:
        kept = list(spec.numeric)
        if penalty > 0:
            sweep = replace(spec, kind="logistic", params={"regParam": penalty, "elasticNetParam": 1.0})
            terms = linear_terms(fit_member(train, sweep), train, sweep).where("abs(coefficient) > 1e-9").select("feature").collect()
            names = {t.feature for t in terms}  # one row per feature
            kept = [c for c in spec.numeric if f"_i_{c}" in names]
        if not kept:
            rows.append((penalty, 0, 0.5, ""))
            continue
        refit = replace(spec, numeric=tuple(kept))
        found = auc(score(fit_member(train, refit), held, refit, [spec.label]), "p", spec.label).first()["auc"]
        rows.append((penalty, len(kept), found, ",".join(kept)))
    return train.sparkSession.createDataFrame(rows, "penalty double, kept int, auc double, features string").orderBy(F.desc("auc"), "penalty")


def feature_ablation(frame: DataFrame, base: MemberSpec, groups: dict[str, tuple[str, ...]], fold: str, folds: int) -> DataFrame:
    """(variant, n_features, auc, delta): base, base plus each group, all groups."""
    variants = {"base": base.numeric, **{f"+{g}": (*base.numeric, *cols) for g, cols in groups.items()}}
    variants["all"] = (*base.numeric, *[c for cols in groups.values() for c in cols])
    specs = [replace(base, name=name, numeric=tuple(cols)) for name, cols in variants.items()]
    table = compare_members(frame, specs, fold, folds)
    start = table.where("member = 'base'").select("auc").scalar()
    sizes = frame.sparkSession.createDataFrame([(s.name, len(s.features)) for s in specs], "member string, n_features int")
    return table.join(sizes, "member").select(F.col("member").alias("variant"), "n_features", "auc", (F.col("auc") - start).alias("delta")).orderBy(F.desc("auc"))


def random_parameters(ranges: dict[str, list], n: int, seed: int) -> list[dict]:
    """``n`` reproducible draws from lists of options."""
    draws = []
    for i in range(n):
        digest = hashlib.sha256(f"{seed}:{i}".encode()).digest()
        draws.append({name: options[digest[j] % len(options)] for j, (name, options) in enumerate(sorted(ranges.items()))})
    return draws


def searched(
    train: DataFrame, held: DataFrame, spec: MemberSpec, ranges: dict[str, list], n: int, confirm: int, small: dict, full: dict, seed: int,
    ledger: str | None = None, parallel: int = 2,
) -> tuple[DataFrame, int]:
    """(stage, trial, params, auc) and the number of fits made: ``n`` draws at the small budget, the best ``confirm`` of them again at the full one.

    The budget is the number of trials, so the result is the same on any machine. Equal draws are fitted once, ``parallel`` fits share the
    executors. With a ``ledger`` folder every trial is written there as it ends, and a search that was interrupted, or is given more
    trials, goes on from it; trials count for the same member, parameters and rows only.
    """
    spark = train.sparkSession
    rows = ""
    if ledger is not None:
        marks = [fingerprint(f, [spec.key, spec.label, *spec.inputs]).first() for f in (train, held)]
        rows = "-".join(f"{m['rows']}:{m['digest']}" for m in marks)
    known: dict[str, float] = {}
    made = 0

    def evaluate(params: dict) -> tuple[float, bool]:
        own = replace(spec, params=params)
        path = None if ledger is None else f"{ledger}/trial={own.fingerprint(rows=rows)}"
        stored = None if path is None else _stored(spark, path)
        if stored is not None and (row := stored.first()) is not None:
            return row["auc"], False
        value = auc(score(fit_member(train, own), held, own, [spec.label]), "p", spec.label).first()["auc"]
        if path is not None:
            spark.createDataFrame([(json.dumps(params, sort_keys=True), value)], "params string, auc double").coalesce(1).write.mode("overwrite").parquet(path)
        return value, True

    def run(budgets: list[dict]) -> None:
        nonlocal made
        todo = {json.dumps(p, sort_keys=True): p for p in budgets}
        todo = {mark: p for mark, p in todo.items() if mark not in known}
        for mark, (value, fresh) in zip(todo, together(evaluate, list(todo.values()), spark, parallel)):
            known[mark] = value
            made += fresh

    def found(params: dict) -> float:
        return known[json.dumps(params, sort_keys=True)]

    draws = random_parameters(ranges, n, seed)
    run([{**d, **small} for d in draws])
    trials = [("search", i, d, found({**d, **small})) for i, d in enumerate(draws)]
    best = sorted(trials, key=lambda t: (-t[3], t[1]))[:confirm]
    run([{**d, **full} for _, _, d, _ in best])
    trials += [("confirm", i, d, found({**d, **full})) for _, i, d, _ in best]
    table = [(stage, i, json.dumps(draw, sort_keys=True), value) for stage, i, draw, value in trials]
    return spark.createDataFrame(table, "stage string, trial int, params string, auc double").orderBy("stage", F.desc("auc")), made


def random_search(
    train: DataFrame, held: DataFrame, spec: MemberSpec, ranges: dict[str, list], n: int, confirm: int, small: dict, full: dict, seed: int
) -> DataFrame:
    """The table of :func:`searched`, without a ledger."""
    return searched(train, held, spec, ranges, n, confirm, small, full, seed)[0]


def segment_models(frame: DataFrame, spec: MemberSpec, by: str, levels: list[str], fold: str, folds: int) -> DataFrame:
    """One cross-validated model per segment with the segment column removed; pooled scores."""
    own = replace(spec, categorical=tuple(c for c in spec.categorical if c != by))
    parts = None
    for level in levels:
        part = cross_validate(frame.where(F.col(by) == level), own, fold, folds).withColumn("segment", F.lit(level))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def margin_boosting(
    frame: DataFrame, linear: MemberSpec, trees: MemberSpec, fold: str, folds: int, key: str = "id"
) -> tuple[DataFrame, list[Boosted]]:
    """(key, fold, label, p_linear, p) and the boosted models: a linear margin first, then trees that start at it.

    Every round takes gradients and curvatures of the log loss at the current margin. A fold's linear model and trees see only its fit
    rows; all folds grow in the same passes. With no rounds the result is the linear stage.
    """
    settings, n_bins = boosted_settings(trees.params)
    rows = frame
    for f in range(folds):
        model = fit_member(frame.where(F.col(fold) != f), replace(linear, seed=linear.seed + f))
        scored = model.transform(numeric_input(rows, list(linear.numeric)))
        first = positive_probability()
        rows = scored.select(*rows.columns, logit(first).alias(f"_margin_{f}"))  # a projection: no join per fold
    rows = fitted(rows.withColumn("_margins", F.array(*[f"_margin_{f}" for f in range(folds)])).drop(*[f"_margin_{f}" for f in range(folds)]), "margins")
    bins = fit_bins(frame, list(trees.numeric), list(trees.categorical), n_bins)
    models = fit_boosted(rows, bins, trees.label, settings, trees.seed, key, fold, list(range(folds)), trees.weight, "_margins")
    scored = score_boosted(models, rows, [key, fold, trees.label, "_margins"], "_margins")
    own = F.col(fold) + 1
    result = scored.select(
        key, F.col(fold).cast("int").alias("fold"), trees.label, sigmoid(F.element_at("_margins", own)).alias("p_linear"), sigmoid(F.element_at("margins", own)).alias("p")
    )
    return result, models


def ordinal_scores(train: DataFrame, held: DataFrame, spec: MemberSpec, target: Column, classes: int, keep: list[str]) -> DataFrame:
    """Expected level from ``classes - 1`` binary models of "level > t"."""
    expected = None
    for t in range(classes - 1):
        own = replace(spec, label="_above")
        model = fit_member(train.withColumn("_above", (target > t).cast("int")), own)
        part = score(model, held, own, keep)
        expected = part if expected is None else expected.unionByName(part)
    return expected.groupBy(*keep).agg(F.sum("p").alias("p"))


LONG = 100  # a numeric target with more values than this is predicted by bins
BINS = 50


def long_columns(frame: DataFrame, columns: list[str]) -> list[str]:
    """The columns with more than ``LONG`` distinct values, by a sketch that is the same for the same rows."""
    if not columns:
        return []
    found = frame.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in columns]).first()
    return [c for c in columns if found[c] > LONG]


def _bins(fit: DataFrame, columns: list[str]) -> dict[str, tuple[list[float], dict[str, float]]]:
    """Per column the cut points (distinct inner quantiles) and the mean of the fit values in each bin."""
    if not columns:
        return {}
    quantiles = column_quantiles(fit, columns, [i / BINS for i in range(1, BINS)]).collect()  # one row per column
    cuts = {row["feature"]: sorted({q for q in row["q"] if q is not None}) for row in quantiles}
    long = fit.select(*[F.struct(_bin(c, cuts.get(c, [])).alias("bin"), F.col(c).cast("double").alias("x")).alias(c) for c in columns]).unpivot([], columns, "feature", "v")
    means = {c: {} for c in columns}
    for row in long.where("v.x is not null").groupBy("feature", "v.bin").agg(F.avg("v.x").alias("mean")).collect():  # at most BINS rows per column
        means[row["feature"]][row["bin"]] = row["mean"]
    return {c: (cuts.get(c, []), means[c]) for c in columns}


def _bin(column: str, cuts: list[float]) -> Column:
    """Bin number as text: how many cut points are at or below the value."""
    value = F.col(column).cast("double")
    return F.when(value.isNotNull(), F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda cut: cut <= value)).cast("string"))


def _classes(fit: DataFrame, targets: list[str], numeric: list[str], long: list[str]) -> Targets:
    """Long numeric targets by quantile bins and their means, other numeric ones by value, categories by level."""
    binned = _bins(fit, long)
    short = [t for t in targets if t not in long]
    found = fit_bins(fit.select(*[F.col(t).cast("double" if t in numeric else "string").alias(t) for t in short]), [], short).categorical if short else {}
    levels = {t: v for t, v in found.items() if t not in numeric}
    values = {}
    for t in targets:
        if t in binned:
            values[t] = [binned[t][1].get(str(b)) or 0.0 for b in range(len(binned[t][0]) + 1)]
        else:
            values[t] = sorted(map(float, found[t])) if t in numeric else [float(i) for i in range(len(found[t]))]
    return Targets(Bins({t: binned[t][0] for t in binned}, levels), values)


def expectation_columns(targets: list[str]) -> list[str]:
    """The fixed order: own-value probabilities, expected values, the log sum; whether the likeliest value is the own one comes last."""
    return [*(f"aux_p_{t}" for t in targets), *(f"aux_ev_{t}" for t in targets), "aux_sum_logp", *(f"aux_hit_{t}" for t in targets)]


def _expectations(
    fit: DataFrame, apply_to: DataFrame, targets: list[str], numeric: list[str], categorical: list[str], seed: int, keep: list[str], params: dict | None, eps: float,
    long: list[str] | None, fold: str | None, held: list[int | None],
) -> DataFrame:
    settings = {"numTrees": 10, "maxDepth": 5, "maxBins": 32} | (params or {})
    if long is None:
        long = long_columns(fit, [t for t in targets if t in numeric])
    classes = _classes(fit, targets, numeric, [t for t in targets if t in long])
    typed = {c: F.col(c).cast("double") for c in numeric} | {c: F.col(c).cast("string") for c in categorical}
    bins = fit_bins(fit.withColumns(typed), numeric, categorical, settings["maxBins"])
    draw = [c for c in keep if c in fit.columns] or [*numeric, *categorical]
    forests = grow(fit.withColumns(typed), bins, classes, draw, seed, settings["numTrees"], settings["maxDepth"], fold=fold, held=held)
    names = list(dict.fromkeys([*numeric, *categorical, *targets]))
    places = {t: classes.names.index(t) for t in targets}

    def run(*columns: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays(list(columns[:-1]), names=names)
        own_fold = columns[-1].to_numpy(zero_copy_only=False)
        codes, own = encode_batch(batch, bins), classes.classes(batch)
        out = np.full((batch.num_rows, len(targets), 3), np.nan)
        for k, t in enumerate(targets):
            values = np.array(classes.values[t])
            if not len(values):
                continue
            for h, left_out in enumerate(held):
                at = np.flatnonzero(own_fold == left_out) if left_out is not None else np.arange(batch.num_rows)
                p = distributions(forests[t, h], codes[:, at], bins.width, len(values))
                mine = own[places[t], at]
                seen = np.where(mine >= 0, p[np.arange(len(at)), np.maximum(mine, 0)], 0.0)
                out[at, k, 0] = np.where(mine == -2, np.nan, seen)
                out[at, k, 1] = p @ values
                out[at, k, 2] = np.where(mine == -2, np.nan, p.argmax(axis=1) == mine)
        flat = pa.array(out.ravel(), from_pandas=True)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 3 * len(targets)), pa.int32()), flat)

    inputs = [F.col(c).cast("double" if c in numeric else "string") for c in names]
    scored = apply_to.select(*keep, F.arrow_udf(run, "array<double>")(*inputs, F.col(fold).cast("int") if fold else F.lit(-1)).alias("_x"))

    def part(t: str, k: int) -> Column:
        return F.col("_x")[3 * targets.index(t) + k]

    log_sum = sum((F.coalesce(F.ln(F.greatest(part(t, 0), F.when(part(t, 0).isNotNull(), F.lit(eps)))), F.lit(0.0)) for t in targets), F.lit(0.0))
    found = {"aux_sum_logp": log_sum}
    for t in targets:
        found |= {f"aux_p_{t}": part(t, 0), f"aux_ev_{t}": part(t, 1), f"aux_hit_{t}": part(t, 2).cast("int")}
    return scored.select(*keep, *[found[c].alias(c) for c in expectation_columns(targets)])


def expectation_models(
    fit: DataFrame, apply_to: DataFrame, targets: list[str], numeric: list[str], categorical: list[str], seed: int, keep: list[str], params: dict | None = None, eps: float = 1e-6,
    long: list[str] | None = None,
) -> DataFrame:
    """Predict each target column from all other columns: ``aux_p_<t>`` (probability of the
    row's own value), ``aux_ev_<t>`` (expected value), ``aux_hit_<t>`` and ``aux_sum_logp``.

    A numeric target with more than ``LONG`` values (or named in ``long``) is predicted by bins cut at its quantiles: own value and
    hit refer to the bin, the expected value to the bin means. A missing value has no own probability and no hit, adds nothing
    to the sum, and is not learned from. The forests of all targets grow in the same passes.
    """
    return _expectations(fit, apply_to, targets, numeric, categorical, seed, keep, params, eps, long, None, [None])


def oof_expectations(frame: DataFrame, targets: list[str], numeric: list[str], categorical: list[str], fold: str, folds: int, seed: int, keep: list[str], params: dict | None = None) -> DataFrame:
    """The same, each row scored by forests of the other folds. Classes and bins are those of all rows; all folds share the passes."""
    rows = frame.where(F.col(fold).between(0, folds - 1))
    return _expectations(rows, rows, targets, numeric, categorical, seed, keep, params, 1e-6, None, fold, list(range(folds)))


def early_stopped(train: DataFrame, spec: MemberSpec, share: float = 0.1, key: str = "id") -> PipelineModel:
    """Boosted trees that stop on a carved slice of the fit rows."""
    flagged = train.withColumn("_valid", hash_number(key, f"{spec.seed}-valid") < int(share * 2**32))
    return fit_member(flagged, replace(spec, params={**spec.params, "validationIndicatorCol": "_valid"}))
