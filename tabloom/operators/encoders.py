"""Target encodings as pipeline stages, fitted inside a fold and stored with the model.

``FoldTargetEncoder`` learns from the rows it is fitted on, and nothing else. Rows marked as fit rows (a true ``FIT_ROWS`` column) are
cross-fitted: their value comes from the other inner folds, prior included, so that it does not move with their own label. All other
rows take the map of all fit rows. A pipeline therefore trains on leak-safe values and scores with the full map, also after it has been
saved and loaded. Inner folds are a hash of the row key and do not depend on labels.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.hashing import hash_number
from tabloom.functions.scalars import text_key
from tabloom.operators.lookup import fitted_parts

FIT_ROWS = "_fit_rows"


def encoded_name(keys: list[str], auto: bool = False) -> str:
    """``tef_<column>``, ``te2_pair_<a>_<b>`` for several columns, ``tea_...`` with automatic smoothing."""
    return ("tea_" if auto else "tef_" if len(keys) == 1 else "te2_pair_") + "_".join(keys)


class _EncoderParams(Params):
    keySets = Param(Params._dummy(), "keySets", "columns of every encoding", TypeConverters.identity)
    keyCol = Param(Params._dummy(), "keyCol", "row key that the inner folds are drawn from", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "0/1 label", TypeConverters.toString)
    innerFolds = Param(Params._dummy(), "innerFolds", "folds of the cross-fitting", TypeConverters.toInt)
    smoothing = Param(Params._dummy(), "smoothing", "rows' worth of prior", TypeConverters.toFloat)
    auto = Param(Params._dummy(), "auto", "smoothing by within and between variance instead", TypeConverters.toBoolean)
    seed = Param(Params._dummy(), "seed", "seed of the inner folds", TypeConverters.toInt)

    def outputs(self) -> dict[str, list[str]]:
        return {encoded_name(keys, self.getOrDefault("auto")): list(keys) for keys in self.getOrDefault("keySets")}

    def _cell(self) -> Column:
        return (hash_number(self.getOrDefault("keyCol"), self.getOrDefault("seed")) % self.getOrDefault("innerFolds")).cast("int")


class FoldTargetEncoder(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of :class:`FoldTargetEncoderModel`; one aggregation by (key set, key, inner fold) fits all its encodings."""

    @keyword_only
    def __init__(self, *, keySets=(), keyCol="id", labelCol="label", innerFolds=5, smoothing=20.0, auto=False, seed=0):
        super().__init__()
        self._set(keySets=[list(k) for k in keySets], keyCol=keyCol, labelCol=labelCol, innerFolds=innerFolds, smoothing=smoothing, auto=auto, seed=seed)

    def _fit(self, dataset: DataFrame) -> FoldTargetEncoderModel:
        label = F.col(self.getOrDefault("labelCol")).cast("double")
        folds = range(self.getOrDefault("innerFolds"))
        pairs = F.array(*[F.struct(F.lit(name).alias("key_set"), text_key(keys).alias("key_value")) for name, keys in self.outputs().items()])
        rows = dataset.where(label.isNotNull()).select(label.alias("y"), self._cell().alias("cell"), pairs.alias("pairs"))
        overall = {r.cell: (r.s, r.n) for r in rows.groupBy("cell").agg(F.sum("y").alias("s"), F.count("*").alias("n")).collect()}  # one row per inner fold
        total = tuple(map(sum, zip(*overall.values()))) if overall else (0.0, 0)
        rates = {"all": total[0] / total[1] if total[1] else 0.5}
        for cell in folds:
            s, n = overall.get(cell, (0.0, 0))
            rates[str(cell)] = (total[0] - s) / (total[1] - n) if total[1] > n else rates["all"]

        def value(s: Column, n: Column, prior: Column) -> Column:
            if not self.getOrDefault("auto"):
                m = F.lit(self.getOrDefault("smoothing"))
                return (s + prior * m) / (n + m)
            # weight of a key's own mean: n v / (n v + v_key), both variances of 0/1 labels
            mean = s / n
            mine = n * prior * (1 - prior)
            weight = F.coalesce(F.try_divide(mine, mine + mean * (1 - mean)), F.lit(1.0))
            return weight * mean + (1 - weight) * prior

        # one row per key, sums of the inner folds side by side: one shuffle fits all encodings
        own = [F.sum(F.when(F.col("cell") == c, F.col("y"))).alias(f"s{c}") for c in folds] + [F.count_if(F.col("cell") == c).alias(f"n{c}") for c in folds]
        sums = rows.select("y", "cell", F.inline("pairs")).groupBy("key_set", "key_value").agg(F.sum("y").alias("s"), F.count("*").alias("n"), *own)
        others = [(F.col("s") - F.coalesce(f"s{c}", F.lit(0.0)), F.col("n") - F.col(f"n{c}"), c) for c in folds]
        fields = [F.when((n > 0) & (n < F.col("n")), value(s, n, F.lit(float(rates[str(c)])))).alias(f"v{c}") for s, n, c in others]
        table = sums.select("key_set", "key_value", *fields, value(F.col("s"), F.col("n"), F.lit(float(rates["all"]))).alias("value"))
        model = FoldTargetEncoderModel(fitted_parts(table, "key_set", list(self.outputs()), "encodings"), rates)
        return self._copyValues(model)


class FoldTargetEncoderModel(Model, _EncoderParams, MLWritable, MLReadable):
    """Per key set a table of its keys with their encodings (``value``, and ``v<cell>`` for fit rows of an inner fold), with the priors for keys
    never seen."""

    def __init__(self, tables: dict[str, DataFrame] | None = None, rates: dict[str, float] | None = None):
        super().__init__()
        self.tables, self.rates = tables or {}, rates or {}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fit_rows = F.coalesce(F.col(FIT_ROWS), F.lit(False)) if FIT_ROWS in dataset.columns else F.lit(False)
        folds = range(self.getOrDefault("innerFolds"))
        result = dataset.withColumn("_cell", F.when(fit_rows, self._cell()))

        def by_cell(choices: list[Column], otherwise: Column) -> Column:
            chain = F.when(F.col("_cell").isNull(), otherwise)
            for cell, choice in zip(folds, choices):
                chain = chain.when(F.col("_cell") == cell, choice)
            return chain

        prior = by_cell([F.lit(float(self.rates[str(c)])) for c in folds], F.lit(float(self.rates["all"])))
        for name, keys in self.outputs().items():
            own = self.tables[name].select(*[F.col(c).alias(f"_e_{c}") for c in self.tables[name].columns])
            # joined by the expression itself: an encoding of the same columns that follows finds the rows where it needs them
            joined = result.join(own, text_key(keys) == F.col("_e_key_value"), "left")
            found = by_cell([F.col(f"_e_v{c}") for c in folds], F.col("_e_value"))
            result = joined.withColumn(name, F.coalesce(found, prior)).drop(*own.columns)
        return result.drop("_cell")

    def write(self) -> MLWriter:
        return _EncoderWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EncoderReader(cls)


class _EncoderWriter(MLWriter):
    def __init__(self, model: FoldTargetEncoderModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"rates": json.dumps(self.model.rates)})
        for i, table in enumerate(self.model.tables.values()):
            table.write.parquet(f"{path}/table/{i}")


class _EncoderReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FoldTargetEncoderModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(None, json.loads(metadata["rates"]))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.tables = {name: self.sparkSession.read.parquet(f"{path}/table/{i}") for i, name in enumerate(model.outputs())}
        return model
