"""Language identification in two steps: the family first, then the language within it.

Both steps are one-versus-one linear support vector machines over hashed byte trigrams (square roots of counts, unit length).
The machines are fitted on a bounded sample: at most ``PER_LANGUAGE`` labelled documents of a language (and as many times
``FAMILY_FACTOR`` of a family), each pair of classes in a task of its own. Prediction reads whole texts and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import fitted
from tabloom.llm.words import FOLDED, Slice, slices

PER_LANGUAGE = 1000
FAMILY_FACTOR = 2
FEATURES = 2048
STEPS = 120
PENALTY = 1e-4
FOLDS = 5
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")

# Language codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tt tk",
    "iranian": "fa ku ps tg",
    "indic": "hi bn ur pa gu mr ne si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "austronesian": "id ms tl jv su",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang, lang)


def is_held_out(doc_id: Column) -> Column:
    """Documents that training never sees; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def features(part: Slice) -> Iterator[tuple[int, np.ndarray]]:
    """Feature rows of the documents in groups: index of the first one, matrix."""
    n = len(part.data)
    data = FOLDED[part.data]
    code = np.zeros(n, np.uint32)
    for k in range(3):
        code[: n - k] = code[: n - k] << np.uint32(8) | data[k:]
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - (FEATURES.bit_length() - 1))).astype(np.int64)
    group = 128
    for lo in range(0, len(part), group):
        hi = min(lo + group, len(part))
        sizes = np.diff(part.offsets[lo : hi + 1])
        a, b = part.offsets[lo], part.offsets[hi]
        row = np.repeat(np.arange(hi - lo), sizes)
        end = np.repeat(part.offsets[lo + 1 : hi + 1], sizes)
        whole = np.arange(a, b) + 3 <= end
        counts = np.bincount(row[whole] * FEATURES + bucket[a:b][whole], minlength=(hi - lo) * FEATURES)
        x = np.sqrt(counts.reshape(hi - lo, FEATURES)).astype(np.float32)
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        yield lo, x / np.maximum(norm, 1e-12)


def fit_machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear machine: squared hinge loss with an L2 penalty, accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    balance = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    step = 1.0 / (4.0 + PENALTY)  # rows have length at most sqrt 2
    w = ahead = np.zeros(x.shape[1])
    for t in range(STEPS):
        slack = np.maximum(0.0, 1.0 - y * (x @ ahead))
        grad = PENALTY * ahead - 2.0 * (x.T @ (balance * y * slack))
        new = ahead - step * grad
        ahead = new + t / (t + 3) * (new - w)
        w = new
    return w


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most ``per_language`` labelled documents of each language (lang, family, place, features)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in known.groupBy("lang").agg(F.count("*")).collect()}  # one row per language
    if not counts:
        return docs.sparkSession.createDataFrame([], "lang string, family string, place bigint, x binary")
    # a thin cut by hash first, so that ordering a language never meets more than about twice the sample
    space = 1 << 30
    cuts = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(space, int(space * 1.5 * per_language / n) + 1))])
    key = F.xxhash64("text", F.col("doc_id").cast("string"))
    thin = fitted(known.select("lang", "text", key.alias("key")).where(F.pmod("key", F.lit(space)) < F.element_at(cuts, F.col("lang"))), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                for lo, x in features(part):
                    langs = batch.column("lang").slice(part.lo + lo, len(x))
                    yield pa.record_batch(
                        {
                            "lang": langs,
                            "family": pa.array([family_of(v) for v in langs.to_pylist()], pa.string()),
                            "key": batch.column("key").slice(part.lo + lo, len(x)),
                            "x": pa.array([row.tobytes() for row in x], pa.binary()),
                        }
                    )

    made = thin.mapInArrow(run, "lang string, family string, key bigint, x binary")
    return fitted(
        made.selectExpr("*", "row_number() over (partition by lang order by key, x) as place").where(F.col("place") <= per_language).drop("key"), "sample"
    )


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """``families``: names; ``languages``: names by family; ``machines``: weights by (class above 0, class below 0)."""
    sample = training_sample(docs, per_language)
    pairs = [(r[0], r[1]) for r in sample.select("family", "lang").distinct().orderBy("family", "lang").collect()]
    families = sorted({f for f, _ in pairs})
    languages = {f: sorted(lang for g, lang in pairs if g == f) for f in families}
    size = {f: max(1, FAMILY_FACTOR * per_language // len(v)) for f, v in languages.items()}
    tasks = [("family", a, b) for i, a in enumerate(families) for b in families[i + 1 :]]
    tasks += [("lang", a, b) for f in families for i, a in enumerate(languages[f]) for b in languages[f][i + 1 :]]
    if not tasks:
        return {"families": families, "languages": languages, "machines": {}}
    wanted = docs.sparkSession.createDataFrame(
        [(level, a, b, side, (a, b)[side == -1], size.get((a, b)[side == -1], per_language)) for level, a, b in tasks for side in (1, -1)],
        "level string, a string, b string, side int, class string, most int",
    )
    classes = [F.struct(F.lit(level).alias("level"), F.col(level).alias("class")) for level in ("family", "lang")]
    rows = (
        sample.select("x", "place", F.explode(F.array(*classes)).alias("c"))
        .select("x", "place", "c.level", "c.class")
        .join(wanted, ["level", "class"])
        .where(F.col("place") <= F.col("most"))
    )

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "class", "place", "x"])
        x = np.stack([np.frombuffer(v, np.float32) for v in group["x"]])
        w = fit_machine(x, group["side"].to_numpy(np.float64))
        return pd.DataFrame({"level": group["level"].iloc[:1], "a": group["a"].iloc[:1], "b": group["b"].iloc[:1], "w": [w.tobytes()]})

    fits = rows.groupBy("level", "a", "b").applyInPandas(train, "level string, a string, b string, w binary").collect()
    return {"families": families, "languages": languages, "machines": {(r.level, r.a, r.b): np.frombuffer(r.w, np.float64) for r in fits}}


def _vote(x: np.ndarray, level: str, names: list[str], machines: dict) -> tuple[np.ndarray, np.ndarray]:
    """Winning class per row and its mean pairwise confidence."""
    if len(names) == 1:
        return np.zeros(len(x), np.int64), np.ones(len(x))
    total = np.zeros((len(x), len(names)))
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            w = machines[level, a, names[j]]
            p = 1.0 / (1.0 + np.exp(-np.clip(3.0 * (x @ w[:-1] + w[-1]), -50, 50)))
            total[:, i] += p
            total[:, j] += 1 - p
    best = total.argmax(axis=1)
    return best, total[np.arange(len(x)), best] / (len(names) - 1)


def classify(x: np.ndarray, model: dict) -> tuple[list[str], np.ndarray]:
    family, sure = _vote(x, "family", model["families"], model["machines"])
    names = np.empty(len(x), object)
    for i, f in enumerate(model["families"]):
        rows = np.flatnonzero(family == i)
        if len(rows):
            lang, p = _vote(x[rows], "lang", model["languages"][f], model["machines"])
            names[rows] = np.array(model["languages"][f], object)[lang]
            sure[rows] *= p
    return names.tolist(), sure


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (0 to 1).

    ``und`` with score 0 for null text, text without a letter, and for every text if nothing could be learned.
    Repeated rows are predicted alike; the columns lang and source are never read for a prediction.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, per_language))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                for lo, x in features(part):
                    n = len(x)
                    names, score = classify(x, model.value) if model.value["families"] else ([UNKNOWN] * n, np.zeros(n))
                    for i in range(n):
                        if part.null[lo + i] or not LETTER.search(part.text(lo + i).decode()):
                            names[i], score[i] = UNKNOWN, 0.0
                    yield pa.record_batch(
                        {
                            "doc_id": batch.column("doc_id").slice(part.lo + lo, n),
                            "held_out": batch.column("held_out").slice(part.lo + lo, n),
                            "lang_pred": pa.array(names, pa.string()),
                            "score": pa.array(score, pa.float64()),
                        }
                    )

    rows = docs.select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
