"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Both sides are multinomials over ``BUCKETS`` hashed byte ``GRAM``-grams. The raw side counts every document. The target side
counts every document labelled good. A document's score is the mean of log p_target - log p_raw over its n-grams, so length drops out; it passes if the score is at least the threshold, which is
``SLACK`` below the ``QUANTILE`` of the scores of the trusted documents: a fixed number for given tables, the same for all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import packed, summed
from tabloom.llm.words import SPACE, WINDOW_BASES, Slice, Words, covered, mix, slices, space_words, spans_hash, window_hash, window_starts

GRAM = 4
BUCKETS = 1 << 16
QUANTILE = 0.002
SLACK = 0.15
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def gram_buckets(part: Slice, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at every byte position, and which positions hold a whole n-gram of one document."""
    n = len(part.data)
    code = np.zeros(n, np.uint32)
    for k in range(gram):
        code[: n - k] = code[: n - k] << np.uint32(8) | part.data[k:]
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))
    whole = np.ones(n, bool)
    for k in range(1, gram):
        whole[np.maximum(part.offsets[1:] - k, 0)[part.offsets[1:] > 0]] = False
    return bucket.astype(np.int32), whole


def _tally(docs: DataFrame) -> np.ndarray:
    """Counts of all n-grams of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch.column("text")):
                bucket, whole = gram_buckets(part)
                total += np.bincount(bucket[whole], minlength=BUCKETS)
        return total

    return summed(docs.select("text"), count, BUCKETS)


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw per bucket, each smoothed by one count; nought where the target is empty."""
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def scores(part: Slice, ratio: np.ndarray) -> np.ndarray:
    """Mean log-likelihood ratio per document; 0 for texts shorter than an n-gram."""
    bucket, whole = gram_buckets(part)
    value = np.concatenate([[0.0], np.cumsum(np.where(whole, ratio[bucket], 0.0))])
    size = np.concatenate([[0], np.cumsum(whole)])
    lo, hi = part.offsets[:-1], part.offsets[1:]
    return (value[hi] - value[lo]) / np.maximum(size[hi] - size[lo], 1)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def lower_quantile(values: DataFrame, share: float, n: int) -> float:
    """The interpolated quantile of ``n`` > 0 numbers, from the smallest of them up to its place; for a small ``share``."""
    place = share * (n - 1)
    low, high = math.floor(place), math.ceil(place)
    least = values.sort(*values.columns).limit(high + 1).toArrow().column(0).to_numpy()  # a `share` of the numbers
    return float(least[low] + (place - low) * (least[high] - least[low]))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The log ratio per bucket and the threshold; without trusted documents every document passes."""
    good = trusted_ids(labels).hint("merge")  # of any number: never whole on the driver, and the same plan at every size
    trusted = packed(docs.select("doc_id", "text").join(good, "doc_id", "left_semi").select("text"), "trusted")
    ratio = log_ratio(_tally(trusted), _tally(docs))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                yield pa.record_batch({"score": pa.array(np.round(scores(part, shared.value), 9))})

    n = trusted.count()
    return ratio, lower_quantile(trusted.mapInArrow(run, "score double"), QUANTILE, n) - SLACK if n else -np.inf


def _doc_sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated_words(words: Words, width: int = 3) -> np.ndarray:
    """Words per document that lie in a ``width``-word window found twice or more in it."""
    starts = window_starts(words, width)
    doc = np.searchsorted(words.first, starts, "right") - 1
    key = window_hash(words, starts, width) ^ mix(doc.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    return _doc_sums(covered(len(words.hash), starts[again], width), words.first)


def duplicate_lines(part: Slice) -> np.ndarray:
    """Lines with a word that equal an earlier line of the document."""
    n = len(part.data)
    cuts = np.unique(np.concatenate([part.offsets, np.flatnonzero(part.data == 10) + 1]))
    lo, hi = cuts[:-1], cuts[1:]
    if not len(lo):
        return np.zeros(len(part), np.int64)
    end = hi - (part.data[hi - 1] == 10)
    filled = np.concatenate([[0], np.cumsum(~SPACE[part.data])])
    keep = filled[end] > filled[lo]
    lo, end = lo[keep], end[keep]
    doc = np.searchsorted(part.offsets, lo, "right") - 1
    key = spans_hash(part.data.astype(np.uint64) + np.uint64(1), lo, end, WINDOW_BASES[1]) ^ mix(doc.astype(np.uint64) + np.uint64(n))
    order = np.argsort(key, kind="stable")
    later = order[1:][key[order][1:] == key[order][:-1]]
    return np.bincount(doc[later], minlength=len(part))


def measures(part: Slice) -> dict[str, np.ndarray]:
    """The base counts of every document."""
    words = space_words(part)
    inside = np.zeros(len(part.data) + 1, np.int64)
    np.add.at(inside, words.start, 1)
    np.add.at(inside, words.end, -1)
    begins = (part.data & 0xC0) != 0x80
    return {
        "n_words": words.counts,
        "word_chars": _doc_sums((np.cumsum(inside[:-1]) > 0) & begins, part.offsets),
        "n_symbols": _doc_sums(SYMBOLS[part.data], part.offsets),
        "n_dup_lines": duplicate_lines(part),
        "n_repeat_words": repeated_words(words),
    }


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed and kept added.

    Null text has no words and fails the base rule, as every text under ``MIN_WORDS`` words. Columns of ``docs`` with one of
    these names are replaced. Repeated rows are judged alike; an empty or missing trusted set leaves the base rule alone.
    """
    ratio, threshold = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    carried = docs.drop(*counts, "score", "base_failed", "kept")
    added = ", ".join(f"{c} bigint" for c in counts) + ", score double"
    schema = carried.limit(0).selectExpr("*", *(f"cast(null as {t}) as {c}" for c, t in (a.split(" ") for a in added.split(", ")))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                found = measures(part)
                arrays = [c.slice(part.lo, len(part)) for c in batch.columns]
                arrays += [pa.array(found[c], pa.int64()) for c in counts] + [pa.array(scores(part, shared.value), pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *counts, "score"])

    judged = carried.mapInArrow(run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with their own columns only, in one pass and without a shuffle."""
    ratio, threshold = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                found = measures(part)
                keep = (found["n_words"] >= MIN_WORDS) & (100 * found["n_repeat_words"] <= MAX_REPEAT_PERCENT * found["n_words"])
                keep &= scores(part, shared.value) >= threshold
                yield batch.slice(part.lo, len(part)).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
