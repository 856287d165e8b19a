"""Removal of word passages that occur more than once, with a count-min prefilter.

1. Every partition sketches its documents; the partition sketches are merged by shuffle into one count-min sketch.
   What is counted is each window's anchor: the leftmost smallest of the ``GRAM``-word fingerprints inside it, at its
   own position. Equal windows have equal anchors at different positions, so an anchor's count is never below the
   number of places where one of its windows starts: the estimate errs upwards only and no repeated window is lost.
2. Windows with an estimate of at least two are grouped exactly, by fingerprint (two independent families, 96 bits).
   Documents without such a window are finished in that pass and their text goes no further.
3. Marked words are cut out, per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import power_of_two, scratch_path, shuffle_partitions
from tabloom.llm.words import Slice, Words, covered, slices, space_words, window_hash, window_starts

WIDTH = 35
GRAM = 12
DEPTH = 2
LEAST_WIDTH, MOST_WIDTH = 1 << 20, 1 << 29
CELLS = 1 << 20  # counters in one shuffled piece of a sketch
NONE = np.uint32(0xFFFFFFFF)
GROUP_WINDOWS = 1 << 19  # candidate windows that one exact group of buckets should hold


def window_anchors(words: Words, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the word position of each one's anchor, and all gram fingerprints by position."""
    starts = window_starts(words, width)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    n = len(words.hash)
    grams = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    at = np.arange(n - gram + 1)
    grams[at] = window_hash(words, at, gram)  # grams across documents are never looked at
    # leftmost minimum over `span` positions by doubling
    span = width - gram + 1
    best = np.arange(n)
    have = 1
    while have < span:
        step = min(have, span - have)
        other = best[np.minimum(np.arange(n) + step, n - 1)]
        best = np.where(grams[other] < grams[best], other, best)
        have += step
    return starts, best[starts], grams


def _cells(anchors: np.ndarray, width: int, row: int) -> np.ndarray:
    """Counter of each anchor in sketch row ``row``."""
    odd = np.uint64((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)[row])
    return ((anchors * odd) >> np.uint64(64 - (width.bit_length() - 1))).astype(np.int64)


def sketch(docs: DataFrame, counters: int, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """The merged count-min sketch, as one bit per counter and row: estimated at least twice.

    Partition sketches travel as sparse pieces of ``CELLS`` counters and are added up by the tasks that own a piece; only
    the merged bits (``DEPTH * counters / 8`` bytes, at most 128 MB) reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for part in slices(batch.column("text")):
                words = space_words(part)
                _, at, grams = window_anchors(words, width, gram)
                found.append(grams[np.unique(at)])
        anchors = np.concatenate(found) if found else np.zeros(0, np.uint64)
        for row in range(DEPTH):
            cell, times = np.unique(_cells(anchors, counters, row), return_counts=True)
            piece = cell // CELLS
            cut = np.flatnonzero(np.diff(piece, prepend=-1))
            for a, b in zip(cut, [*cut[1:], len(cell)]):
                inside = (cell[a:b] % CELLS).astype(np.uint32)
                yield pa.record_batch(
                    {
                        "piece": pa.array([row * (counters // CELLS) + int(piece[a])], pa.int64()),
                        "once": pa.array([inside[times[a:b] == 1].tobytes()], pa.binary()),
                        "more": pa.array([inside[times[a:b] > 1].tobytes()], pa.binary()),
                    }
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, once, more in zip(*(batch.column(c) for c in ("piece", "once", "more"))):
                total = sums.setdefault(piece.as_py(), np.zeros(CELLS, np.uint8))
                for cells, times in ((once, 1), (more, 2)):
                    at = np.frombuffer(cells.as_py(), np.uint32)
                    total[at] = np.minimum(total[at] + times, 2)
        for piece, total in sums.items():
            yield pa.record_batch({"piece": pa.array([piece], pa.int64()), "bits": pa.array([np.packbits(total >= 2).tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(count, "piece bigint, once binary, more binary")
    merged = parts.repartition(shuffle_partitions(docs.sparkSession), "piece").mapInArrow(merge, "piece bigint, bits binary")
    bits = np.zeros((DEPTH * counters // CELLS, CELLS // 8), np.uint8)
    for piece, packed in merged.toLocalIterator():
        bits[piece] = np.frombuffer(packed, np.uint8)
    return bits.reshape(DEPTH, -1)


def estimated_repeated(bits: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    out = np.ones(len(anchors), bool)
    counters = bits.shape[1] * 8
    for row in range(DEPTH):
        cell = _cells(anchors, counters, row)
        out &= (bits[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return out


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _candidates(part: Slice, words: Words, bits: np.ndarray, width: int, gram: int) -> np.ndarray:
    starts, at, grams = window_anchors(words, width, gram)
    if not len(starts):
        return starts
    places, back = np.unique(at, return_inverse=True)
    return starts[estimated_repeated(bits, grams[places])[back]]


def _bundle(hashes: list[np.ndarray], rid: np.ndarray, pos: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Candidate windows of one slice, a row per bucket.

    A window found more than once in the slice is already known to repeat: its places go out as plain echoes, spread
    over all buckets, and one entry without a place stands for it among equals. So no bucket grows with a hot window.
    """
    first, second = hashes
    order = np.lexsort((second, first))
    first, second, rid, pos = first[order], second[order], rid[order], pos[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    size = np.diff(np.append(np.flatnonzero(new), len(first)))
    alone = np.repeat(size == 1, size)
    lead = new
    bucket = (first >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64) if buckets > 1 else np.zeros(len(first), np.int64)
    where = np.where(alone, pos, NONE).astype(np.uint32)
    echo = np.flatnonzero(~alone)
    echo_bucket = (rid[echo] + pos[echo] // GROUP_WINDOWS) % buckets
    lead_at = np.flatnonzero(lead)
    cut = np.searchsorted(bucket[lead_at], np.arange(buckets + 1))
    by_bucket = np.argsort(echo_bucket, kind="stable")
    echo_cut = np.searchsorted(echo_bucket[by_bucket], np.arange(buckets + 1))
    rows: dict[str, list] = {c: [] for c in ("bucket", "h1", "h2", "rid", "pos", "echo_rid", "echo_pos")}
    for b in np.flatnonzero((np.diff(cut) > 0) | (np.diff(echo_cut) > 0)):
        i, e = lead_at[cut[b] : cut[b + 1]], echo[by_bucket[echo_cut[b] : echo_cut[b + 1]]]
        for name, value in zip(
            rows,
            (int(b), first[i].tobytes(), second[i].tobytes(), rid[i].tobytes(), where[i].tobytes(), rid[e].tobytes(), pos[e].astype(np.uint32).tobytes()),
        ):
            rows[name].append(value)
    if rows["bucket"]:
        yield pa.record_batch({c: pa.array(v, pa.int64() if c == "bucket" else pa.binary()) for c, v in rows.items()})


BUNDLE = "bucket bigint, h1 binary, h2 binary, rid binary, pos binary, echo_rid binary, echo_pos binary"


def _answers(rid: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(rid, kind="stable")
    rid, pos = rid[order], pos[order]
    cut = np.append(np.flatnonzero(np.diff(rid, prepend=rid[:1] - 1)), len(rid))
    if len(cut) > 1:
        yield pa.record_batch(
            {
                "rid": pa.array(rid[cut[:-1]], pa.int64()),
                "pos": pa.array([pos[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
            }
        )


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: group one bucket at a time and tell every document the starts of its repeated windows."""
    held: list[dict] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        col = {c: np.concatenate([np.frombuffer(r[c], t) for r in held]) for c, t in (("h1", np.uint64), ("h2", np.uint32), ("rid", np.int64), ("pos", np.uint32))}
        order = np.lexsort((col["h2"], col["h1"]))
        h1, h2 = col["h1"][order], col["h2"][order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        size = np.diff(np.append(np.flatnonzero(new), len(h1)))
        again = np.zeros(len(h1), bool)
        again[order] = np.repeat(size > 1, size)
        tell = again & (col["pos"] != NONE)
        rid = np.concatenate([col["rid"][tell], *[np.frombuffer(r["echo_rid"], np.int64) for r in held]])
        pos = np.concatenate([col["pos"][tell], *[np.frombuffer(r["echo_pos"], np.uint32) for r in held]])
        held.clear()
        yield from _answers(rid, pos)

    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield from flush()
            held.append(row)
    yield from flush()


def remove_repeated(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the kept words joined by one space).

    A word goes if a window of ``width`` words that covers it also starts elsewhere in the input, the same document
    included. Null and empty texts have no words; texts shorter than a window lose none; repeated rows repeat each other.
    The column ``kept`` is the text for documents that lose words and null for the others; ``kept_sha256`` holds the
    digest in either case, so that untouched text is not moved.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = 2 / (width - gram + 2)  # expected anchors per word
    counters = power_of_two(8 * share * size / 6, LEAST_WIDTH, MOST_WIDTH)
    bits = spark.sparkContext.broadcast(sketch(docs, counters, width, gram))

    def prefilter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                words = space_words(part)
                hit = _candidates(part, words, bits.value, width, gram)
                starts = np.diff(np.searchsorted(hit, words.first))
                open_ = starts > 0
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(part.lo, len(part)),
                        "n_words": pa.array(words.counts, pa.int64()),
                        "windows": pa.array(starts, pa.int64()),
                        "kept_sha256": pa.array([None if o else _digest(part.text(i).split()) for i, o in enumerate(open_)], pa.string()),
                        "text": pa.array([part.text(i).decode() if o else None for i, o in enumerate(open_)], pa.string()),
                    }
                )

    first = docs.select("doc_id", "text").mapInArrow(prefilter, f"doc_id {id_type}, n_words bigint, windows bigint, kept_sha256 string, text string")
    path = scratch_path(spark, "prefiltered")
    first.withColumn("open", F.col("windows") > 0).withColumn("rid", F.monotonically_increasing_id()).write.partitionBy("open").parquet(path)
    stored = spark.read.schema(f"doc_id {id_type}, n_words bigint, windows bigint, kept_sha256 string, text string, rid bigint, open boolean").parquet(path)
    done = stored.where(~F.col("open")).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept"))
    left = stored.where(F.col("open"))
    windows = left.agg(F.sum("windows")).first()[0] or 0
    buckets = power_of_two(windows / GROUP_WINDOWS, 64, 1 << 30)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                words = space_words(part)
                hit = _candidates(part, words, bits.value, width, gram)
                if not len(hit):
                    continue
                doc = np.searchsorted(words.first, hit, "right") - 1
                rid = np.asarray(batch.column("rid"))[part.lo : part.hi][doc]
                pair = [window_hash(words, hit, width, 0), (window_hash(words, hit, width, 1) >> np.uint64(32)).astype(np.uint32)]
                yield from _bundle(pair, rid, hit - words.first[doc], buckets)

    answers = (
        left.select("rid", "text")
        .mapInArrow(explode, BUNDLE)
        .repartition(max(shuffle_partitions(spark), 1), "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_group, "rid bigint, pos binary")
        .groupBy("rid")
        .agg(F.collect_list("pos").alias("starts"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digest, kept = [], [], []
            for text, starts in zip(batch.column("text"), batch.column("starts")):
                words = text.as_py().encode().split()
                at = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(s, np.uint32) for s in starts.as_py() or []]]).astype(np.int64)
                gone = covered(len(words), np.unique(at), width)
                rest = [w for w, g in zip(words, gone.tolist()) if not g]
                removed.append(len(words) - len(rest))
                digest.append(_digest(rest))
                kept.append(b" ".join(rest).decode())
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_words": batch.column("n_words"),
                    "n_removed": pa.array(removed, pa.int64()),
                    "kept_sha256": pa.array(digest, pa.string()),
                    "kept": pa.array(kept, pa.string()),
                }
            )

    changed = left.select("rid", "doc_id", "n_words", "text").join(answers, "rid", "left").mapInArrow(
        cut, f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string, kept string"
    )
    return done.unionByName(changed)
