"""Benchmark decontamination with suffix arrays of the training text.

Every slice of documents is a shard. Its suffix array lists the word suffixes in lexicographic order; each suffix of
each benchmark item is binary-searched in it (upper and lower end of the run sharing a window, and the longest
verbatim match with its place). Words that no benchmark item contains can only end a match, so suffixes are cut at
them, and suffixes whose first words begin no benchmark suffix cannot take part and are left out of the array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.words import WINDOW_BASES, Slice, Words, covered, folded_words, powers, slices, spans_hash

WINDOW = 10
LEAD = 3
DEEP = 24  # words compared one by one before fingerprints of whole spans are
TIED = 192  # the same for suffixes that stay equal while they are sorted
BLOCK_BYTES = 16 << 20
SPAN_BASE = WINDOW_BASES[1]


def _runs_end(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word the end of the run of known words of its document that it lies in."""
    n = len(ids)
    stop = np.where(ids < 0, np.arange(n), n)
    bound = np.repeat(first[1:], np.diff(first))
    nearest = np.minimum.accumulate(stop[::-1])[::-1] if n else stop
    return np.minimum(nearest, bound)


def suffix_array(ids: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The suffixes ``ids[p:ends[p]]``, p in ``at``, in lexicographic order (equal ones by position).

    Three word ids are compared at a time, and only among suffixes that are still equal; from ``TIED`` words on, suffixes that are still
    equal are ranked by prefix doubling, so that long repeats cost logarithmically many rounds.
    """
    key = _key(ids, ends, at, 0)
    by = np.argsort(key, kind="stable")
    order, key = at[by], key[by]
    opens = np.ones(len(order), bool)  # where a group of suffixes that are equal so far begins
    opens[1:] = key[1:] != key[:-1]
    depth = 3
    while len(order):
        if depth >= TIED:
            rank = doubled_ranks(ids, ends)
            return at[np.argsort(rank[at], kind="stable")]
        group = np.cumsum(opens) - 1
        unfinished = np.zeros(group[-1] + 1, bool)
        unfinished[group[(np.bincount(group)[group] > 1) & (order + depth < ends[order])]] = True
        tied = np.flatnonzero(unfinished[group])
        if not len(tied):
            break
        key = _key(ids, ends, order[tied], depth)
        by = np.lexsort((key, group[tied]))
        order[tied], key = order[tied][by], key[by]
        opens[tied[1:]] |= key[1:] != key[:-1]
        depth += 3
    return order


def doubled_ranks(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rank of every suffix ``ids[p:ends[p]]``, equal for equal ones: ranks of 1, 2, 4, ... words, each from two of half the length."""
    n = len(ids)
    place = np.arange(n)
    rank = np.where(place < ends, ids + 1, 0)
    width, distinct = 1, 0
    while True:
        after = place + width
        second = np.where(after < ends, rank[np.minimum(after, n - 1)], 0)
        values, rank = np.unique(rank.astype(np.int64) * (max(int(rank.max(initial=0)), int(second.max(initial=0))) + 1) + second, return_inverse=True)
        rank = rank + 1
        if len(values) == distinct or width >= n:
            return rank
        distinct, width = len(values), 2 * width


def _key(ids: np.ndarray, ends: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Words depth..depth+2 of each suffix as one number; 0 stands for the end."""
    out = np.zeros(len(at), np.uint64)
    for d in range(depth, depth + 3):
        p = at + d
        inside = p < ends[at]
        word = np.where(inside, ids[np.minimum(p, len(ids) - 1)] + 1, 0).astype(np.uint64)
        out = (out << np.uint64(21)) | word
    return out


class Spans:
    """Fingerprints of any spans of a list of word ids, from running sums."""

    def __init__(self, ids: np.ndarray):
        up, _ = powers(SPAN_BASE, len(ids) + 1)
        self.total = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum((ids + 1).astype(np.uint64) * up[: len(ids)], out=self.total[1:])

    def hash(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        _, down = powers(SPAN_BASE, len(self.total))
        return (self.total[start + size] - self.total[start]) * down[start]


class Benchmark:
    """One block of benchmark items, as word ids over its own vocabulary."""

    def __init__(self, item_ids: list, texts: list[str], window: int = WINDOW):
        part = next(slices(pa.array(texts or [""], pa.large_string()), 1 << 62))
        words = folded_words(part)
        self.item_ids = item_ids
        self.vocabulary = np.unique(words.hash)
        if len(self.vocabulary) >= 1 << 21:
            raise ValueError("a benchmark block holds at most 2**21 different words; use smaller blocks")
        self.ids = np.searchsorted(self.vocabulary, words.hash).astype(np.int64)
        counts = words.counts
        self.item = words.doc()
        self.end = np.repeat(words.first[1:], counts)
        self.spans = Spans(self.ids)
        self.window = np.minimum(window, counts)[self.item] if len(self.ids) else np.zeros(0, np.int64)
        self.lead = int(min(LEAD, counts[counts > 0].min())) if len(self.ids) else LEAD
        at = np.arange(len(self.ids))
        at = at[at + self.lead <= self.end]
        self.leads = np.unique(spans_hash(self.ids.astype(np.uint64) + np.uint64(1), at, at + self.lead, WINDOW_BASES[0]))
        #: one bit per hash prefix: most training words and leads fall out here
        self.word_bits = np.zeros(1 << 16, bool)
        self.word_bits[self.vocabulary >> np.uint64(48)] = True

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        ids = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.word_bits[hashes >> np.uint64(48)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at[at == len(self.vocabulary)] = 0
        same = self.vocabulary[at] == hashes[maybe]
        ids[maybe[same]] = at[same]
        return ids


class Shard:
    """Suffix array of one slice of training documents against one benchmark block."""

    def __init__(self, words: Words, bench: Benchmark):
        self.bench = bench
        self.ids = bench.lookup(words.hash)
        self.ends = _runs_end(self.ids, words.first)
        at = np.flatnonzero(np.arange(len(self.ids)) + bench.lead <= self.ends)
        if len(at):
            lead = spans_hash((self.ids + 1).astype(np.uint64), at, at + bench.lead, WINDOW_BASES[0])
            pos = np.searchsorted(bench.leads, lead)
            pos[pos == len(bench.leads)] = 0
            at = at[bench.leads[pos] == lead]
        self.order = suffix_array(self.ids, self.ends, at)
        self.spans: Spans | None = None

    def compare(self, places: np.ndarray, suffixes: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of shard suffix against the first ``limit`` words of a benchmark suffix, and the words they share."""
        bench = self.bench
        lcp = np.zeros(len(places), np.int64)
        sign = np.zeros(len(places), np.int64)
        live = np.arange(len(places))
        depth = 0
        while len(live):
            live = live[depth < limit[live]]
            if depth == DEEP:
                sign[live], lcp[live] = self._compare_spans(places[live], suffixes[live], limit[live])
                break
            p, s = places[live] + depth, suffixes[live] + depth
            a = np.where(p < self.ends[places[live]], self.ids[np.minimum(p, len(self.ids) - 1)], -1)
            b = np.where(s < bench.end[suffixes[live]], bench.ids[np.minimum(s, len(bench.ids) - 1)], -1)
            differ = (a != b) | (b < 0)
            sign[live[differ]] = np.sign(a[differ] - b[differ])
            lcp[live] = depth + ~differ
            live = live[~differ]
            depth += 1
        return sign, lcp

    def _compare_spans(self, p: np.ndarray, s: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for suffixes that share ``DEEP`` words: how far they agree is found by halving, on fingerprints of spans."""
        bench = self.bench
        low = np.full(len(p), DEEP, np.int64)
        high = np.minimum(np.minimum(self.ends[p] - p, bench.end[s] - s), limit)
        if self.spans is None:
            self.spans = Spans(self.ids)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) >> 1
            same = self.spans.hash(p[open_], mid) == bench.spans.hash(s[open_], mid)
            low[open_[same]] = mid[same]
            high[open_[~same]] = mid[~same] - 1
        a = np.where(p + low < self.ends[p], self.ids[np.minimum(p + low, len(self.ids) - 1)], -1)
        b = np.where(s + low < bench.end[s], bench.ids[np.minimum(s + low, len(bench.ids) - 1)], -1)
        return np.where(low < limit, np.sign(a - b), 0), low

    def bound(self, suffixes: np.ndarray, limit: np.ndarray, upper: bool) -> np.ndarray:
        """First place in the suffix array not below (upper: above) the first ``limit`` words of each suffix."""
        lo = np.zeros(len(suffixes), np.int64)
        hi = np.full(len(suffixes), len(self.order), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            sign, _ = self.compare(self.order[mid], suffixes[open_], limit[open_])
            right = sign <= 0 if upper else sign < 0
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        return lo

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every occurrence of an item's window: a benchmark word position, shard word position; and for every
        benchmark suffix its longest verbatim match and where it begins (length 0: none)."""
        bench = self.bench
        suffixes = np.arange(len(bench.ids))
        whole = bench.end - suffixes
        longest = np.zeros(len(suffixes), np.int64)
        place = np.full(len(suffixes), -1, np.int64)
        if not len(self.order):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), longest, place
        at = self.bound(suffixes, whole, upper=False)
        for near in (at - 1, at):
            ok = np.flatnonzero((near >= 0) & (near < len(self.order)))
            _, lcp = self.compare(self.order[near[ok]], suffixes[ok], whole[ok])
            better = lcp > longest[ok]
            longest[ok[better]] = lcp[better]
            place[ok[better]] = self.order[near[ok[better]]]
        full = np.flatnonzero((whole >= bench.window) & (longest >= bench.window))
        lo, hi = self.bound(full, bench.window[full], False), self.bound(full, bench.window[full], True)
        # a window that an item repeats has the same range each time
        _, once = np.unique(np.stack([bench.item[full], lo, hi]), axis=1, return_index=True)
        full, lo, hi = full[once], lo[once], hi[once]
        count = hi - lo
        which = np.repeat(full, count)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        return which, self.order[np.repeat(lo, count) + inside], longest, place


def scan_slice(words: Words, bench: Benchmark) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Per document: hit flags of all words, items found, and the longest verbatim match in words."""
    n_docs = len(words.counts)
    items: list[np.ndarray] = [np.zeros(0, np.int64)] * n_docs
    longest_in = np.zeros(n_docs, np.int64)
    hit = np.zeros(len(words.hash), bool)
    if not len(bench.ids) or not len(words.hash):
        return hit, items, longest_in
    which, where, longest, place = Shard(words, bench).search()
    if len(which):
        hit = covered(len(hit), where, bench.window[which])
        doc = np.searchsorted(words.first, where, "right") - 1
        pairs = np.unique(np.stack([doc, bench.item[which]]), axis=1)
        cut = np.searchsorted(pairs[0], np.arange(n_docs + 1))
        items = [pairs[1][cut[d] : cut[d + 1]] for d in range(n_docs)]
    found = place >= 0
    np.maximum.at(longest_in, np.searchsorted(words.first, place[found], "right") - 1, longest[found])
    return hit, items, longest_in


def _digest(ids) -> str:
    return hashlib.sha256(",".join(sorted({str(i) for i in ids})).encode()).hexdigest()


def load_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[tuple[list, list[str]]]:
    """The benchmark in blocks of about ``block_bytes``: the stated query set, all of whose blocks the driver and the workers hold."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    blocks = []
    for b in range(n):
        rows = items.where(part == b).collect()
        blocks.append(([r[0] for r in rows], [r[1] for r in rows]))
    return blocks


def scan(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (texts of the ids, sorted), longest_match, contaminated.

    Null text counts as empty; items without words or text are never found; items with a null id mark words but are not
    listed; repeated item ids count once. Each row of ``docs`` gives its own row, also when doc_id repeats.
    A benchmark of several blocks is searched block by block within the same pass.
    """
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(Benchmark(i, t)) for i, t in load_blocks(benchmark, block_bytes)]
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                words, found = _scan_part(part, blocks)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(part.lo, len(part)),
                        "n_words": pa.array(words.counts, pa.int64()),
                        "n_hit": pa.array(found["n_hit"], pa.int64()),
                        "items": pa.array(found["items"], pa.list_(pa.string())),
                        "longest_match": pa.array(found["longest"], pa.int64()),
                    }
                )

    rows = docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, n_words bigint, n_hit bigint, items array<string>, longest_match bigint"
    )
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        "longest_match", (F.col("n_hit") > 0).alias("contaminated"),
    )


def _scan_part(part: Slice, blocks) -> tuple[Words, dict]:
    words = folded_words(part)
    hit = np.zeros(len(words.hash), bool)
    names: list[set[str]] = [set() for _ in range(len(part))]
    longest = np.zeros(len(part), np.int64)
    for block in blocks:
        bench = block.value
        more, items, length = scan_slice(words, bench)
        hit |= more
        longest = np.maximum(longest, length)
        for d, found in enumerate(items):
            names[d].update(str(bench.item_ids[i]) for i in found if bench.item_ids[i] is not None)
    total = np.concatenate([[0], np.cumsum(hit)])
    return words, {"n_hit": total[words.first[1:]] - total[words.first[:-1]], "items": [sorted(x) for x in names], "longest": longest}


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, all columns kept, in one pass and without a shuffle."""
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(Benchmark(i, t)) for i, t in load_blocks(benchmark, block_bytes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                _, found = _scan_part(part, blocks)
                keep = pa.array(found["n_hit"] == 0)
                yield batch.slice(part.lo, len(part)).filter(keep)

    return docs.mapInArrow(run, docs.schema)
