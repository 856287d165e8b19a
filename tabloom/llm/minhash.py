"""Near-duplicate classes by improved consistent weighted sampling.

A document is a weighted set of word shingles (``SHINGLE`` folded words, or all its words if it has fewer). The weight of
a shingle is its count times the mean inverse document frequency of its words, hashed to ``FEATURES`` features and counted
over all documents. The frequency is taken from words, not from whole shingles, because a shingle's own frequency counts
exactly what copies share: in a group of thousands it would shrink the common part and with it every similarity. For the same
reason it only adds up to ``IDF`` to a word's weight of 1, and a pair also counts if it reaches the threshold on plain counts:
an edit that brings in rare words must not part a copy from its original.

``BANDS * ROWS`` consistent weighted samples make ``BANDS`` band keys; two documents sharing one are candidates, unless fewer
than ``LEAST_EQUAL`` of all samples agree, and are linked if their generalised Jaccard similarity, sum of minima over sum of
maxima, is at least ``THRESHOLD``. A pair at that similarity shares a band with probability 1 - (1 - 0.8**5)**16 = 0.998 and
agrees in 64 of 80 samples with a standard deviation of 3.6, so the second condition costs it less than 0.001. Classes are
the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import fitted, summed
from tabloom.llm.components import components
from tabloom.llm.words import Words, folded_words, mix, slices, window_hash

SHINGLE = 5
THRESHOLD = 0.8
FEATURES = 1 << 18
BANDS, ROWS = 16, 5
LEAST_EQUAL = 53
SKETCH = [f"s{i}" for i in range(BANDS * ROWS // 16)]  # 4 bits of every sample
TABLE = 1 << 16
SEED = 20240917
IDF = 0.5
BLOCK = 512  # members of a block, and its text at most
BLOCK_BYTES = 16 << 20


def _feature(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (FEATURES.bit_length() - 1))).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents holding each hashed word feature, and all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            total[FEATURES] += batch.num_rows
            for part in slices(batch.column("text")):
                words = folded_words(part)
                seen = np.unique(words.doc() * FEATURES + _feature(words.hash))
                total[:FEATURES] += np.bincount(seen % FEATURES, minlength=FEATURES)
        return total

    found = summed(docs.select("text"), count, FEATURES + 1)
    return found[:FEATURES], int(found[FEATURES])


def inverse_frequencies(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Weights of word features, from 1 (in every document) to 1 + IDF (in none)."""
    return 1 + IDF * np.log((n_docs + 1) / (df + 1)) / np.log(n_docs + 2)


def counted_shingles(words: Words, idf: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, ...]:
    """Distinct shingles: document (ascending), fingerprint, weight, count."""
    counts = words.counts
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), n)
    if not len(doc):
        return doc, np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)
    start = np.repeat(words.first[:-1], n) + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(width, counts)[doc]
    total = np.concatenate([[0.0], np.cumsum(idf[_feature(words.hash)])])
    mean = (total[start + size] - total[start]) / size
    shingle = window_hash(words, start, size)
    order = np.lexsort((shingle, doc))
    doc, shingle, mean = doc[order], shingle[order], mean[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(doc)))
    return doc[at], shingle[at], mean[at] * times, times


def weighted_shingles(words: Words, idf: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return counted_shingles(words, idf, width)[:3]


_VARIATES: list = []


def _variates():
    """r and c ~ Gamma(2, 1), beta ~ U(0, 1): per table place 1/r, r, beta and ln c - r; a multiplier for each sample."""
    if not _VARIATES:
        draw = np.random.Generator(np.random.PCG64(SEED))
        r, c, beta = draw.gamma(2.0, 1.0, TABLE), draw.gamma(2.0, 1.0, TABLE), draw.random(TABLE)
        odd = draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        _VARIATES.append([*(x.astype(np.float32) for x in (1 / r, r, beta, np.log(c) - r + 64)), odd])
    return _VARIATES[0]


def samples(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """One consistent sample (32 bits of shingle and level) per document and function; rows of documents without shingles are 0."""
    inverse, r, beta, base, odd = _variates()
    out = np.zeros((n_docs, len(odd)), np.uint32)
    if not len(doc):
        return out
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    have = doc[first]
    log_weight = np.log(weight).astype(np.float32)
    low = shingle.astype(np.uint32)
    bits = np.uint64(64 - (TABLE.bit_length() - 1))
    for k, factor in enumerate(odd):
        at = ((shingle * factor) >> bits).astype(np.int32)
        level = np.floor(log_weight * inverse[at] + beta[at])
        value = base[at] - r[at] * (level - beta[at])  # ln a + 64, positive in any practical range
        np.maximum(value, np.float32(1e-30), out=value)
        sample = low + level.astype(np.int32).astype(np.uint32) * np.uint32(0x9E3779B1)
        code = (value.view(np.uint32).astype(np.uint64) << np.uint64(32)) | sample
        out[have, k] = np.minimum.reduceat(code, first).astype(np.uint32)
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    """A 64-bit key per document and band."""
    keys = np.zeros((len(found), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(found), band + 1, np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + found[:, k].astype(np.uint64))
        keys[:, band] = h
    return keys


def sketch_words(found: np.ndarray) -> np.ndarray:
    """The last 4 bits of every sample, 16 samples in a 64-bit number."""
    low = (found & np.uint32(15)).astype(np.uint64).reshape(len(found), -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(low, axis=2)


def _equal_samples(a: str, b: str) -> str:
    """SQL for the number of samples that agree in their 4 bits."""
    ones = "1229782938247303441L"  # 0x1111111111111111
    each = []
    for s in SKETCH:
        x = f"({a}.{s} ^ {b}.{s})"
        each.append(f"bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & {ones})")
    return f"{BANDS * ROWS} - ({' + '.join(each)})"


def similarity(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """Generalised Jaccard of two weighted sets (sorted fingerprints, weights, counts): the larger of weights and counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    best = 0.0
    for x, y in zip(a[1:], b[1:]):
        low = np.minimum(x[i], y[j]).sum()
        high = x.sum() + y.sum() - low
        best = max(best, float(low / high) if high > 0 else 0.0)
    return best


def _signatures(docs: DataFrame, idf) -> DataFrame:
    """rid, a 128-bit digest of the text, its bytes, band keys (null for texts without words), 4 bits of every sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                words = folded_words(part)
                found = samples(*weighted_shingles(words, idf.value), len(part))
                keys, low = band_keys(found).view(np.int64), sketch_words(found).view(np.int64)
                has = words.counts > 0
                yield pa.record_batch(
                    {
                        "rid": batch.column("rid").slice(part.lo, len(part)),
                        "h1": batch.column("h1").slice(part.lo, len(part)),
                        "h2": batch.column("h2").slice(part.lo, len(part)),
                        "size": pa.array(np.diff(part.offsets), pa.int64()),
                        "bands": pa.array([k.tolist() if h else None for k, h in zip(keys, has)], pa.list_(pa.int64())),
                        **{name: pa.array(np.ascontiguousarray(low[:, i])) for i, name in enumerate(SKETCH)},
                    }
                )

    sketch = "".join(f", {name} bigint" for name in SKETCH)
    id_type = docs.schema["rid"].dataType.simpleString()
    return docs.select("rid", "h1", "h2", "text").mapInArrow(run, f"rid {id_type}, h1 bigint, h2 bigint, size bigint, bands array<bigint>{sketch}")


def _only(docs: DataFrame, ids: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """``docs`` (rid, h1, h2, text) that ``ids`` (rid, h1, h2, key) names, as (key, text). A bitmap of rid of fixed size, broadcast, keeps most other texts out of the shuffle;
    once it is full it lets all through and the join alone decides."""
    place = f"cast(pmod(xxhash64(rid), {bits}) as int)"

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for batch in batches:
            seen[np.asarray(batch.column("p"))] = True
        yield pa.record_batch({"mask": pa.array([np.packbits(seen).tobytes()], pa.binary())})

    table = np.zeros(bits // 8, np.uint8)
    for row in ids.selectExpr(f"{place} as p").coalesce(8).mapInArrow(mark, "mask binary").collect():  # at most 8 bitmaps
        table |= np.frombuffer(row["mask"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.asarray(batch.column("p"))
            keep = (shared.value[p >> 3] >> (7 - (p & 7))) & 1 == 1
            yield batch.filter(pa.array(keep)).select(["rid", "h1", "h2", "text"])

    found = docs.selectExpr("rid", "h1", "h2", "text", f"{place} as p").mapInArrow(run, docs.select("rid", "h1", "h2", "text").schema)
    return found.join(ids, ["rid", "h1", "h2"]).select("key", "text")


def _same_id(signed: DataFrame, exact: DataFrame) -> DataFrame:
    """Links (a, b) between the keys of the texts that share a doc_id."""
    pair = F.struct("h1", "h2")
    several = signed.groupBy("rid").agg(F.min(pair).alias("lo"), F.max(pair).alias("hi")).where("lo <> hi").select("rid", "lo")
    links = signed.join(several, "rid").where("struct(h1, h2) <> lo").selectExpr("lo.h1 as l1", "lo.h2 as l2", "h1", "h2").distinct()
    first = exact.select(F.col("h1").alias("l1"), F.col("h2").alias("l2"), F.col("key").alias("a"))
    return links.join(first, ["l1", "l2"]).join(exact.select("h1", "h2", F.col("key").alias("b")), ["h1", "h2"]).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    joined = (
        pairs.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), "a")
        .sortWithinPartitions("a")
        .select("a", "b", "text_a", "text_b")
    )

    def shingle_sets(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        for part in slices(column):
            doc, *rest = counted_shingles(folded_words(part), idf.value)
            cut = np.searchsorted(doc, np.arange(len(part) + 1))
            for d in range(len(part)):
                yield tuple(x[cut[d] : cut[d + 1]] for x in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int | None, tuple] = (None, ())
        for batch in batches:
            a = np.asarray(batch.column("a"))
            keep = np.zeros(len(a), bool)
            for i, other in enumerate(shingle_sets(batch.column("text_b"))):
                if known[0] != a[i]:
                    known = (a[i], next(shingle_sets(batch.column("text_a").slice(i, 1))))
                keep[i] = similarity(known[1], other) >= threshold
            yield pa.record_batch({"a": batch.column("a").filter(pa.array(keep)), "b": batch.column("b").filter(pa.array(keep))})

    return joined.mapInArrow(run, "a bigint, b bigint")


def _matched_blocks(rows: DataFrame, idf, threshold: float) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different components.

    A bucket is cut into blocks of about ``BLOCK`` members; every pair of blocks (i, j) is a group of its own, so a task never
    holds more than two blocks however large the bucket is. Inside, samples are compared first, then exact similarities; a
    pair is looked at only in the first band that it shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            links = _links(group)
            if links:
                a, b = zip(*links)
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def _links(group: pa.Table) -> list[tuple[int, int]]:
        if group.num_rows < 2:
            return []
        rid, component = (np.asarray(group.column(c)) for c in ("rid", "component"))
        block, i, j = (np.asarray(group.column(c)) for c in ("block", "i", "j"))
        bands = np.asarray(group.column("bands").combine_chunks().flatten()).reshape(len(rid), BANDS)
        sketch = np.stack([np.asarray(group.column(c)).view(np.uint64) for c in SKETCH], axis=1)
        band = int(np.flatnonzero(bands[0] == group.column("bucket")[0].as_py())[0])
        sets: dict[int, tuple] = {}
        root = {int(c): int(c) for c in component}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        def shingles(k: int) -> tuple:
            if k not in sets:
                part = next(slices(group.column("text").slice(k, 1)))
                sets[k] = counted_shingles(folded_words(part), idf.value)[1:]
            return sets[k]

        links = []
        for x in range(len(rid) - 1):
            y = np.arange(x + 1, len(rid))
            y = y[(component[y] != component[x]) & ((block[y] != block[x]) | (i[x] == j[x]))]
            diff = sketch[y] ^ sketch[x]
            diff |= diff >> np.uint64(1)
            diff |= diff >> np.uint64(2)
            unequal = np.bitwise_count(diff & np.uint64(0x1111111111111111)).sum(axis=1)
            y = y[BANDS * ROWS - unequal >= LEAST_EQUAL]
            for k in y[(bands[y] == bands[x]).argmax(axis=1) == band].tolist():
                a, b = find(int(component[x])), find(int(component[k]))
                if a != b and similarity(shingles(x), shingles(k)) >= threshold:
                    root[max(a, b)] = min(a, b)
                    links.append((int(min(rid[x], rid[k])), int(max(rid[x], rid[k]))))
        return links

    keys = ["bucket", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "rid").mapInArrow(run, "a bigint, b bigint")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal (bucket, i, j); the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("bucket", "i", "j")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            key = tuple(keys[:, lo])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def text_classes(keyed: DataFrame, threshold: float = THRESHOLD, same_id: bool = True) -> tuple[DataFrame, DataFrame]:
    """Of ``keyed`` (rid, h1, h2, text): signed rows (rid, h1, h2) and the classes of the texts (h1, h2, rep, rows, component).

    ``rep`` is the smallest id that holds a text, ``rows`` how many do. With ``same_id`` the texts of one id are one class.

    Band buckets are not expanded into pairs. First each compares its most central member, the one that shares most buckets with
    others (an original among its copies), with the rest. What is then in one component needs no further comparison; in buckets that
    still hold several components, members of different ones are matched block by block, and only links leave the tasks.
    """
    df, n_docs = document_frequencies(keyed)
    idf = keyed.sparkSession.sparkContext.broadcast(inverse_frequencies(df, n_docs))
    signed = fitted(_signatures(keyed, idf), "signatures")

    # equal texts: one representative carries on, under a key of its own, because a doc_id may have several texts
    first = [F.first(c).alias(c) for c in ("size", "bands", *SKETCH)]
    exact = signed.groupBy("h1", "h2").agg(F.min("rid").alias("rep"), F.count("*").alias("rows"), *first)
    exact = fitted(exact.withColumn("key", F.monotonically_increasing_id()), "texts")
    bands = exact.where(F.col("bands").isNotNull()).select(F.col("key").alias("rid"), F.explode("bands").alias("bucket"), F.col("size").alias("bytes"), *SKETCH)
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("bytes").alias("all_bytes")).where("size > 1")
    shared = fitted(bands.drop("bytes").join(sizes, "bucket"), "buckets")
    central = shared.groupBy("rid").agg(F.sum("size").alias("central"))
    wanted = fitted(exact.join(central.select(F.col("rid").alias("key")), "key").select(F.col("rep").alias("rid"), "h1", "h2", "key"), "wanted")
    texts = fitted(_only(keyed, wanted).groupBy(F.col("key").alias("rid")).agg(F.min("text").alias("text")), "texts")

    tops = shared.join(central, "rid").groupBy("bucket").agg(F.max_by(F.struct("rid", *SKETCH), F.struct("central", -F.col("rid"))).alias("t"))
    near = _verified(fitted(shared.alias("m").join(tops.selectExpr("bucket", "t.*").alias("t"), "bucket").where(
        f"m.rid <> t.rid and {_equal_samples('m', 't')} >= {LEAST_EQUAL}"
    ).selectExpr("t.rid as a", "m.rid as b").distinct(), "pairs"), texts, idf, threshold)
    stars = components(near.union(_same_id(signed, exact)) if same_id else near)
    state = stars.select(F.col("id").alias("rid"), "component")
    now = shared.join(state, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    mixed = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK), F.ceil(F.col("all_bytes") / BLOCK_BYTES)).cast("int")
    open_ = (
        now.join(mixed, "bucket").join(texts, "rid").join(exact.select(F.col("key").alias("rid"), "bands"), "rid")
        .withColumn("blocks", blocks).withColumn("block", F.expr("cast(pmod(xxhash64(rid), blocks) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rid", "component", "bands", *SKETCH, "text")
    )
    added = fitted(_matched_blocks(open_, idf, threshold), "near")
    if not added.isEmpty():
        # what the first round found is a star per component: it takes the place of its links
        stars = components(added.union(state.where("rid <> component").select(F.col("component").alias("a"), F.col("rid").alias("b"))))
    idf.destroy()
    classes = exact.select("h1", "h2", "key", "rep", "rows").join(stars.select(F.col("id").alias("key"), "component"), "key", "left")
    return signed.select("rid", "h1", "h2"), classes.select("h1", "h2", "rep", "rows", F.coalesce("component", "key").alias("component"))


def _keyed(docs: DataFrame) -> DataFrame:
    usable = F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    return docs.where(usable).select(F.col("doc_id").alias("rid"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of its class), class_size (rows in the class).

    Equal texts are one class whatever they hold, and so are the texts of one doc_id; null texts and null ids stay alone (a null id is its own class of null).
    Texts without words have no shingles and are linked by equality only. Repeated rows fall into one class. Ids may be numbers or text.
    """
    signed, classes = text_classes(_keyed(docs), threshold)
    classes = fitted(classes, "classes")
    size = classes.groupBy("component").agg(F.min("rep").alias("class_id"), F.sum("rows").alias("class_size"))
    classes = classes.join(size, "component").select("h1", "h2", "class_id", "class_size")
    found = signed.join(classes, ["h1", "h2"]).select(F.col("rid").alias("doc_id"), "class_id", "class_size")
    alone = docs.where(F.col("text").isNull() | F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return found.unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class of texts: the smallest id of the class, and of equal rows one.

    Different texts under one id are classes of their own here, so that no text is lost. Rows with a null id or null text all stay.
    """
    _, classes = text_classes(_keyed(docs), threshold, same_id=False)
    first = fitted(classes.groupBy("component").agg(F.min(F.struct("rep", "h1", "h2")).alias("f")).select("f.rep", F.col("f.h1").alias("_h1"), F.col("f.h2").alias("_h2")), "first")
    alone = F.col("doc_id").isNull() | F.col("text").isNull()
    keyed = docs.where(~alone).withColumn("_h1", F.xxhash64("text")).withColumn("_h2", F.xxhash64(F.lit(1), "text"))
    kept = keyed.join(first.withColumnRenamed("rep", "doc_id"), ["doc_id", "_h1", "_h2"], "left_semi").dropDuplicates(["doc_id", "_h1", "_h2"])
    return kept.select(*docs.columns).unionByName(docs.where(alone))
