from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa

from tabloom.llm import minhash
from tabloom.llm.components import components
from tabloom.llm.words import folded_words, slices
from tests.llm.fixtures import SCHEMA, prose, row, table


def brute_classes(rows, idf):
    """Class of every (id, text): exact similarities of all pairs sharing a shingle, single linkage."""
    sets = {}
    for doc_id, text in rows:
        if doc_id is not None and text is not None:
            sets[doc_id] = minhash.counted_shingles(folded_words(next(slices(pa.array([text])))), idf)[1:]
    text_of = {d: t for d, t in rows if d is not None and t is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if text_of[a] == text_of[b] or minhash.similarity(sets[a], sets[b]) >= minhash.THRESHOLD:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_classes_equal_brute_force(spark):
    import random

    rnd = random.Random(5)
    base = [prose(rnd, 200).split() for _ in range(6)]
    rows = [tuple(r)[:2] for r in table(spark).collect()]
    for k in range(60):
        words = list(base[k % 6])
        for _ in range(k // 6):
            words[rnd.randrange(200)] = prose(rnd, 1)
        rows.append((1000 + k, " ".join(words)))
    docs = table(spark, [row(*r) for r in rows]).repartition(5)
    df, n = minhash.document_frequencies(docs)
    want = brute_classes(rows, minhash.inverse_frequencies(df, n))
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id in want} == want
    assert all(r.class_id == r.doc_id and r.class_size == 1 for r in got if r.doc_id is None or r.doc_id == 120)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.class_id] += 1
    assert all(r.class_size == sizes[r.class_id] for r in got if r.doc_id is not None)
    assert len(set(want.values())) < len(want)


def test_keep_one(spark):
    docs = table(spark)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert len(ids) == len(set(ids)) and {100, 120, 121}.issubset(ids) and not {101, 102, 103} & set(ids)


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    test_classes_equal_brute_force(spark)


def test_samples_estimate_the_weighted_similarity():
    rng = np.random.default_rng(0)
    shingle = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    weight = rng.random(3000) + 0.5
    a, b = slice(0, 2600), slice(400, 3000)
    pair = [minhash.samples(np.zeros(2600, np.int64), shingle[s], weight[s], 1)[0] for s in (a, b)]
    low = weight[400:2600].sum()
    assert abs((pair[0] == pair[1]).mean() - low / weight.sum()) < 0.15


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_one_id_with_several_texts(spark):
    import random

    rnd = random.Random(11)
    texts = [prose(rnd, 200) for _ in range(5)]
    near = [" ".join([*t.split()[:-1], "otherwise"]) for t in texts]
    rows = [(40, texts[0]), (40, texts[1]), (41, near[0]), (42, near[1]), (43, texts[1])]
    rows += [(50, texts[2]), (51, texts[2]), (51, texts[3]), (52, texts[3]), (60, near[4]), (61, texts[4])]
    docs = table(spark, [row(*r) for r in rows]).repartition(3)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.class_id, r.class_size) for r in got} == (
        {(i, 40, 5) for i in (40, 41, 42, 43)} | {(i, 50, 4) for i in (50, 51, 52)} | {(i, 60, 2) for i in (60, 61)}
    )
    # one row per class of texts: an id stays once for each of its texts that no smaller id holds
    kept = sorted((r.doc_id, r.text) for r in minhash.keep_one(docs).collect())
    assert kept == sorted([(40, texts[0]), (40, texts[1]), (50, texts[2]), (51, texts[3]), (60, near[4])])


def test_text_ids_and_unrelated_texts_of_one_id(spark):
    import random

    rnd = random.Random(12)
    one, two = prose(rnd, 80), prose(rnd, 80)
    schema = SCHEMA.replace("doc_id bigint", "doc_id string")
    rows = [("b", one), ("a", one), ("c", two), ("c", two), ("d", None), (None, two), ("e", prose(rnd, 60)), ("e", prose(rnd, 60))]
    docs = spark.createDataFrame([row(*r) for r in rows], schema)
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in minhash.near_duplicates(docs).collect() if r.doc_id)
    assert got == [("a", "a", 2), ("b", "a", 2), ("c", "c", 2), ("c", "c", 2), ("d", "d", 1), ("e", "e", 2), ("e", "e", 2)]
    assert sorted(str(r.doc_id) for r in minhash.keep_one(docs).collect()) == ["None", "a", "c", "d", "e", "e"]
