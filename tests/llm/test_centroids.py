from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tabloom.llm import centroids

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string"


def brute(rows, k=centroids.K, rounds=centroids.ROUNDS):
    kept = []
    for vec_id, vector, *_ in rows:
        if vector is not None and len(vector) == 64 and all(x is not None and np.isfinite(x) for x in vector):
            kept.append((vec_id, [int(np.floor(64 * float(np.float32(x)))) for x in vector]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [list(v) for _, v in sorted(kept, key=key)[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((min(range(len(d)), key=lambda i: (d[i], i)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centres)):
            mine = [v for (_, v), (a, _) in zip(kept, found) if a == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    total = sum(d for _, d in found)
    part = {c: sum(d for a, d in found if a == c) for c in range(len(centres))}
    return sorted(((i, c, d, part[c], total, names[c]) for (i, _), (c, d) in zip(kept, found)), key=repr)


def sample(n=400, seed=3):
    rnd = random.Random(seed)
    base = [[rnd.gauss(0, 0.4) for _ in range(64)] for _ in range(12)]
    rows = [(i, [x + rnd.gauss(0, 0.15) for x in base[i % 12]], 1, "x") for i in range(n)]
    same = rows[0][1]
    rows += [(1000 + i, same, None, None) for i in range(150)] + [(7, rows[7][1], 1, "x")] * 3
    rows += [(None, base[3], 0, None), (2000, None, 0, None), (2001, [], 0, None), (2002, [0.1] * 63, 0, None), (2003, [0.1] * 65, 0, None)]
    rows += [(2004, [0.1] * 63 + [None], 0, None), (2005, [0.1] * 63 + [float("nan")], 0, None), (2006, [float("inf")] + [0.0] * 63, 0, None)]
    return rows + [(2007, [0.0] * 64, 0, None), (2008, [-1.0, 1.0] * 32, 0, None)]


def test_clusters_equal_brute_force(spark):
    rows = sample()
    got = centroids.cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = sample()[:5]
    got = centroids.cluster_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    for none in ([], sample()[-9:-2]):
        assert centroids.cluster_vectors(spark.createDataFrame(none, SCHEMA)).collect() == []


def test_encoding_is_lossless(spark):
    rows = sample(50)
    whole = centroids.whole_vectors(spark.createDataFrame(rows, SCHEMA))
    batches = centroids.encode(whole).toArrow().to_batches()
    back = []
    for batch in batches:
        for ids, codes, words in centroids.chunks(batch):
            assert all(len(np.unique(w, axis=0)) == len(w) for w in words)
            q = np.concatenate([w[c] for c, w in zip(codes, words)], axis=1)
            back += list(zip(ids.to_pylist(), q.tolist()))
    assert sorted(back, key=repr) == sorted(((r.vec_id, r.q) for r in whole.collect()), key=repr)


def test_components_beyond_64_bit_distances_stop_the_job(spark):
    rows = [(1, [1e30] + [0.0] * 63, 0, None)]
    with pytest.raises(Exception, match="too large"):
        centroids.cluster_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
