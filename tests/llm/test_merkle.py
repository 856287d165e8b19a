from __future__ import annotations

import hashlib
import zlib

import pytest

from tabloom.llm import merkle
from tests.llm.fixtures import SCHEMA, awkward, row, table


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def reduce(level):
    """Levels of one tree, leaves first."""
    levels = [level]
    while len(level) > 1:
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        levels.append(level)
    return levels


def brute(rows):
    by_source = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        by_source.setdefault(source, []).append((doc_id, text, lang, source, n_chars))
    trees = {}
    for source, members in by_source.items():
        members = [(leaf(d, s, lang, n, t), d, t, lang, s, n) for d, t, lang, s, n in members]
        members.sort(key=lambda m: (m[1] is not None, m[1] or 0, m[0]))
        trees[source] = (members, reduce([m[0] for m in members]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = reduce([trees[s][1][-1][0] for s in order])
    out = []
    for k, source in enumerate(order):
        members, levels = trees[source]
        for i, (digest, d, t, lang, s, n) in enumerate(members):
            hit = d is not None and t is not None and zlib.crc32(str(d).encode()) % 2 == 0
            now = leaf(d, s, lang, n, t.replace("\n", "")) if hit else digest
            siblings = []
            for tree, place in ((levels, i), (top, k)):
                for level in tree[:-1]:
                    run = level[place // 3 * 3 : place // 3 * 3 + 3]
                    siblings += run[: place % 3] + run[place % 3 + 1 :]
                    run[place % 3] = now
                    now = h(*run)
                    place //= 3
            out.append((d, digest, levels[-1][0], top[-1][0], h(*siblings), now, now == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("height", [1, 2, merkle.HEIGHT])
def test_manifest_equals_brute_force(spark, height):
    rows = awkward() + [row(1000 + i, f"line {i}\nline", source="hot") for i in range(40)]
    rows += [row(2000 + i, "x\n", source=f"s{i}") for i in range(30)] + [row(1003, "line 3\nline", source="hot")] * 5
    got = merkle.manifest(table(spark, rows).repartition(4), height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_single_leaf_and_text_ids(spark):
    schema = SCHEMA.replace("doc_id bigint", "doc_id string")
    rows = [("a", "one\ntwo", None, None, None, None, None)]
    (got,) = merkle.manifest(spark.createDataFrame(rows, schema)).collect()
    assert tuple(got) == brute(rows)[0] and got.leaf == got.subroot == got.root and got.proof_sha256 == h("")


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_queue_passes_digests_up_and_suffixes_down():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(11)]
    levels = merkle.levels_of(len(digests))
    runs = merkle.climb(digests, levels)
    root = runs[(levels + 1, 0)][0]
    assert root.hex() == reduce([d.hex() for d in digests])[-1][0]
    suffixes = merkle.descend(runs, levels, b"")
    assert all(merkle.fold(d, s) == root for d, s in zip(digests, suffixes))
    assert merkle.fold(digests[1], suffixes[0]) != root
