from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tabloom.llm import decontaminate
from tests.llm.fixtures import SCHEMA, awkward, folded_words, row, table

ITEMS = [
    (1, " ".join(awkward()[3][1].split()[10:40]).upper()), (2, awkward()[20][1][:200]), (3, "One"), (4, "é ü"), (5, None), (6, ""), (7, "never seen anywhere"),
    (None, awkward()[5][1][:150]), (3, "ß"), (8, " ".join(awkward()[4][1].split()[:10])), (9, awkward()[6][1] + " nothing after this"),
]


def brute(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = folded_words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else []:
            windows[tuple(w[k : k + n])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for r in rows:
        w, hit, found = folded_words(r[1]), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if seen := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= {str(i) for i in seen if i is not None}
        out.append((r[0], len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_equals_brute_force(spark, block_bytes):
    rows = table(spark).repartition(3)
    got = decontaminate.scan(rows, bench(spark), block_bytes).collect()
    want = brute([tuple(r) for r in rows.collect()], ITEMS)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got), key=repr) == want
    assert {r.n_items for r in got} >= {0, 1}


def test_longest_match_goes_beyond_the_window(spark):
    rows = table(spark, [row(1, "x y " + " ".join(f"w{i}" for i in range(30)) + " z")])
    got = decontaminate.scan(rows, bench(spark, [(1, " ".join(f"w{i}" for i in range(5, 40)))])).first()
    assert (got.longest_match, got.n_hit) == (25, 25)


def test_clean_keeps_rows_and_columns(spark):
    rows = table(spark)
    kept = decontaminate.clean(rows, bench(spark))
    assert kept.schema == rows.schema
    want = brute([tuple(r) for r in rows.collect()], ITEMS)
    assert kept.count() == sum(not w[-1] for w in want)


def test_empty_tables(spark):
    assert decontaminate.scan(spark.createDataFrame([], SCHEMA), bench(spark)).collect() == []
    got = decontaminate.scan(table(spark), bench(spark, [])).collect()
    assert len(got) == len(awkward()) and not any(r.contaminated for r in got)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    ids = rng.integers(-1, 3, 400)
    first = np.array([0, 120, 120, 400])
    ends = decontaminate._runs_end(ids, first)
    at = np.flatnonzero(np.arange(400) < ends)
    order = decontaminate.suffix_array(ids, ends, at)
    suffixes = [tuple(ids[p : ends[p]]) for p in order]
    assert suffixes == sorted(suffixes) and sorted(order) == at.tolist()


def test_long_repeats_take_logarithmically_many_rounds(spark):
    import time

    started = time.monotonic()
    words = decontaminate.folded_words(next(decontaminate.slices(pa.array(["again " * 100_000]), 1 << 62)))
    ids = np.zeros(100_000, np.int64)
    order = decontaminate.suffix_array(ids, np.full(100_000, 100_000), np.arange(100_000))
    assert order.tolist() == list(range(99_999, -1, -1))
    bench = decontaminate.Benchmark([1, 2], ["again " * 20_000, "again " * 30 + "and " + "again " * 30])
    hit, items, longest = decontaminate.scan_slice(words, bench)
    assert hit.all() and longest.tolist() == [20_000] and items[0].tolist() == [0, 1]
    assert time.monotonic() - started < 20


def test_deep_matches_equal_plain_search(spark):
    rnd = random.Random(8)
    base = [rnd.choice("abc") for _ in range(400)]
    texts = [" ".join(base), " ".join(base[:180] + ["a"] + base[181:]), " ".join(base[50:] + base[:50]), "a " * 300, "a b " * 150, " ".join(base[100:160])]
    items = [(i, t) for i, t in enumerate([" ".join(base[20:380]), "a " * 90, " ".join(base[300:340]), "a b " * 40 + "c", "b " * 40])]
    rows = [row(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.scan(table(spark, rows), spark.createDataFrame(items, "item_id int, text string")).collect()}
    for doc, *_, in rows:
        words = texts[doc].split()
        hit, found = set(), set()
        for item, text in items:
            own = text.split()
            windows = {tuple(own[k : k + 10]) for k in range(len(own) - 9)}
            for k in range(len(words) - 9):
                if tuple(words[k : k + 10]) in windows:
                    hit.update(range(k, k + 10))
                    found.add(item)
        assert got[doc] == (len(hit), len(found), bool(hit))
