from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from tabloom.llm import substrings
from tests.llm.fixtures import SCHEMA, row, space_words, table


def brute(rows, width):
    count = Counter()
    for r in rows:
        w = space_words(r[1])
        count.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    out = []
    for r in rows:
        w = space_words(r[1])
        gone = {i for k in range(len(w) - width + 1) if count[tuple(w[k : k + width])] > 1 for i in range(k, k + width)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width,gram", [(35, 12), (5, 2)])
def test_equals_brute_force(spark, width, gram):
    rows = table(spark).repartition(4)
    got = substrings.remove_repeated(rows, width, gram).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute([tuple(r) for r in rows.collect()], width)


def test_a_crowded_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MOST_WIDTH", 1 << 20)
    monkeypatch.setattr(substrings, "LEAST_WIDTH", 1 << 20)
    monkeypatch.setattr(substrings, "estimated_repeated", lambda bits, anchors: anchors == anchors)
    rows = table(spark)
    got = substrings.remove_repeated(rows, 5, 2).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute([tuple(r) for r in rows.collect()], 5)


def test_windows_repeat_inside_one_document(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = table(spark, [row(1, text + " middle " + text)])
    assert [(r.n_removed, r.kept) for r in substrings.remove_repeated(rows).collect()] == [(80, "middle")]


def test_empty_table(spark):
    assert substrings.remove_repeated(spark.createDataFrame([], SCHEMA)).collect() == []
