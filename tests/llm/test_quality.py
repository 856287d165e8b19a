from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

from tabloom.llm import quality
from tests.llm.fixtures import SCHEMA, prose, row, space_words, table


def bucket(gram: bytes) -> int:
    return ((int.from_bytes(gram, "big") * 0x9E3779B1) & 0xFFFFFFFF) >> 16


def grams(text) -> list[int]:
    data = (text or "").encode()
    return [bucket(data[i : i + 4]) for i in range(len(data) - 3)]


def brute(rows, labels):
    """Measures, score and verdict by plain Python."""
    trusted = {d for d, q in labels if q == 1 and d is not None}
    target, raw = Counter(), Counter()
    for r in rows:
        raw.update(grams(r[1]))
        if r[0] in trusted:
            target.update(grams(r[1]))
    nt, nr = sum(target.values()) + quality.BUCKETS, sum(raw.values()) + quality.BUCKETS

    def score(text):
        if not target:
            return 0.0
        return float(np.mean([math.log((target[g] + 1) / nt) - math.log((raw[g] + 1) / nr) for g in grams(text)] or [0.0]))

    known = [score(r[1]) for r in rows if r[0] in trusted]
    threshold = np.quantile(known, quality.QUANTILE) - quality.SLACK if known else -math.inf
    out = []
    for r in rows:
        text = r[1] or ""
        w = space_words(text)
        windows = Counter(zip(w, w[1:], w[2:]))
        cover = {k + i for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for i in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            dup += bool(re.search("[^\x20\x09-\x0D]", line)) and line in seen
            seen.add(line)
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        out.append((r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), failed, bool(not failed and score(text) >= threshold)))
    return sorted(out, key=repr)


def labelled(spark, pairs):
    return spark.createDataFrame([(d, q, 0) for d, q in pairs], "doc_id bigint, quality int, toxic int")


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def docs(spark):
    import random

    rnd = random.Random(4)
    rows = [tuple(r) for r in table(spark).collect()]
    rows += [row(500 + i, " ".join(w + "###" for w in prose(rnd, 120).split())) for i in range(3)]
    rows += [row(510, "a line\nb\na line\n \n \na line \n" + prose(rnd, 60)), row(511, "é b c é b c x é b c")]
    return table(spark, rows), rows


def test_equals_brute_force(spark):
    frame, rows = docs(spark)
    pairs = [(i, 1) for i in range(12)] + [(500, 0), (None, 1), (3, 1)]
    got = quality.judge(frame.repartition(3), labelled(spark, pairs)).select(*COLUMNS).collect()
    want = brute(rows, pairs)
    assert sorted(map(tuple, got), key=repr) == want
    assert any(w[-1] for w in want) and any(not w[-1] and not w[-2] for w in want)
    kept = quality.keep_good(frame, labelled(spark, pairs))
    assert kept.schema == frame.schema and kept.count() == sum(w[-1] for w in want)


def test_without_trusted_documents_the_base_rule_decides(spark):
    frame, rows = docs(spark)
    got = quality.judge(frame, labelled(spark, [])).collect()
    assert all(r.kept != r.base_failed for r in got) and len(got) == len(rows)


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], SCHEMA), labelled(spark, [(1, 1)])).collect() == []


def test_every_trusted_document_counts(spark):
    frame, rows = docs(spark)
    pairs = [(i, 1) for i in range(40_000)]  # far more labels than documents
    got = quality.judge(frame, labelled(spark, pairs))
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=repr) == brute(rows, pairs)
    labels = labelled(spark, pairs)
    assert quality.trusted_ids(labels).count() == 40_000


def test_lower_quantile_interpolates(spark):
    values = np.random.default_rng(3).normal(size=1234)
    frame = spark.createDataFrame([(float(v),) for v in values], "score double").repartition(3)
    for share in (0.0, 0.002, 0.0137):
        assert np.isclose(quality.lower_quantile(frame, share, len(values)), np.quantile(values, share), rtol=0, atol=1e-12)
