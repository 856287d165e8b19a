from __future__ import annotations

import hashlib
import re
from collections import Counter

from tabloom.llm import pii
from tests.llm.fixtures import SCHEMA, row, table

TEXTS = [
    "a@b.c_d@e.f x@y..z q@r.s.t. a.b@c-d.e.f", "1.2.3.4.5.6.7.8 999.1.1.1 007.0000255.3.4 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111 1111 11112 5500005555555559 1234567812345678", "+1 (2) 3456789 +12 +1234567890123456 +49 30 1234567",
    "é\x01@x.y\x01 a\x01b@c.d 12\x0134", "a@" + "b." * 20_000 + "c", "1 " * 20_000, "x" * 50_000, "1" * 50_000,
]
SEEDS = ["4111111111111111", "5500005555555559", "4012888888881881", "6011111111111117", "3530111333300000"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if "@" in text else []
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)] if "." in text else []
    out = [(k, m) for k, m in out if k != "ip" or all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def test_base_spans_equal_brute_force(spark):
    rows = [tuple(r) for r in table(spark).collect()] + [row(800 + i, t) for i, t in enumerate(TEXTS)]
    got = pii.digest(pii.find(table(spark, rows).repartition(3))).collect()
    want = []
    for r in rows:
        spans = base(r[1])
        kinds = Counter(k for k, *_ in spans)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        want.append((r[0], *(kinds[k] for k in pii.KINDS), hashlib.sha256(listed.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=repr) == sorted(want, key=repr)


def test_context_discovers_unseen_identifiers(spark):
    rows = [row(i, f"hello card number {s} thanks and bye") for i, s in enumerate(SEEDS * 2)]
    rows += [row(50, "hello card number 123456789012 thanks and bye"), row(51, "some other words 123456789013 here"), row(50, "hello card number 123456789012 thanks and bye")]
    got = pii.digest(pii.find(table(spark, rows))).collect()
    assert [r.spans for r in got if r.doc_id == 50] == ["found_card:18:30"] * 2
    assert [r.spans for r in got if r.doc_id == 51] == [""] and all(r.n_found == 0 for r in got if r.doc_id < 50)


def test_too_few_seeds_are_no_pattern(spark):
    rows = [row(i, f"hello card number {s} thanks and bye") for i, s in enumerate(SEEDS[:2] * 5)] + [row(50, "hello card number 123456789012 thanks and bye")]
    assert sum(r.n_found for r in pii.digest(pii.find(table(spark, rows))).collect()) == 0


def test_empty_table(spark):
    assert pii.find(spark.createDataFrame([], SCHEMA)).collect() == []


def test_neighbours_at_any_distance_and_grouped_identifiers(spark):
    rows = [row(i, f"hello card number {s} thanks and bye") for i, s in enumerate(SEEDS * 2)]
    texts = [
        "hello card number" + " " * 80 + "123456789012 thanks and bye", "hello card number 1234 5678 9012 thanks and bye", "hello card number (030) 555 7713 thanks",
        "hello card number" + "\n" * 3000 + "123456789013" + " " * 2000 + "thanks", "w" * 200 + " card number 123456789014 thanks",
    ]
    rows += [row(100 + i, t) for i, t in enumerate(texts)] + [row(200, "1 2 " * 20_000)]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(table(spark, rows))).collect()}
    for i, found in enumerate(("123456789012", "1234 5678 9012", "(030) 555 7713", "123456789013", "123456789014")):
        at = texts[i].index(found)
        assert got[100 + i] == f"found_card:{at}:{at + len(found)}", (i, got[100 + i])
    assert got[200] == ""


def brute_rounds(seen):
    """The graph rounds on (value, seed, pattern) rows."""
    import math
    from collections import defaultdict

    links = set(seen)
    values, seeds = defaultdict(set), defaultdict(set)
    for value, seed, pattern in links:
        values[pattern].add(value)
        if seed:
            seeds[pattern, seed].add(value)
    graph = {(p, k): values[p] for (p, k), s in seeds.items() if len(s) >= pii.SUPPORT}
    sure = {(v, s) for v, s, _ in links if s}
    strings = dict.fromkeys(sure, 1.0)
    patterns = {}
    for _ in range(pii.ROUNDS):
        patterns = {(p, k): round(sum(strings.get((v, k), 0) for v in vs) / (len(vs) + pii.SMOOTH), 9) for (p, k), vs in graph.items()}
        logs = defaultdict(float)
        for (p, k), vs in graph.items():
            for v in vs:
                logs[v, k] += math.log(max(1e-9, 1 - patterns[p, k]))
        strings = {key: 1.0 if key in sure else round(1 - math.exp(total), 9) for key, total in logs.items()}
    return patterns, strings


def test_graph_rounds_equal_brute_force(spark):
    import random

    rnd = random.Random(4)
    seen = []
    for i in range(400):
        pattern = f"p{rnd.randrange(12)}"
        value = rnd.randrange(60)
        seen.append((f"v{value}", ("card", "ip", None, None)[value % 4] if rnd.random() < 0.7 else None, pattern))
    patterns, strings = pii.pattern_confidence(spark.createDataFrame(seen, "value string, seed string, pattern string"))
    want_patterns, want_strings = brute_rounds(seen)
    assert {(r.pattern, r.kind): round(r.conf, 6) for r in patterns.collect()} == {k: round(v, 6) for k, v in want_patterns.items()}
    assert {(r["value"], r.kind): round(r.conf, 6) for r in strings.collect()} == {k: round(v, 6) for k, v in want_strings.items()}
