"""Small tables with every awkward case: nulls, empty and long texts, repeated rows, extra columns, clashing names."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, _t string"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def word(rnd: random.Random) -> str:
    return "".join(rnd.choice(LETTERS) for _ in range(rnd.randint(2, 7)))


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(word(rnd) for _ in range(n))


def row(doc_id, text, lang="en", source="src1"):
    return (doc_id, text, lang, source, None if text is None else len(text), 0.5, "x")


def awkward(seed: int = 1) -> list[tuple]:
    rnd = random.Random(seed)
    shared = prose(rnd, 60)
    original = prose(rnd, 300)
    words = original.split()
    words[100] = "changed"
    near = " ".join(words)
    rows = [row(i, prose(rnd, rnd.randint(60, 200)), source=f"src{i % 13}") for i in range(20)]
    rows += [
        row(100, original), row(101, near), row(102, original), row(103, original + " and a tail"),
        row(110, prose(rnd, 50) + "\n" + shared + "\n" + prose(rnd, 50)), row(111, shared + " " + prose(rnd, 80)),
        row(120, None), row(121, ""), row(122, " \n\t "), row(123, "one"), row(124, "é ü ß"), row(None, prose(rnd, 70)), row(None, None, None, None),
        row(130, prose(rnd, 20_000)), row(131, "x" * 30_000), row(132, "a b " * 3000),
        row(0, rows[0][1], source="src0"), row(140, prose(rnd, 80), None, None),
        row(150, "tok\x0bone\x0ctwo\r\nthree " + prose(rnd, 60)), row(151, " nbsp   wide " + prose(rnd, 60)),
    ]
    return rows


def table(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def space_words(text) -> list[str]:
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def folded_words(text) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
