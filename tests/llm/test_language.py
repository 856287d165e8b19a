from __future__ import annotations

import zlib

from tabloom.llm import language
from tabloom.llm.common import read
from tests.conftest import SMALL
from tests.llm.fixtures import SCHEMA, row, table


def test_held_out_accuracy(spark):
    docs = read(spark, SMALL, "documents")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert {d for d in got if got[d].held_out} == set(held)
    assert sum(got[d].lang_pred == truth[d] for d in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_the_row_are_no_input(spark):
    docs = read(spark, SMALL, "documents")
    model = language.fit(docs)
    assert language.fit(docs.repartition(7))["languages"] == model["languages"]
    held = docs.where(language.is_held_out(docs.doc_id))
    other = docs.where(~language.is_held_out(docs.doc_id)).unionByName(held.selectExpr("doc_id", "text", "'zz' as lang", "'s' as source", "n_chars"))
    a = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.identify(docs).collect()}
    b = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.identify(other).collect()}
    assert a == b


def test_awkward_rows(spark):
    docs = table(spark)
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in language.identify(docs).collect()), key=repr)
    assert len(got) == docs.count()
    assert all(r == (r[0], "und", 0.0) for r in got if r[0] in (120, 121, 122))
    assert all(r[1] == "en" and r[2] == 1.0 for r in got if r[0] in (123, 124, 131))
    nothing = table(spark, [row(1, "text", None), row(2, "1 2 3", "en")])
    assert {r.lang_pred for r in language.identify(table(spark, [row(1, "text", None)])).collect()} == {"und"}
    assert {r.doc_id: r.lang_pred for r in language.identify(nothing).collect()}[2] == "und"
    assert language.identify(spark.createDataFrame([], SCHEMA)).collect() == []


def test_families():
    assert language.family_of("de") == language.family_of("en") != language.family_of("fr")
    assert language.family_of("xx") == "xx"
