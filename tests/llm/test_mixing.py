from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabloom.llm import mixing
from tabloom.llm.common import read
from tests.compare import differences, duck
from tests.conftest import SMALL
from tests.llm.fixtures import SCHEMA, row, space_words, table


def fill(budget, children):
    """Water-filling by trial: children (name, capacity, weight) -> budget; full ones drop out until nothing changes."""
    out, rest, open_ = {}, budget, dict((n, (c, w)) for n, c, w in children if w > 0)
    while True:
        total = sum(w for _, w in open_.values())
        full = [n for n, (c, w) in open_.items() if c * total <= rest * w]
        if not full:
            return out | {n: rest * w // total for n, (c, w) in open_.items()}
        first = min(full, key=lambda n: (open_[n][0] / open_[n][1], n))
        out[first] = open_.pop(first)[0]
        rest -= out[first]
        if not open_:
            return out


@pytest.mark.parametrize("budget", [0, 1, 7, 50, 99, 100, 1000])
def test_shares_equal_water_filling(spark, budget):
    children = [("a", 10, 5), ("b", 20, 1), ("c", 0, 3), ("d", 70, 2), ("e", 5, 5), ("f", 9, 0)]
    frame = spark.createDataFrame([(0, *c) for c in children], "p int, name string, capacity bigint, weight bigint")
    got = mixing.share(spark.createDataFrame([(0, budget)], "p int, budget bigint"), frame, ["p"]).collect()
    assert {r.name: r.budget for r in got} == fill(budget, children)


def test_same_rows_as_sql(spark):
    docs = read(spark, SMALL, "documents").select("doc_id", "lang", "source", "text")
    assert differences(mixing.mix_documents(docs).drop("text").toPandas(), duck(SMALL).execute(mixing.SQL).df()) == []


def levels():
    return [mixing.Level("lang", F.col("lang"), F.lit(1)), mixing.Level("source", F.col("source"), F.expr("case when source = 'out' then 0 else 1 end"))]


def test_awkward_rows(spark):
    rows = [tuple(r) for r in table(spark).collect()] + [row(900, "not in the mix " * 30, "en", "out")]
    docs = table(spark, rows)
    got = mixing.mix(docs, levels(), (1, 2), 2).collect()
    assert len(got) == len(rows)
    words = sum(len(space_words(r[1])) for r in rows)
    used = sum(r.n_tokens * r.whole_epochs + r.tail_tokens for r in got)
    assert words // 2 - 40 <= used <= words // 2
    assert all(r.whole_epochs == r.tail_tokens == 0 for r in got if r.source == "out" or r.n_tokens == 0 and r.tail_tokens)
    assert all(0 <= r.tail_tokens <= r.n_tokens for r in got)
    again = mixing.mix(docs.repartition(5), levels(), (1, 2), 2).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_prefix_is_cut_inside_one_document(spark):
    rows = [row(i, "w " * 10, "en", "s") for i in range(200)]
    got = mixing.mix(table(spark, rows), levels(), (1, 3), 1).collect()
    tails = sorted(r.tail_tokens for r in got)
    assert sum(tails) == 666 and [t for t in tails if 0 < t < 10] == [6]


def test_epochs_repeat_a_small_source(spark):
    rows = [row(1, "w " * 10, "en", "small"), row(2, "w " * 90, "en", "large")]
    got = {r.source: r for r in mixing.mix(table(spark, rows), levels(), (1, 2), 3).collect()}
    assert (got["small"].whole_epochs, got["small"].tail_tokens, got["large"].tail_tokens) == (2, 5, 25)


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA), levels()).collect() == []


def test_null_and_empty_text_ids_have_places_of_their_own(spark):
    schema = SCHEMA.replace("doc_id bigint", "doc_id string")
    rows = [row(None, "one two three"), row("", "one two three")]
    got = mixing.mix_documents(spark.createDataFrame(rows, schema)).collect()
    # a budget of three fifths of six tokens: three, not three for each
    assert sum(3 * r.whole_epochs + r.tail_tokens for r in got) == 3
