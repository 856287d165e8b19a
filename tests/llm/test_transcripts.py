from __future__ import annotations

from itertools import product

import numpy as np
import pytest

from tabloom.llm import transcripts
from tabloom.llm.common import read
from tests.conftest import SMALL

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_roles_are_recovered(spark):
    rows = read(spark, SMALL, "conversations")
    got = transcripts.parse(rows).join(rows.select("conv_id", "turn", "role"), ["conv_id", "turn"]).collect()
    assert sum(r.role == r.role_pred for r in got) > 0.9 * len(got)


@pytest.mark.parametrize("block", [1, 3])
def test_blocks_give_the_same_path(spark, monkeypatch, block):
    rows = read(spark, SMALL, "conversations")
    whole = sorted(map(tuple, transcripts.parse(rows).collect()))
    monkeypatch.setattr(transcripts, "BLOCK", block)
    model = transcripts.fit(transcripts.ordered(rows))
    assert sorted(map(tuple, transcripts.parse(rows, model).collect())) == whole


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(2)
    model = transcripts.Model(rng.random((3, 5, transcripts.LENGTHS)) * 9, rng.random((3, 4, 3)) * 9)
    codes = np.stack([rng.integers(0, n, 6) for n in transcripts.FEATURES.values()], axis=1)
    score, kind = model.scores(codes), model.kinds(codes, True)

    def total(path):
        return sum(model.step[kind[i]][path[i - 1] if i else transcripts.START, s] + score[i, s] for i, s in enumerate(path))

    best = max(product(range(3), repeat=6), key=total)
    matrix = model.matrix(codes, True)[transcripts.START]
    assert np.isclose(matrix.max(), total(best))
    assert tuple(model.decode(codes, True, transcripts.START, int(matrix.argmax()))) == best


def test_markers_and_rendering(spark):
    text = "System: be nice\nUser: hello?\nhow are you\n### Assistant: fine\nthanks\n[human]: ok"
    got = transcripts.parse(spark.createDataFrame([(1, 0, None, text)], SCHEMA)).orderBy("part").collect()
    assert [(r.role_pred, r.n_lines) for r in got] == [("system", 1), ("user", 2), ("assistant", 2), ("user", 1)]
    assert got[1].rendered == "<|user|>\nhello?\nhow are you\n<|end|>"


def test_awkward_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, "user", None), (None, 1, None, "x"), (None, 2, "tool", "y\nz"), (2, 5, "assistant", ""), (3, 0, "user", "w " * 50_000)]
    frame = spark.createDataFrame([(*r, "extra", 1) for r in rows], SCHEMA + ", block string, part int")
    got = transcripts.parse(frame).collect()
    assert sorted({(r.conv_id, r.turn) for r in got}, key=repr) == sorted({(r[0], r[1]) for r in rows}, key=repr)
    assert transcripts.parse(spark.createDataFrame([], SCHEMA)).collect() == []


def test_roles_have_no_part_in_the_order(spark):
    rows = [(1, 3, "user", "hello there?"), (1, 3, "assistant", "fine, thanks"), (1, None, "user", "zz"), (1, None, "assistant", "aa")] * 2
    swapped = [(c, t, {"user": "assistant", "assistant": "user"}[r], x) for c, t, r, x in rows]
    model = transcripts.fit(transcripts.ordered(spark.createDataFrame(rows, SCHEMA)))
    a, b = (sorted(map(tuple, transcripts.parse(spark.createDataFrame(r, SCHEMA), model).collect()), key=repr) for r in (rows, swapped))
    assert a == b and len(a) == 4


@pytest.mark.parametrize("conv_type", ["decimal(20,0)", "date", "string"])
def test_rows_without_turns_are_cut_into_blocks(spark, monkeypatch, conv_type):
    monkeypatch.setattr(transcripts, "BLOCK", 50)
    one = f"cast({'date(now())' if conv_type == 'date' else 7} as {conv_type})"
    rows = spark.range(1000).selectExpr(f"{one} as conv_id", "cast(null as bigint) as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('line ', id) as text")
    blocks = transcripts.ordered(rows)
    assert blocks.selectExpr("max(size(turn))").first()[0] <= 50 and blocks.count() >= 20
    got = transcripts.parse(rows)
    assert got.count() == 1000 and got.schema["conv_id"].dataType.simpleString() == conv_type


def test_a_pile_of_equal_rows_is_one_row(spark):
    rows = spark.range(30_000).selectExpr("1L as conv_id", "1L as turn", "'user' as role", "'hello?' as text")
    assert len(transcripts.parse(rows).collect()) == 1
