from __future__ import annotations

import base64

import numpy as np
import pytest

from tabloom.llm import separators
from tabloom.llm.common import fitted
from tests.llm.fixtures import SCHEMA, table


def encoding():
    import tiktoken

    with open(separators.TOKENIZER, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=separators.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_tokenizer(spark):
    docs = table(spark)
    enc = encoding()
    want = sorted(((r.doc_id, len(enc.encode_ordinary(r.text or ""))) for r in docs.collect()), key=repr)
    assert sorted(map(tuple, separators.count_document_tokens(docs.repartition(3)).collect()), key=repr) == want


@pytest.mark.parametrize("block,group", [(1, 2), (7, 3), (1000, 1024)])
def test_boundaries_are_stitched(spark, monkeypatch, block, group):
    monkeypatch.setattr(separators, "GROUP", group)
    rng = np.random.default_rng(block)
    rows, want = [], []
    for file in range(3):
        stream = rng.integers(0, 4, 200).astype(np.uint16)
        if file == 2:
            stream[20:180] = 1  # a document over many blocks
        at = np.flatnonzero(stream == 0)
        lengths = np.diff(at, prepend=-1) - 1
        want += [(file, i, int(n), True) for i, n in enumerate(lengths)]
        if rest := len(stream) - 1 - at[-1]:
            want.append((file, len(lengths), int(rest), False))
        rows += [(file, k, stream[a : a + block].tobytes()) for k, a in enumerate(range(0, 200, block))]
    blocks = spark.createDataFrame(rows + rows[:1], "file int, block bigint, data binary")
    got = separators.scan(blocks, end=0).select("file", "ordinal", "n_tokens", "closed").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_flat_files_from_storage(spark, tmp_path):
    stream = np.array([5, 6, 9, 9, 7, 9, 8], np.uint16)
    (tmp_path / "a.bin").write_bytes(stream.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    got = separators.scan(separators.read_flat_files(spark, str(tmp_path), block_tokens=2), end=9).orderBy("ordinal").collect()
    assert [(r.n_tokens, r.closed) for r in got] == [(2, True), (0, True), (1, True), (1, False)]


def test_blocks_of_any_size_keep_documents_and_ids(spark):
    docs = table(spark)
    want = sorted(map(tuple, separators.count_document_tokens(docs).collect()), key=repr)
    for size in (3, 64):
        files = fitted(separators.token_files(docs.repartition(2), block_tokens=size), "files")
        got = separators.scan(files, names="doc_ids").where("closed").select("name", "n_tokens").collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_empty_and_null_blocks(spark):
    empty = spark.createDataFrame([], "file int, block bigint, data binary")
    assert separators.scan(empty).collect() == []
    got = separators.scan(spark.createDataFrame([(1, 0, None), (1, 1, b"")], "file int, block bigint, data binary")).collect()
    assert got == []
    assert separators.count_document_tokens(spark.createDataFrame([], SCHEMA)).collect() == []


def test_text_ids(spark):
    schema = "doc_id string, text string"
    rows = [("a", "one two"), ("a", "one two"), (None, ""), ("", None)]
    got = separators.count_document_tokens(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.doc_id), r.n_tokens > 0) for r in got) == [("", False), ("None", False), ("a", True), ("a", True)]
