"""The pipeline's stages replayed by brute force on the smallest tables."""

from __future__ import annotations

import ast
from pathlib import Path

import corpus_pipeline
from tabloom.llm import minhash, queries
from tabloom.llm.common import fitted, read
from tests.conftest import SMALL
from tests.llm import test_decontaminate, test_minhash, test_quality, test_secrets


def test_every_stage_equals_brute_force(spark):
    docs = fitted(read(spark, SMALL, "documents"), "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "benchmark_decontamination", "secret_redaction", "source_mix"]
    columns = docs.columns

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    labels = [(r.doc_id, r.quality) for r in read(spark, SMALL, "labels").collect()]
    docs = fitted(stages["quality_rules"](spark, docs, SMALL), "s1")
    assert docs.columns == columns
    assert {r.doc_id for r in docs.collect()} == {b[0] for b in test_quality.brute(rows, labels) if b[-1]}

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    df, n = minhash.document_frequencies(docs)
    classes = test_minhash.brute_classes(rows, minhash.inverse_frequencies(df, n))
    docs = fitted(stages["near_dedup"](spark, docs, SMALL), "s2")
    assert docs.columns == columns
    assert sorted(r.doc_id for r in docs.collect()) == sorted(set(classes.values()))

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in read(spark, SMALL, "benchmark").collect()]
    docs = fitted(stages["benchmark_decontamination"](spark, docs, SMALL), "s3")
    assert docs.columns == columns
    assert sorted(r.doc_id for r in docs.collect()) == sorted(b[0] for b in test_decontaminate.brute(rows, items) if not b[-1])

    before = {r.doc_id: r.text for r in docs.collect()}
    docs = fitted(stages["secret_redaction"](spark, docs, SMALL), "s4")
    assert docs.columns == columns
    after = {r.doc_id: r for r in docs.collect()}
    assert set(after) == set(before)
    for doc_id, text in before.items():
        assert (after[doc_id].text != text) == bool(test_secrets.base(text)) or "[SECRET]" in after[doc_id].text
        assert after[doc_id].n_chars == len(after[doc_id].text) and not test_secrets.base(after[doc_id].text)

    mixed = stages["source_mix"](spark, docs, SMALL).collect()
    assert {r.doc_id for r in mixed} <= set(before) and all(r.whole_epochs or r.tail_tokens for r in mixed)


def test_an_empty_table_goes_through(spark):
    docs = read(spark, SMALL, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = fitted(stage(spark, docs, SMALL), name)
    assert docs.count() == 0


def test_all_operators_are_registered():
    found = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert found == list(range(1, 14)) and set(queries.SQL) <= set(queries.QUERIES)


def test_nothing_else_imports_the_package():
    root = Path(__file__).parents[2]
    for path in [*(root / "tabloom").rglob("*.py"), *(root / "tests").glob("*.py")]:
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path
