"""What the pipeline's stages leave on the driver."""

from __future__ import annotations

import corpus_pipeline


def test_stages_bound_parser_states_and_plan_texts(spark):
    names = ["spark.sql.parser.manageParserCaches", "spark.sql.parser.parserDfaCacheFlushThreshold", "spark.sql.maxPlanStringLength"]
    before = [spark.conf.get(n) for n in names]
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        assert corpus_pipeline.shipped(lambda spark, docs, sf_dir: docs)(spark, docs, "").count() == 1
        kept, states, length = (spark.conf.get(n) for n in names)
        assert kept == "true" and 0 < int(states) <= 10_000 and int(length.rstrip("b")) <= 100_000
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
