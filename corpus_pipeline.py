"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, secrets, source mix.

Every stage takes (spark, docs, sf_dir), docs with the columns of ``documents``, and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. Empty input gives empty output; nulls are handled as the operators state.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import decontaminate, minhash, mixing, quality, secrets
from tabloom.llm.common import fitted, read
from tabloom.session import ship_package, spare_driver

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def shipped(stage: Stage) -> Stage:
    """The stage, its workers supplied with the library's source, its plans kept small on the driver."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        spare_driver(spark)
        return stage(spark, docs, sf_dir)

    return run


@shipped
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the likelihood ratio.

    A null or empty text fails the base rule and goes; repeated rows are judged alike; a document whose score equals the threshold
    stays. Extra columns are carried along. Without labels only the base rule counts; no documents give none.
    """
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


@shipped
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id.

    Rows with a null id or text all stay, since nothing can be said of them; of equal rows one stays; different texts under one id are
    judged apart. Texts without words are linked by equality only. Extra columns are carried along.
    """
    return minhash.keep_one(docs)


@shipped
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window.

    Null and empty texts stay; an item of fewer words than a window is one window, an item without words is none. Repeated rows are
    judged alike. Extra columns are carried along.
    """
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


@shipped
def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and ``n_chars`` recounted where a text changed.

    Null texts stay null; repeated rows are masked alike; where secrets overlap, one mask stands for them. Extra columns are carried along.
    """
    return secrets.redact(docs)


@shipped
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the target mix, with their whole passes and, for the open epoch, the tokens of their prefix.

    Adds ``domain``, ``n_tokens``, ``whole_epochs`` and ``tail_tokens``, which replace columns of these names; in ``lang`` and ``source``
    null becomes empty text, a node of its own. Texts without tokens, null ones included, take no part. Documents that tie in the order
    of an epoch (equal id and length) share their place and the tokens cut from it.
    """
    return mixing.mix_documents(docs).where("whole_epochs > 0 or tail_tokens > 0")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_redaction", secret_redaction),
    ("source_mix", source_mix),
]

#: SQL can express neither the likelihood ratio nor the weighted sampling; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = fitted(stage(spark, docs, sf_dir), name)
    return docs
