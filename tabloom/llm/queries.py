"""Registered queries of this package: each applies one operator with its production parameters to the whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import centroids, decontaminate, language, merkle, minhash, mixing, pii, quality, secrets, separators, sitetree, substrings, transcripts
from tabloom.llm.common import hex_sha, read
from tabloom.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes and prefix tokens that every document contributes to the mix."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return mixing.mix_documents(docs).drop("text")


SQL["op1_source_mix"] = mixing.SQL


@query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, fixed forms and random strings."""
    return secrets.digest(secrets.find(read(spark, sf_dir, "documents")))


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, fixed forms and identifiers found by their context."""
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


@query
def op5_chat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of all conversations with recovered roles, in canonical form."""
    return transcripts.parse(read(spark, sf_dir, "conversations"))


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeated 35-word passages, removed from every document."""
    return substrings.remove_repeated(read(spark, sf_dir, "documents")).drop("kept")


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, likelihood-ratio score and verdict of every document."""
    judged = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return judged.select(*[c for c in judged.columns if c not in ("text", "score")], "score")


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identify(read(spark, sf_dir, "documents"))


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which benchmark windows occur."""
    found = decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    digest = hex_sha(F.array_join("items", ",")).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated", "longest_match")


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted by separators in flat token files."""
    return separators.count_document_tokens(read(spark, sf_dir, "documents"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that its tampered row leads to."""
    return merkle.manifest(read(spark, sf_dir, "documents"))


SQL["op11_merkle_manifest"] = merkle.SQL


@query
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after three rounds."""
    return centroids.cluster_vectors(read(spark, sf_dir, "embeddings"))


SQL["op13_centroid_clusters"] = centroids.SQL


@query
def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return sitetree.main_text(read(spark, sf_dir, "pages"))
