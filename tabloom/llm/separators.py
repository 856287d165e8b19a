"""Token counts from flat token files without an index.

A flat file is one stream of token ids with an end-of-document id after every document, held in blocks that cut anywhere.
Each block is searched for separators in one array comparison; what a block cannot know, how much of its first document
lies in earlier blocks, comes from a prefix scan over one narrow row per block (block, then group of blocks, then file).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tabloom.llm.common import fitted

BLOCK_TOKENS = 1 << 18
GROUP = 1024  # blocks scanned by one window
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The vocabulary's word pattern and its first free id, which ends documents.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_DOCUMENT = 50256


def token_files(docs: DataFrame, vocabulary: str = TOKENIZER, end: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` tokenised into flat files of 16-bit ids, one per partition: file, block, data, doc_ids.

    ``doc_ids`` lists the documents that end in the block; the scan does not look at it. Null and empty texts are a lone
    separator. Ids may be of any type. The vocabulary file is read by the driver and sent along.
    """
    id_type, id_arrow = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        file, block, held, size, ids = TaskContext.get().partitionId(), 0, [], 0, []

        def emit(stream: np.ndarray, names: list) -> pa.RecordBatch:
            return pa.record_batch(
                {
                    "file": pa.array([file], pa.int64()),
                    "block": pa.array([block], pa.int64()),
                    "data": pa.array([stream.tobytes()], pa.binary()),
                    "doc_ids": pa.array([names], pa.list_(id_arrow)),
                }
            )

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                tokens = encoding.encode_ordinary(text.as_py() or "")
                tokens.append(end)
                held.append(np.array(tokens, np.uint16))
                size += len(tokens)
                if size >= block_tokens:
                    stream = np.concatenate(held)
                    for at in range(0, size - block_tokens + 1, block_tokens):
                        last = at + block_tokens == size  # the document just added ends exactly here
                        yield emit(stream[at : at + block_tokens], [*ids, *([doc_id.as_py()] if last else [])])
                        block, ids = block + 1, []
                    rest = stream[size - size % block_tokens :]
                    held, size = ([rest], len(rest)) if len(rest) else ([], 0)
                    if size:
                        ids.append(doc_id.as_py())
                else:
                    ids.append(doc_id.as_py())
        if size:
            yield emit(np.concatenate(held), ids)

    return docs.select("doc_id", "text").mapInArrow(run, f"file bigint, block bigint, data binary, doc_ids array<{id_type}>")


def read_flat_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, dtype: str = "uint16") -> DataFrame:
    """Flat token files from storage as blocks (file, block, data); ``file`` is the path. A file is at most 2 GB."""
    width = np.dtype(dtype).itemsize * block_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                data = content.as_py()
                for k, at in enumerate(range(0, len(data), width)):
                    yield pa.record_batch({"file": pa.array([name.as_py()]), "block": pa.array([k], pa.int64()), "data": pa.array([data[at : at + width]], pa.binary())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block bigint, data binary")


def scan(blocks: DataFrame, end: int = END_OF_DOCUMENT, dtype: str = "uint16", names: str | None = None) -> DataFrame:
    """One row per document: file, ordinal (from 0 within its file), n_tokens (without the separator), closed.

    ``names`` is an array column with one value per separator of the block, given back as ``name``. Tokens after a file's last
    separator are its last document, not ``closed``. Null or empty data is an empty block; a repeated (file, block) counts
    once; blocks are taken in order of ``block`` whatever is missing in between. No blocks give no rows.
    """
    file_type = blocks.schema["file"].dataType.simpleString()
    carried = [names] if names else []
    extra = f", {names} {blocks.schema[names].dataType.simpleString()}" if names else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, last, sizes = [], [], []
            for data in batch.column("data"):
                ids = np.frombuffer(data.as_py() or b"", dtype)
                at = np.flatnonzero(ids == end)
                size.append(len(ids))
                last.append(int(at[-1]) if len(at) else None)
                sizes.append(np.diff(at, prepend=-1) - 1)
            columns = {c: batch.column(c) for c in ("file", "block", *carried)}
            yield pa.record_batch(
                columns | {"size": pa.array(size, pa.int64()), "last": pa.array(last, pa.int64()), "lengths": pa.array(sizes, pa.list_(pa.int64()))}
            )

    found = blocks.select("file", "block", *carried, "data").mapInArrow(run, f"file {file_type}, block bigint{extra}, size bigint, last bigint, lengths array<bigint>")
    rows = fitted(found.dropDuplicates(["file", "block"]).withColumn("part", F.floor(F.col("block") / GROUP)), "blocks")
    start, docs = _before("size", "file", "part", "block"), _before("n", "file", "part", "block")
    inside = rows.select("file", "part", "block", "size", "last", F.size("lengths").alias("n")).withColumns({"start": start, "docs": docs})
    inside = inside.withColumn("cut", F.col("start") + F.col("last"))
    inside = inside.withColumn("cut_before", F.max("cut").over(W.partitionBy("file", "part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    parts = inside.groupBy("file", "part").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.max("cut").alias("cut"))
    parts = parts.withColumns({"part_start": _before("size", "file", order="part"), "part_docs": _before("n", "file", order="part")})
    parts = parts.withColumn(
        "part_cut", F.coalesce(F.max(F.col("part_start") + F.col("cut")).over(W.partitionBy("file").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    )
    placed = inside.select("file", "part", "block", "start", "docs", "cut_before").join(parts.select("file", "part", "part_start", "part_docs", "part_cut"), ["file", "part"])
    placed = placed.select(
        "file", "block", (F.col("part_docs") + F.col("docs")).alias("first"),
        (F.col("part_start") + F.col("start") - 1 - F.coalesce(F.col("part_start") + F.col("cut_before"), F.col("part_cut"))).alias("carry"),
    )
    each = rows.join(placed, ["file", "block"]).select(
        "file", "first", "carry",
        F.posexplode(F.arrays_zip("lengths", names) if names else F.arrays_zip("lengths")).alias("at", "doc"),
    )
    n_tokens = F.col("doc.lengths") + F.when(F.col("at") == 0, F.col("carry")).otherwise(0)
    named = [F.col(f"doc.{names}").alias("name")] if names else []
    closed = each.select("file", (F.col("first") + F.col("at")).alias("ordinal"), n_tokens.alias("n_tokens"), F.lit(True).alias("closed"), *named)
    total = parts.groupBy("file").agg(F.sum("size").alias("size"), F.sum("n").alias("ordinal"), F.max(F.col("part_start") + F.col("cut")).alias("cut"))
    open_ = total.withColumn("n_tokens", F.col("size") - 1 - F.coalesce("cut", F.lit(-1))).where("n_tokens > 0")
    name_type = blocks.schema[names].dataType.elementType if names else None
    rest = open_.select("file", "ordinal", "n_tokens", F.lit(False).alias("closed"), *([F.lit(None).cast(name_type).alias("name")] if names else []))
    return closed.unionByName(rest)


def _before(value: str, *keys: str, order: str | None = None):
    """Sum of ``value`` over the earlier rows; the last key orders unless ``order`` is given."""
    by, along = (keys, order) if order else (keys[:-1], keys[-1])
    return F.coalesce(F.sum(value).over(W.partitionBy(*by).orderBy(along).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def count_document_tokens(docs: DataFrame, vocabulary: str = TOKENIZER) -> DataFrame:
    """doc_id and n_tokens of every row of ``docs``, counted from flat token files made of it."""
    files = fitted(token_files(docs, vocabulary), "files")
    return scan(files, names="doc_ids").where("closed").select(F.col("name").alias("doc_id"), "n_tokens")
