"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Declared table schemas, so that a scan starts without a job that reads footers.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
}


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; only ``columns`` are read from disk."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    frame = reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV scan with a declared schema; a table without a single row is an error."""
    frame = spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST")
    if frame.isEmpty():
        raise ValueError(f"{path} holds no rows")
    return frame


def typed_scan(
    frame: DataFrame, features: list[str], label: str | None = None, categorical: list[str] = ()
) -> DataFrame:
    """Wanted columns only: numbers as float, label as tinyint, categories as text."""
    columns = [
        F.col(c).cast("string").alias(c) if c in categorical else F.col(c).cast("float").alias(c) for c in features
    ]
    if label is not None:
        columns.append(F.col(label).cast("tinyint").alias(label))
    return frame.select(*columns)


def first_rows(frame: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest key; file order means nothing in Spark."""
    return frame.orderBy(key).limit(n)


def union_splits(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """All splits as one table tagged with ``split``.

    A column name used twice inside one split is an error, as is a split without
    the key column; columns absent from a split (the label of rows to score) become null.
    """
    merged = None
    for name, frame in frames.items():
        repeated = {c for c in frame.columns if frame.columns.count(c) > 1}
        if repeated:
            raise ValueError(f"split {name} has repeated columns: {sorted(repeated)}")
        if key not in frame.columns:
            raise ValueError(f"split {name} has no column {key}")
        tagged = frame.withColumn("split", F.lit(name))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    return merged


def scoring_rows(frame: DataFrame, required: list[str], split: str = "score") -> DataFrame:
    """Rows to score; on a table partitioned by ``split`` only that partition is read."""
    missing = [c for c in required if c not in frame.columns]
    if missing:
        raise ValueError(f"rows to score lack columns {missing}")
    return frame.where(F.col("split") == split).select(*required)
