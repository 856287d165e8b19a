"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, app: str = "tabloom") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


@lru_cache(maxsize=1)
def _local_fallback() -> str:
    return tempfile.mkdtemp(prefix="tabloom-")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster that
    folder would be lost together with its executor.
    """
    context = spark.sparkContext
    configured = (
        spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    )
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the whole cluster")
        configured = _local_fallback()
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tune(spark: SparkSession) -> None:
    """Runtime settings the library relies on for speed, never for results.

    HotSpot does not compile methods above 8000 bytes; beyond that Spark should use
    its split per-expression code instead of one interpreted whole-stage method.
    Rows that hold whole chunks reach the Python workers a few at a time, so that a
    worker holds no more of them on larger tables.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def spare_driver(spark: SparkSession) -> None:
    """Runtime settings that bound what many long plans leave on the driver, never for results.

    Spark's SQL parser keeps the states of every text it has parsed, over 60 MB after the corpus pipeline, and each adaptive step of a
    plan its whole description; the states go now and then, descriptions are cut.
    """
    spark.conf.set("spark.sql.parser.manageParserCaches", "true")
    spark.conf.set("spark.sql.parser.parserDfaCacheFlushThreshold", "2000")
    spark.conf.set("spark.sql.maxPlanStringLength", "20000")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the library's source to the Python workers, once per application, so that they need no installed copy.

    The archive is served by the driver; executors fetch it like any other file of the job.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="tabloom-code-")) / "tabloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent).as_posix())
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
