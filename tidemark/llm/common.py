"""Shared helpers of the training-data operators: shared storage, row preparation."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
#: Bytes of an Arrow batch where rows may be long.
BATCH_BYTES = 16_000_000
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).

    Only where that setting is unset in local mode (one machine) a folder is made and
    set for the session. On a cluster it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder; one sub-folder for each application."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/tidemark-{app}/{tag}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once the results that read them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts lineage and survives lost executors, and the reread table keeps
    column pruning and row-group statistics.
    """
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, with the worker's memory given back to the system as soon as it is free."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return lean


def in_batches(df: DataFrame, run, schema, rows: int = 1_000, size: int | None = None) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of at most ``rows`` rows and, if given, about ``size`` bytes, with ``run`` released.

    Rows hold whole texts, so Spark's 10,000 of them may not fit a worker, and a thousand long ones
    don't either. The session's settings are lowered for good: Spark reads them when the plan runs.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.max{}PerBatch"
    for key, most in ((name.format("Records"), rows), (name.format("Bytes"), size)):
        if most and not 0 < int(conf.get(key).rstrip("bB")) <= most:
            conf.set(key, str(most))
    return df.mapInArrow(released(run), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has at most ``rows`` rows, else as it is.

    For materialized frames of narrow rows (ids, digests, a few numbers): 200,000 of them
    take about 20 MB. Beyond that the join is a shuffle join, whose hot keys AQE splits.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
