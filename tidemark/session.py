"""Sessions: UTC, adaptive execution, no credentials in code."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidemark", conf: dict[str, str] | None = None) -> SparkSession:
    """A session pinned to UTC. Storage credentials come from the cluster's own settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    return SparkSession.builder.appName(app).config(map=settings | (conf or {})).getOrCreate()


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir). Where that is unset, a folder
    of this machine, which is right in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"tidemark-{os.getpid()}")
    return f"{root.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is ``written`` within goes at the end; for work whose results stand elsewhere by then."""
    mine: list[str] = []
    _scopes.append(mine)
    try:
        yield
    finally:
        _scopes.remove(mine)
        for path in mine:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, and lost executors cost nothing."""
    path = shared_path(df.sparkSession, tag)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
