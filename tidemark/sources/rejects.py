"""Loading that goes on past bad rows and files, and says which.

CSV: a line that doesn't fit the schema is kept as text with its file. Parquet: a file that can't be
read is skipped, one that breaks off gives the rows before the break; the report holds each file's rows
by its footer (counted without reading a column) against those that were loaded. A file without rows,
which a writer's empty task may leave, is loaded if its footer can be read.
"""

from __future__ import annotations

import re
from multiprocessing.pool import ThreadPool

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tidemark.schema import EVENT_CSV, RAW
from tidemark.session import written
from tidemark.sources.events import hadoop_fs

LOADED, PARTLY, FAILED = "LOADED", "PARTIALLY_LOADED", "LOAD_FAILED"
RECORD = "_record"
FOOTERS = 8  # read at once


def _files(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """file, size of the data files under path, found by the driver's listing."""
    fs, p = hadoop_fs(spark, path)
    found, at = [], fs.listFiles(p, True)
    while at.hasNext():
        s = at.next()
        name = s.getPath().getName()
        if name.endswith(ending) and not name.startswith(("_", ".")):
            found.append((s.getPath().toString(), s.getLen()))
    return spark.createDataFrame(found, "file string, size long")


def _uri(c: str):
    """Paths as the listing writes them: one slash behind the scheme where there is no host."""
    return F.regexp_replace(c, "^file:/+", "file:/")


def _readable(spark: SparkSession, file: str) -> bool:
    """Whether the footer of a Parquet file can be read."""
    try:
        spark.read.option("ignoreCorruptFiles", True).parquet(re.sub(r"([\\{}\[\]*?])", r"\\\1", file))
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return False
    return True


def read_csv(spark: SparkSession, path: str, schema: StructType = EVENT_CSV) -> tuple[DataFrame, DataFrame]:
    """(rows with their file, rejected lines as file and record): one pass, written once."""
    wide = StructType([*schema.fields]).add(RECORD, StringType())
    reader = spark.read.schema(wide).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD)
    raw = written(reader.option("recursiveFileLookup", True).csv(path).select("*", F.col("_metadata.file_path").alias("file")), "csv")
    return raw.filter(F.col(RECORD).isNull()).drop(RECORD), raw.filter(F.col(RECORD).isNotNull()).select("file", F.col(RECORD).alias("record"))


def read_parquet(spark: SparkSession, path: str, schema: StructType = RAW) -> DataFrame:
    """The rows that can be read, with their file."""
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True)
    return reader.parquet(path).select("*", F.col("_metadata.file_path").alias("file"))


def csv_report(spark: SparkSession, path: str, rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """file, status, rows_loaded, rows_rejected, first_error (the first rejected line) of every file."""
    good = rows.groupBy("file").agg(F.count("*").alias("rows_loaded"))
    bad = rejected.groupBy("file").agg(F.count("*").alias("rows_rejected"), F.min("record").alias("first_error"))
    both = good.join(bad, "file", "full").withColumn("file", _uri("file"))
    listed = _files(spark, path, ".csv").withColumn("file", _uri("file")).join(both, "file", "left")
    n = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("rows_loaded", "rows_rejected")}
    status = F.when(n["rows_rejected"] == 0, LOADED).when(n["rows_loaded"] == 0, FAILED).otherwise(PARTLY)
    return listed.select("file", status.alias("status"), *n.values(), "first_error")


def parquet_report(spark: SparkSession, path: str, rows: DataFrame, schema: StructType = RAW) -> DataFrame:
    """file, status, rows_loaded, rows_rejected (by the footer; null if that can't be read) of every file.

    Only for the files that gave no row, footers are read one by one, to tell empty files from broken ones. rows: what was loaded, as a written table with ``file``, so that the report is about the rows that were kept.
    """
    expected = read_parquet(spark, path, schema).groupBy("file").agg(F.count("*").alias("expected"))
    loaded = rows.groupBy("file").agg(F.count("*").alias("rows_loaded"))
    both = expected.join(loaded, "file", "full").withColumn("file", _uri("file"))
    listed = _files(spark, path, ".parquet").withColumn("file", _uri("file")).join(both, "file", "left")
    bare = [r.file for r in listed.filter("expected is null").select("file").collect()]
    with ThreadPool(FOOTERS) as pool:
        empty = [f for f, fine in zip(bare, pool.map(lambda f: _readable(spark, f), bare), strict=True) if fine]
    kept = F.coalesce("rows_loaded", F.lit(0))
    if empty:
        rowless = spark.createDataFrame([(f, 0) for f in empty], "file string, none long")
        listed = listed.join(rowless, "file", "left").withColumn("expected", F.coalesce("expected", "none"))
    status = F.when(F.col("expected").isNull(), FAILED).when(kept < F.col("expected"), PARTLY).otherwise(LOADED)
    return listed.select("file", status.alias("status"), kept.alias("rows_loaded"), (F.col("expected") - kept).alias("rows_rejected"))
