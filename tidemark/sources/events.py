"""Event sources and sinks: CSV folders, unions, week-partitioned Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import bin_start
from tidemark.schema import EVENT_CSV, RAW


def hadoop_fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_fs(spark, path)
    return fs.exists(p)


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right under path, sorted; none if it doesn't exist."""
    fs, p = hadoop_fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def frame_name(file: str) -> str:
    return file.rsplit("/", 1)[-1].lower().replace("-", "_").replace(".csv", "")


def load_csv_folder(spark: SparkSession, path: str, schema=EVENT_CSV) -> dict[str, DataFrame]:
    """A frame for each CSV file; the schema is stated, so no pass infers it."""
    fs, p = hadoop_fs(spark, path)
    files = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isFile() and s.getPath().getName().lower().endswith(".csv"))
    return {frame_name(f): spark.read.option("header", True).schema(schema).csv(f) for f in files}


def union_by_name(frames: dict[str, DataFrame]) -> DataFrame:
    """All rows, tagged with source_file; columns missing in some are null there."""
    tagged = [df.withColumn("source_file", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def save_frames(frames: dict[str, DataFrame], folder: str) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def save_union(frames: dict[str, DataFrame], folder: str) -> int:
    """Write the union and return its row count, counted while it is written."""
    from pyspark.sql import Observation

    seen = Observation("union")
    union_by_name(frames).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(folder)
    return seen.get["rows"]


def write_weeks(df: DataFrame, path: str, anchor: str, column: str = "event_time") -> None:
    """One write, a folder for each week; only the weeks in df are replaced. Failures raise.

    Rows go by week and a hash of as many values as a quarter of the shuffle partitions, so a week
    of any size is spread and AQE joins small pieces.
    """
    weekly = df.withColumn("week_start", bin_start(column, anchor))
    spread = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    weekly.repartition("week_start", F.pmod(F.xxhash64(*df.columns), F.lit(spread))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("week_start").parquet(path)


def written_weeks(spark: SparkSession, path: str) -> DataFrame:
    """week_start of the weeks that have a folder, from the listing; no row is read."""
    names = [n.split("=", 1)[1] for n in list_folders(spark, path) if n.startswith("week_start=")]
    return spark.createDataFrame([(n,) for n in names], "week_start string").select(F.col("week_start").cast("date"))


def write_missing_weeks(df: DataFrame, path: str, anchor: str, column: str = "event_time") -> None:
    """Write only the weeks of df that have no folder yet; those that are there stay untouched."""
    weekly = df.withColumn("__week", bin_start(column, anchor))
    there = written_weeks(df.sparkSession, path).withColumnRenamed("week_start", "__week")
    write_weeks(weekly.join(F.broadcast(there), "__week", "left_anti").drop("__week"), path, anchor, column)


def read_weeks(spark: SparkSession, path: str, weeks: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if weeks is None else df.filter(F.col("week_start").cast("string").isin(weeks))


def missing_weeks(spark: SparkSession, weeks: DataFrame, present: DataFrame) -> DataFrame:
    """Weeks (week_start) that have no rows yet."""
    return weeks.join(present.select("week_start").distinct(), "week_start", "left_anti")


def copy_into(spark: SparkSession, source: str, target: str, week: str | None = None, anchor: str = "2024-01-01", skip_corrupt: bool = False) -> None:
    """Load Parquet files by column name into the raw table.

    Without a week the table is replaced. With one, that week's partition is replaced, so a
    retry never appends twice. An unreadable file is an error, unless skip_corrupt says to go on
    without it.
    """
    df = spark.read.option("ignoreCorruptFiles", skip_corrupt).schema(RAW).parquet(source)
    if week is not None:
        df = df.filter(bin_start("event_time", anchor) == F.lit(week).cast("date"))
    write_weeks(df, target, anchor)
