"""MERGE as DataFrame algebra, and tables of appended folders under one mark for each load.

``merge`` brings target and source together once: a tagged union, one window over the key. It gives
every row of the result with its action, fails in the same pass if a source key stands for several
rows where that isn't allowed, and counts the actions while the result is read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.events import hadoop_fs, list_folders, path_exists

KEPT, UPDATED, INSERTED = "kept", "updated", "inserted"


def merge(
    target: DataFrame, source: DataFrame, keys: Sequence[str], update: bool, null_safe: bool = False, several: bool = False, counts: Observation | None = None
) -> DataFrame:
    """The merged rows and their ``action``.

    With ``update`` a source row replaces the target rows of its key, else those stay and the source
    row is left out. Source rows of other keys are inserted. Null keys never match unless
    ``null_safe``. A source with several rows for a key is an error at run time, unless ``several``: then each is inserted (an update can't choose among them and fails).
    counts: an Observation that gets kept, updated and inserted.
    """
    names = target.columns
    both = target.withColumn("__new", F.lit(False)).unionByName(source.select(*names).withColumn("__new", F.lit(True)))
    known = F.lit(True) if null_safe else reduce(and_, [F.col(k).isNotNull() for k in keys])
    both = both.withColumn("__lone", F.when(~known, F.xxhash64(*names)))  # deals rows that match nothing all over
    by = Window.partitionBy(*keys, "__lone")
    tagged = both.withColumns({"__old": F.count_if(~F.col("__new")).over(by), "__news": F.count_if(F.col("__new")).over(by)})
    if update or not several:
        error = F.raise_error(F.concat(F.lit(f"the source has several rows for one key of {list(keys)}: "), F.to_json(F.struct(*keys))))
        tagged = tagged.withColumn("__old", F.when(known & (F.col("__news") > 1), error.cast("long")).otherwise(F.col("__old")))
    action = F.when(F.col("__new") & (~known | (F.col("__old") == 0)), INSERTED)
    if update:
        action = action.when(F.col("__new"), UPDATED).when(~known | (F.col("__news") == 0), KEPT)
    else:
        action = action.when(~F.col("__new"), KEPT)
    out = tagged.withColumn("action", action).filter("action is not null").select(*names, "action")
    if counts is None:
        return out
    return out.observe(counts, *[F.count_if(F.col("action") == a).alias(a) for a in (KEPT, UPDATED, INSERTED)])


def insert_only(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target and those source rows whose key it doesn't have."""
    return merge(target, source, keys, update=False, several=True).drop("action")


def new_rows(target: DataFrame, source: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """The source rows whose key the target doesn't have, in the target's columns; of the target only keys move."""
    if not null_safe:
        return source.join(target.select(*keys), list(keys), "left_anti").select(*target.columns)
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    return source.alias("n").join(target.select(*keys).alias("o"), reduce(and_, same), "left_anti").select(*target.columns)


def update_insert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows replace the target rows of their key; others are added. Fails if a source key has several rows."""
    return merge(target, source, keys, update=True).drop("action")


def replace_groups(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A key's source rows, however many, replace all its target rows."""
    kept = target.join(source.select(*keys), list(keys), "left_anti")
    return kept.unionByName(source.select(*target.columns))


def replace_row(target: DataFrame, source: DataFrame) -> DataFrame:
    """MERGE on a condition that always holds, for tables of one row: the source's row, if it has one."""
    one = lambda df: df.withColumn("__one", F.lit(1))
    return merge(one(target), one(source), ["__one"], update=True).drop("action", "__one")


def unique(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """source, or an error at run time if a key has several rows."""
    twice = source.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    if twice:
        raise ValueError(f"the source has several rows for one key of {list(keys)}")
    return source


# tables -----------------------------------------------------------------------------------

LOADS = "_loads"


class Load:
    """Folders of several tables that count once ``commit`` has set the load's mark, and never before.

    The number of a load is taken by a file of its own, so what a broken load left is never taken for
    part of a later one. One load runs at a time.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        fs, p = hadoop_fs(spark, f"{root}/{LOADS}")
        known = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        self.spark, self.root = spark, root
        self.number = max([int(n[:10]) for n in known], default=0) + 1
        self._mark("begun")

    def _mark(self, kind: str) -> None:
        fs, p = hadoop_fs(self.spark, f"{self.root}/{LOADS}/{self.number:010d}-{kind}")
        fs.create(p, False).close()

    def publish(self, df: DataFrame, name: str) -> str:
        return _write(df, self.root, name, "full", self.number)

    def append(self, df: DataFrame, name: str) -> str:
        return _write(df, self.root, name, "add", self.number)

    def replace(self, rows: DataFrame, name: str, unit: Sequence[str]) -> str:
        """Append the newest version of some units (groups of rows by the unit columns); rows with
        ``__gone`` say that a unit has no rows any more."""
        gone = rows if "__gone" in rows.columns else rows.withColumn("__gone", F.lit(False))
        return self.append(gone.withColumns({"__unit": F.struct(*unit), "__version": F.lit(self.number)}), name)

    def spread(self, df: DataFrame, name: str, partition: str) -> None:
        """Append rows to a table in folders by a column and the load, see ``spread_table``."""
        df.withColumn("load", F.lit(self.number)).write.partitionBy(partition, "load").mode("append").parquet(f"{self.root}/{name}")

    def commit(self) -> None:
        self._mark("done")


def _marks(spark: SparkSession, root: str) -> dict[str, set[int]]:
    """Numbers of the loads that have begun, and of those that are done."""
    fs, p = hadoop_fs(spark, f"{root}/{LOADS}")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return {kind: {int(n[:10]) for n in names if n.endswith(kind)} for kind in ("begun", "done")}


def spread_table(spark: SparkSession, root: str, name: str, schema: str, load: Load | None = None) -> DataFrame | None:
    """A table of folders by a column and the load, without the rows of loads that broke off.

    schema: the table's columns, the folder column among them. Both columns are partitions, so a filter
    on them leaves files unread.
    """
    path = f"{root}/{name}"
    if not path_exists(spark, path):
        return None
    marks = _marks(spark, root)
    broken = marks["begun"] - marks["done"] - ({load.number} if load else set())
    df = spark.read.schema(f"{schema}, load int").parquet(path)
    return (df.filter(~F.col("load").isin(sorted(broken))) if broken else df).drop("load")


def _folders(spark: SparkSession, root: str, name: str, load: Load | None = None) -> list[tuple[int, str, bool]]:
    """(number, folder, complete) of a table's folders, oldest first; a load's own folders are complete to itself."""
    found = [n for n in list_folders(spark, f"{root}/{name}") if n[:10].isdigit()]
    done = _marks(spark, root)["done"] | ({load.number} if load else set())
    counts = lambda n: len(n.split("-")) < 3 or int(n.split("-")[2]) in done
    return [(int(n[:10]), n, counts(n) and path_exists(spark, f"{root}/{name}/{n}/_SUCCESS")) for n in found]


def _write(df: DataFrame, root: str, name: str, kind: str, load: int | None = None) -> str:
    number = max([n for n, *_ in _folders(df.sparkSession, root, name)], default=0) + 1
    path = f"{root}/{name}/{number:010d}-{kind}" + (f"-{load:010d}" if load is not None else "")
    df.write.parquet(path)
    return path


def publish(df: DataFrame, root: str, name: str) -> str:
    """Write a new full version of a table in a folder of its own; readers keep the old one.

    Spark puts _SUCCESS into a folder in the last step of a write, and only folders with it
    count. So there is no pointer that could be missing: before that step the old version is
    the newest, after it the new one. A table has one writer at a time.
    """
    return _write(df, root, name, "full")


def append(df: DataFrame, root: str, name: str) -> str:
    """Add rows to a table: only these are written, the files that are there stay as they are."""
    return _write(df, root, name, "add")


def paths(spark: SparkSession, root: str, name: str, load: Load | None = None) -> list[str]:
    """The newest complete full version and all complete additions after it."""
    done = [n for _, n, complete in _folders(spark, root, name, load) if complete]
    last = max([i for i, n in enumerate(done) if "-full" in n], default=0)
    return [f"{root}/{name}/{n}" for n in done[last:]]


def current(spark: SparkSession, root: str, name: str, load: Load | None = None) -> DataFrame | None:
    """The table as it stands; of units in several versions (``Load.replace``) the newest."""
    found = paths(spark, root, name, load)
    df = spark.read.parquet(*found) if found else None
    return df if df is None or "__version" not in df.columns else newest(df).filter(~F.col("__gone")).drop("__unit", "__version", "__gone")


def newest(df: DataFrame) -> DataFrame:
    """The newest version of each unit."""
    last = df.groupBy("__unit").agg(F.max("__version").alias("__last"))
    same = F.col("r.__unit").eqNullSafe(F.col("l.__unit")) & (F.col("r.__version") == F.col("l.__last"))
    return df.alias("r").join(last.alias("l"), same, "left_semi")


def prune(spark: SparkSession, root: str, name: str) -> list[str]:
    """Delete what came before the newest full version; for when no reader is at it."""
    keep = {p.rsplit("/", 1)[-1] for p in paths(spark, root, name)}
    old = [n for _, n, _ in _folders(spark, root, name) if keep and n < min(keep)]
    for n in old:
        fs, p = hadoop_fs(spark, f"{root}/{name}/{n}")
        fs.delete(p, True)
    return old
