"""Line dedup: repeated runs of lines are found by distributed prefix doubling.

Every line is a position; the suffixes of the line sequences of all documents are ranked by
prefixes of doubling length. A rank names its class of equal prefixes by the class's first
position, so rank(p) after the step of length h is the first position whose next h lines
equal those at p. A step pairs rank(p) with rank(p + h), groups the pairs (partial sums
before the shuffle, so a line of any frequency sends one row for each task) and joins the
first position back. Suffixes alone in their class are settled and leave; only lines that
recur go on, so the active set shrinks.

Ranks of length ``min_run`` are the intervals of the suffix array whose longest common
prefix is at least min_run (a length that isn't a power of two is met by two overlapping
prefixes). In an interval every position but the first begins a copy; the union of the
min_run lines from each such position is exactly the set of lines covered by maximal
repeated runs of min_run lines or more, except the first occurrence. Those are deleted.

Order of positions: doc_id (null last), then row, then line number. A run never crosses a
document. With ``long_words`` a single line of at least that many words that occurred before
is a run of its own, whatever stands around it; without it a run of fewer than min_run lines
stays, however long its lines. Empty lines count as lines. A null text has no line and stays null. A document
may lose all lines; its text is then empty. Repeated rows are documents of their own: the
later loses its lines. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, materialize, n_shuffle


def _first_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """Active positions with rank := first position of the class of equal keys.

    A class with more than its share of a task's rows is dealt out by salt, so a line of any
    frequency is spread over the join's tasks.
    """
    tasks = n_shuffle(df.sparkSession)
    classes = materialize(df.groupBy(*keys).agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1"), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = classes.filter(F.col("n") > total / (4 * tasks)).select(*keys, F.lit(True).alias("hot"))  # fewer than 4 * tasks rows
    salted = df.join(F.broadcast(hot), keys, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("pos"), F.lit(tasks)).cast("int")).otherwise(0))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(tasks - 1))).otherwise(F.array(F.lit(0)))
    dealt = classes.join(F.broadcast(hot), keys, "left").select(*keys, "first", F.explode(salts).alias("salt"))
    return salted.drop("hot").join(dealt, [*keys, "salt"]).drop("salt", *keys).withColumnRenamed("first", "rank")


def repeated_lines(
    docs: DataFrame, min_run: int = 2, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows with id, row number and lines; deleted positions as row, line)."""
    rows = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            F.split(F.col(text_col), "\n", -1).alias("lines"),
        ),
        "lines",
    )
    # Two 64-bit hashes and the length stand for a line.
    each = rows.select("doc_id", "row", F.posexplode("lines").alias("line", "s")).select(
        F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "row", "line").alias("pos"),
        F.xxhash64("s").alias("k1"),
        F.xxhash64(F.lit(1), F.reverse("s"), F.length("s")).alias("k2"),
        *([] if long_words is None else [(F.regexp_count("s", F.lit(WORD)) >= long_words).alias("long")]),
    )
    active = materialize(_first_of(each, ["k1", "k2"]), "ranks")
    alone = None
    if long_words is not None:
        alone = active.filter("long and pos != rank").select(F.col("pos.row").alias("row"), F.col("pos.line").alias("line"))
        active = active.drop("long")
    h = 1
    while h < min_run:
        step = min(h, min_run - h)
        by_row = Window.partitionBy("pos.row").orderBy("pos.line")
        # The active positions of a row are not contiguous: look ahead by line number.
        ahead = F.collect_list(F.struct("pos.line", "rank")).over(by_row.rangeBetween(step, step))
        paired = active.withColumn("next", F.get(ahead, F.lit(0))["rank"]).filter("next is not null")
        active = materialize(_first_of(paired.withColumnRenamed("rank", "head"), ["head", "next"]), "ranks")
        h += step
    copies = active.filter("pos != rank")
    gone = copies.select(
        F.col("pos.row").alias("row"), F.explode(F.sequence(F.col("pos.line"), F.col("pos.line") + F.lit(min_run - 1))).alias("line")
    )
    return rows, (gone if alone is None else gone.unionByName(alone)).distinct()


def dedup_lines(
    docs: DataFrame, min_run: int = 2, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = None
) -> DataFrame:
    """doc_id, n_lines, n_deleted, text (what stays) for every row of docs."""
    rows, gone = repeated_lines(docs, min_run, id_col, text_col, long_words)
    per = gone.groupBy("row").agg(F.collect_set("line").alias("gone"))
    both = rows.join(per, "row", "left")
    numbers = F.sequence(F.lit(0), F.size("lines") - 1)
    left = F.transform(F.array_except(numbers, F.col("gone")), lambda i: F.get("lines", i))
    stays = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(left)
    return both.select(
        "doc_id",
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"),
        F.array_join(stays, "\n").alias("text"),
    )
