"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, repeated up to
``max_repeats`` times. A copy's virtual finish time is the number of the source's words
up to and including it, divided by the source's target. All copies are range-sorted by
finish time and served until the total budget is used up. As the targets add up to the
budget, every source is served close to its target.

Targets: sources in code point order, null last, weigh ``weights`` in turn. They share
the budget by weight; a target above ``max_repeats`` times its source's size is set to
that, and the excess is shared again by weight among the others until none is above. That
fixed point is found directly: with sources sorted by cap / weight, the first k are
capped, and k follows from running sums.

Both running sums over documents are distributed: rows are range-partitioned, each
partition is summed, the few partition totals (one row for each partition and source) give
the offsets. No source is gathered in one task.

Defined cases: a null text has size 0. Documents of size 0 take 0 words. A source of
size 0 has target 0. Repeated rows are separate documents. The shuffled order depends
only on the doc_id, so reruns agree; rows with equal doc_id are ordered by size. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, materialize, n_shuffle, sized


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (number of words) for each row, in shared storage."""
    return materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "sizes",
    )


def targets(rows: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """source, source_size, target. One row per source; windows run over sources only."""
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").isNull(), "source")
    w = F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))))
    capped = by.withColumns({"weight": w.cast("long"), "cap": F.col("source_size") * max_repeats})
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source")
    run = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    # The level if all sources before this one are capped; the first source that this
    # level leaves below its cap fixes the level of all that follow.
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(run), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(run), F.lit(0))
    )
    leveled = capped.withColumn("level", level).withColumn(
        "free", F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))
    )
    fixed = leveled.withColumn(
        "at", F.first("free", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    target = F.when(F.col("at").isNull(), F.col("cap").cast("double")).otherwise(F.col("at") * F.col("weight"))
    return materialize(fixed.select("source", "source_size", target.alias("target")), "targets")


def running_sum(df: DataFrame, order: list[str], value: str, group: list[str], out: str) -> DataFrame:
    """df plus ``out``: sum of ``value`` up to this row within ``group``, by ``order``.

    order must begin with group. Rows are range-partitioned by order, so a group of any
    size is spread over tasks.
    """
    spark = df.sparkSession
    n = max(2, n_shuffle(spark))
    ranged = materialize(
        df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranged"
    )
    w = Window.partitionBy("__part", *group)
    totals = ranged.groupBy("__part", *group).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        totals.select("__part", *group, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before")), "offsets"
    )
    local = F.sum(value).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    summed = ranged.withColumn(out, local).alias("l")
    on = F.col("l.__part") == F.col("o.__part")
    for g in group:
        on = on & F.col(f"l.{g}").eqNullSafe(F.col(f"o.{g}"))
    joined = summed.join(sized(offsets).alias("o"), on, "left")
    return joined.select(*[f"l.{c}" for c in df.columns], (F.col(f"l.{out}") + F.col("o.__before")).alias(out))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    max_repeats: int = 3,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies for every row of docs.

    copies is the number of times the whole document is served, taken = copies * size.
    """
    rows = sizes(docs, id_col, text_col, source_col)
    goal = targets(rows, weights, max_repeats)
    keyed = rows.withColumns(
        {"key": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), "no_source": F.col("source").isNull()}
    )
    order = ["no_source", "source", "key", "doc_id", "size"]
    served = running_sum(keyed, order, "size", ["no_source", "source"], "upto").withColumn(
        "row", F.monotonically_increasing_id()
    )
    served = materialize(served, "queue").alias("q")
    full = served.join(
        sized(goal).alias("g"), F.col("q.source").eqNullSafe(F.col("g.source")), "inner"
    ).select("q.*", "g.source_size", "g.target")
    copies = full.filter("size > 0").select(
        "row", "key", "size", "source_size", "target", "upto",
        F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("pass"),
    )
    timed = copies.select(
        ((F.col("pass") * F.col("source_size") + F.col("upto")) / F.col("target")).alias("finish"),
        "key", "row", "size",
    )
    line = running_sum(timed, ["finish", "key", "row"], "size", [], "total")
    budget = goal.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("budget"))
    kept = line.join(F.broadcast(budget), F.col("total") <= F.col("budget"), "inner")
    counts = materialize(kept.groupBy("row").agg(F.count("*").alias("copies")), "served")
    return full.join(counts, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * F.coalesce("copies", F.lit(0))).cast("long").alias("taken"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
    )
