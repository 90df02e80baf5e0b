"""Exact dedup by tree-merging sorted digest runs.

1. Every input partition hashes its normalised texts and folds them into one sorted
   run: a row for each distinct text with its smallest row and its count.
2. Runs meet in rounds. In a round ``fan_in`` runs flow into one parent; within the
   parent the digest decides the task, so a merge is spread over the whole cluster, and
   a text of any frequency arrives there as at most ``fan_in`` rows. The merge streams
   over rows in digest order and keeps the smallest row of each text.
3. The last run, cut down to texts with several copies, is joined to the documents.

Two rows are merged only if SHA-256, byte length and a 64-bit second hash all agree.

Defined cases: a null text counts as empty; empty texts are equal to each other. A null
doc_id sorts after all others, so a row without id stays only if all its copies have
none. Rows repeated with the same doc_id are copies: exactly one row of a group has
kept = true. An empty table gives an empty result. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, in_batches, materialize, n_shuffle, sized

KEY = ["sha", "n_bytes", "probe"]
ORDER = [*KEY, "no_id", "doc_id", "row"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge rows sorted by (node, key, id): first row of a key, counts added up."""
    carry: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if carry is not None:
            t = pa.concat_tables([carry, t]).combine_chunks()
        if not t.num_rows:
            continue
        new = np.ones(t.num_rows, dtype=bool)
        if t.num_rows > 1:
            same = None
            for c in ["node", *KEY]:
                eq = pc.equal(t[c].slice(1), t[c].slice(0, t.num_rows - 1))
                same = eq if same is None else pc.and_(same, eq)
            new[1:] = ~np.asarray(same.combine_chunks().to_numpy(zero_copy_only=False), dtype=bool)
        first = np.flatnonzero(new)
        total = np.add.reduceat(t["n"].to_numpy(), first)
        t = t.take(pa.array(first))
        at = t.schema.get_field_index("n")
        t = t.set_column(at, t.schema.field(at), pa.array(total, pa.int64()))
        carry = t.slice(t.num_rows - 1)
        yield from t.slice(0, t.num_rows - 1).to_batches()
    if carry is not None:
        yield from carry.to_batches()


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row per document: id, row number, digests; written to shared storage."""
    slim = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    return materialize(
        slim.select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            F.unhex(F.sha2("t", 256)).alias("sha"),
            F.octet_length("t").cast("long").alias("n_bytes"),
            F.xxhash64("t").alias("probe"),
        ),
        "digests",
    )


def merged_runs(rows: DataFrame, fan_in: int = 8) -> DataFrame:
    """The last run: a row for each distinct text with its smallest row and its count."""
    spark = rows.sparkSession
    cols = ["node", *ORDER, "n"]
    runs = (
        rows.withColumns({"node": F.spark_partition_id(), "no_id": F.col("doc_id").isNull(), "n": F.lit(1).cast("long")})
        .select(*cols)
        .sortWithinPartitions("node", *ORDER)
    )
    left = max(1, rows.rdd.getNumPartitions())
    runs = in_batches(runs, _merge, runs.schema, 10_000)
    while left > 1:
        left = -(-left // fan_in)
        met = (
            runs.withColumn("node", (F.col("node") / fan_in).cast("int"))
            .repartition(n_shuffle(spark), "node", "sha")
            .sortWithinPartitions("node", *ORDER)
        )
        runs = in_batches(met, _merge, met.schema, 10_000)
    return runs


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """doc_id, row, keep_id, group_size, kept, text_sha256 for every row of docs."""
    rows = digest_rows(docs, id_col, text_col)
    many = merged_runs(rows, fan_in).filter("n > 1").select(
        *KEY, F.col("doc_id").alias("first_id"), F.col("row").alias("first_row"), "n"
    )
    return rows.join(many, KEY, "left").select(
        "doc_id",
        "row",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (F.coalesce("first_row", "row") == F.col("row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without later copies, all columns kept.

    Rows are found again by (id, digest). Rows repeated under one id and text are
    reduced to one. Documents with a text of their own meet no shuffle unless the table
    of dropped rows is too large to broadcast.
    """
    pairs = (
        exact_groups(docs, id_col, text_col)
        .filter("group_size > 1")
        .groupBy("doc_id", "text_sha256")
        .agg(F.count("*").alias("__n"), F.max("kept").alias("__stays"))
        .filter("not __stays or __n > 1")
    )
    marks = materialize(pairs.withColumnsRenamed({"doc_id": "__id", "text_sha256": "__sha"}), "copies")
    id_, text = F.col(f"d.{id_col}"), F.col(f"d.{text_col}")
    same = F.col("m.__id").eqNullSafe(id_) & (F.sha2(normalised(text), 256) == F.col("m.__sha"))
    found = docs.alias("d").join(sized(marks).alias("m"), same, "left")
    own = found.filter("m.__sha is null").select("d.*")
    # One of each set of equal rows: whole documents as a struct, so no column name clashes.
    repeated = found.filter("m.__stays").select(F.struct("d.*").alias("doc"), F.col("m.__id").alias("i"), F.col("m.__sha").alias("h"))
    return own.unionByName(repeated.dropDuplicates(["i", "h"]).select("doc.*"))
