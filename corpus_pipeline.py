"""A corpus pipeline over the training-data operators.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and reread as the next stage's docs. All stages but
the last return the columns of documents. Each handles nulls, empty texts, repeated rows and
empty tables as its operator's docstring states.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, mixing, near_dedup, quality
from tidemark.llm.common import materialize, sized, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more) stays."""
    return near_dedup.drop_near_copies(docs, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix serves, as often as it serves them (up to three equal rows).

    Rows repeated under one doc_id get the largest number of copies of any of them.
    """
    served = mixing.mix(docs).filter("copies > 0").groupBy("doc_id").agg(F.max("copies").cast("int").alias("copies"))
    found = docs.alias("d").join(sized(materialize(served, "served-documents")).alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")))
    each = F.explode(F.array_repeat(F.struct("d.*"), F.col("m.copies"))).alias("doc")
    return found.select(each).select("doc.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN)
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), spark, path), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("tokenize", tokenize),
]

#: SQL can't express the classifier or the MinHash stage; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
