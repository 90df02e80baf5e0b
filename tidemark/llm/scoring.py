"""What the classifiers share: a bounded labelled sample, one pass over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_bucket, in_batches, materialize

TRAIN_ROWS = 20_000
FLOATS = "array<float>"


def usable_labels(labels: DataFrame, label: str, modulus: int, held: int, id_col: str = "doc_id") -> DataFrame:
    """doc_id, y: labels of 0 or 1 outside the held-out bucket; of several, the largest."""
    return (
        labels.filter(F.col(label).isin(0, 1) & (id_bucket(F.col(id_col), modulus) != held))
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.max(label).alias("y"))
    )


def label_sample(
    labels: DataFrame, label: str, modulus: int, held: int, rows: int = TRAIN_ROWS, id_col: str = "doc_id"
) -> DataFrame:
    """At most ``rows`` (doc_id, y), those with the smallest hashes of their ids."""
    own = usable_labels(labels, label, modulus, held, id_col)
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled_texts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """text (bytes) and the sample's columns, in shared storage. Bounded by the sample but for repeated rows."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return materialize(slim.join(F.broadcast(sample), "doc_id"), "labelled")  # at most TRAIN_ROWS rows of a few numbers


def training_set(texts: DataFrame, of: Callable[[bytes], list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of labelled texts (doc_id, y, text), in the order of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["y"], pa.array(_vectors(of, b["text"]), pa.list_(pa.float32()))], ["doc_id", "y", "features"])

    met = texts.select("doc_id", "y", "text")
    kinds = [met.schema[c].dataType.simpleString() for c in ("doc_id", "y")]
    rows = in_batches(met, run, f"doc_id {kinds[0]}, y {kinds[1]}, features {FLOATS}")
    pdf = rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("features").alias("features")).toPandas().sort_values("doc_id")
    if not len(pdf):
        return np.zeros((0, 0)), np.zeros(0)
    return np.array(pdf["features"].tolist(), dtype=np.float64), pdf["y"].to_numpy(dtype=np.float64)


def _vectors(of: Callable[[bytes], list[float]], texts: pa.Array) -> list[list[float]]:
    return [of(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts]


def scores(of: Callable[[bytes], list[float]], score: Callable[[np.ndarray], np.ndarray], texts: pa.Array) -> np.ndarray:
    """The scores of texts in UTF-8 (null: empty). Features are floats of single precision, as in training."""
    if not len(texts):
        return np.zeros(0)
    return score(np.array(_vectors(of, texts), dtype=np.float32).astype(np.float64))


def apply(
    docs: DataFrame,
    of: Callable[[bytes], list[float]],
    score: Callable[[np.ndarray], np.ndarray],
    modulus: int,
    held: int,
    threshold: float,
    id_col: str,
    text_col: str,
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, in one pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(scores(of, score, b["text"]), pa.float64())], ["doc_id", "score"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return in_batches(slim, run, f"doc_id {kind}, score double").select(
        "doc_id",
        (id_bucket(F.col("doc_id"), modulus) == held).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
