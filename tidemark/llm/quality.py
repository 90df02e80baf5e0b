"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from one pass over each whole text: byte-class shares, word and line
shapes, repetition. A model is fitted on at most ``train_rows`` labelled documents (those
with the smallest id hashes) outside the held-out bucket, then walks all documents.

Defined cases: a null or empty text has all statistics 0 and gets the score the model
gives those. Without any labels every score is 0.5. Repeated rows get equal scores, null
ids keep theirs. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import gbt
from tidemark.llm.common import in_batches
from tidemark.llm.scoring import TRAIN_ROWS, apply, label_sample, labelled_texts, scores, training_set

MODULUS, HELD, THRESHOLD = 3, 1, 0.5


def _classes() -> np.ndarray:
    """256 x classes: which byte counts in which class."""
    groups = [
        range(65, 91), range(97, 123), range(48, 58), range(128, 256), b" ", b"\n", b".", b",", b"!", b"?", b"|", b"#*$%&@~^=+_",
        b"<>{}[]\\/;", b"-", b"'\"", b":", b"()",
    ]
    m = np.zeros((256, len(groups)))
    for j, g in enumerate(groups):
        m[list(g), j] = 1
    return m


CLASSES = _classes()


def statistics(data: bytes) -> list[float]:
    """The statistics of one text in UTF-8."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(1, len(data))
    shares = (counts @ CLASSES / size).tolist()
    letters = max(1.0, (shares[0] + shares[1] + shares[3]) * size)
    words = data.split()
    n = max(1, len(words))
    distinct = set(words)
    lines = [x for x in data.split(b"\n") if x]
    k = max(1, len(lines))
    ends = sum(1 for x in words if x[-1] in b".!?,;:") / n
    symbols = sum(1 for x in words if not x[-1:].isalnum() and x[-1] < 128 and x[-1] not in b".,;:") / n
    single = sum(1 for x in words if len(x) == 1) / n
    longest = max(map(len, words), default=0)
    p = counts[counts > 0] / size
    return [
        *shares,
        shares[0] * size / letters,
        np.log1p(len(data)),
        np.log1p(len(words)),
        len(data) / n,
        len(distinct) / n,
        len(distinct) / n**0.75,
        float(np.log1p(k)),
        np.log1p(size / k),
        len(set(lines)) / k if lines else 0.0,
        n / k,
        ends,
        symbols,
        single,
        np.log1p(longest),
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
        data.count(b"http") / n,
    ]


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> gbt.Forest:
    sample = label_sample(labels, "quality", MODULUS, HELD, train_rows)
    return gbt.fit(*training_set(labelled_texts(docs, sample, id_col, text_col), statistics))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = fit_quality(docs, labels, id_col, text_col, train_rows)
    return apply(docs, statistics, model.predict, MODULUS, HELD, THRESHOLD, id_col, text_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that the classifier rejects, all columns kept; no text is shuffled."""
    model = fit_quality(docs, labels, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(statistics, model.predict, b.column(at).cast(pa.binary())) >= THRESHOLD))

    return in_batches(docs, run, docs.schema)
