"""Language ID by a byte convolutional network.

The network reads fixed windows of WINDOW bytes of the lower-cased text. Filters of widths
2, 3 and 4 look at bytes directly: a filter of width w is w tables of 256 weights, its
response at a position the sum of the weights of the bytes there. The largest response of
each filter in the window (max pooling, then a rectifier) feeds a softmax over the
languages. A text's probabilities are the mean over all its windows, weighted by their
bytes; the last window is padded with zero bytes. Training is plain numpy: the gradient of
a max pool touches one position of each filter. For use, tables of byte pairs are made from
the single-byte ones, so a position costs five lookups.

It is fitted on at most ``train_docs`` documents with a language outside the held-out
bucket (those with the smallest hashes of their ids), at most ``train_windows`` windows of
each; classes are weighted to count alike.

Defined cases: a text that is null or has no letter gets ``und`` with score 0. With no
usable training rows every text gets ``und``. Null languages are not learned. Repeated
rows get equal results. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_bucket, in_batches

MODULUS, HELD = 4, 2
WINDOW, FILTERS, WIDTHS = 256, 10, (2, 3, 4)
PLAIN = re.compile("[A-Za-z]")
CHUNK = 1024  # windows scored at once: 256 KiB of text


def has_letter(text: str) -> bool:
    """Whether some character is a letter (Unicode general category L); numerals and marks are none."""
    return bool(PLAIN.search(text)) or any(c.isalpha() for c in set(text))


def windows(data: bytes) -> np.ndarray:
    """(n, WINDOW) bytes, zero-padded at the end."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class Network:
    langs: list[str]
    tables: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    out: np.ndarray  # (filters, languages)
    bias: np.ndarray
    pairs: dict[str, np.ndarray] | None = None

    def compile(self) -> Network:
        def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (a[:, None, :] + b[None, :, :]).reshape(65536, -1).astype(np.float32)

        t2, t3, t4 = (self.tables[w] for w in WIDTHS)
        self.pairs = {"2": pair(*t2), "3": pair(t3[0], t3[1]), "4a": pair(t4[0], t4[1]), "4b": pair(t4[2], t4[3])}
        self.last3 = t3[2].astype(np.float32)
        return self

    def pooled(self, x: np.ndarray) -> np.ndarray:
        p = self.pairs
        two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        r2 = p["2"][two].max(1)
        r3 = (p["3"][two[:, :-1]] + self.last3[x[:, 2:]]).max(1)
        r4 = (p["4a"][two[:, :-2]] + p["4b"][two[:, 2:]]).max(1)
        return np.maximum(np.concatenate([r2, r3, r4], axis=1), 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.out + self.bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 5, rate: float = 0.02, batch: int = 64) -> Network:
    """Adam on the cross-entropy. x: (n, WINDOW) bytes, y: class of each window."""
    rng = np.random.default_rng(7)
    n_out = len(langs)
    params = [rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS]
    params += [rng.normal(0, 0.3, (FILTERS * len(WIDTHS), n_out)), np.zeros(n_out)]
    params = [p.astype(np.float32) for p in params]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = len(y) / (n_out * np.maximum(1, np.bincount(y, minlength=n_out)))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            b, label = x[rows], y[rows]
            k = np.arange(len(rows))[:, None]
            tops, wheres = [], []
            for w, t in zip(WIDTHS, params, strict=False):
                r = t[0][b[:, : WINDOW - w + 1]].copy()
                for j in range(1, w):
                    r += t[j][b[:, j : WINDOW - w + 1 + j]]
                where = r.argmax(1)
                wheres.append(where)
                tops.append(r[k, where, np.arange(FILTERS)[None, :]])
            h = np.concatenate(tops, axis=1)
            active = h > 0
            a = np.where(active, h, 0)
            z = a @ params[-2] + params[-1]
            e = np.exp(z - z.max(1, keepdims=True))
            d = e / e.sum(1, keepdims=True)
            d[np.arange(len(rows)), label] -= 1
            d *= (weight[label] / len(rows))[:, None]
            dh = (d @ params[-2].T) * active
            grads = []
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(params[i])
                part = dh[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (b[k, wheres[i] + j], np.arange(FILTERS)[None, :]), part)
                grads.append(g)
            grads += [a.T @ d, d.sum(0)]
            step += 1
            for p, g, mi, vi in zip(params, grads, m, v, strict=True):
                mi += 0.1 * (g - mi)
                vi += 0.01 * (g * g - vi)
                p -= rate * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.99**step)) + 1e-8)
    return Network(langs, dict(zip(WIDTHS, params, strict=False)), params[-2], params[-1])


def training_windows(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, train_docs: int, train_windows: int
) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Bounded: at most train_docs * train_windows windows reach the driver.

    Of the documents sampled, the windows are spread evenly over the whole text.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_bucket(F.col("doc_id"), MODULUS) != HELD)
    )
    last = known.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(train_docs).agg(F.max("h")).first()[0]
    if last is None:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    chosen = known.filter(F.xxhash64("doc_id") <= last).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, out = [], []
            for lang, text in zip(b["lang"].to_pylist(), b["text"], strict=True):
                w = windows(text.as_py().lower().encode())
                for i in np.unique(np.linspace(0, len(w) - 1, train_windows).astype(int)):
                    langs.append(lang)
                    out.append(w[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "w"])

    # Repeated rows of one id share its hash: equal windows count once, and the limit bounds the others.
    each = in_batches(chosen, cut, "lang string, w binary").distinct()
    got = each.orderBy(F.xxhash64("w"), "w", "lang").limit(train_docs * train_windows).toPandas().sort_values(["lang", "w"])
    langs = sorted(set(got["lang"]))
    x = np.frombuffer(b"".join(map(bytes, got["w"])), np.uint8).reshape(-1, WINDOW)
    return x, np.searchsorted(np.array(langs, dtype=object), got["lang"].to_numpy(dtype=object)), langs


def predict_language(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    train_docs: int = 4_000,
    train_windows: int = 3,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    x, y, langs = training_windows(docs, id_col, text_col, lang_col, train_docs, train_windows)
    net = fit(x, y, langs) if langs else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = net.compile() if net else None
        for b in batches:
            sure = np.zeros((len(b), len(langs) or 1))
            known = np.zeros(len(b), bool)
            pending, owner, size, held = [], [], [], 0

            def flush() -> None:
                nonlocal pending, owner, size, held
                if pending:
                    all_w, own, by = np.concatenate(pending), np.concatenate(owner), np.concatenate(size)
                    for i in range(0, len(all_w), CHUNK):
                        p = ready.probabilities(all_w[i : i + CHUNK])
                        np.add.at(sure, own[i : i + CHUNK], p * by[i : i + CHUNK, None])
                pending, owner, size, held = [], [], [], 0

            for i, t in enumerate(b["text"]):
                text = t.as_py()
                if ready is None or text is None or not has_letter(text):
                    continue
                known[i] = True
                data = text.lower().encode()
                w = windows(data)
                full = np.full(len(w), WINDOW)
                full[-1] = len(data) - WINDOW * (len(w) - 1)
                pending.append(w)
                owner.append(np.full(len(w), i))
                size.append(full)
                held += len(w)
                if held >= CHUNK:
                    flush()
            flush()
            total = np.maximum(sure.sum(1), 1e-9)
            best = sure.argmax(1)
            names = [langs[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
            score = np.where(known, sure.max(1) / total, 0.0)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], ["doc_id", "lang_pred", "score"]
            )

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return in_batches(slim, run, f"doc_id {kind}, lang_pred string, score double").select(
        "doc_id", (id_bucket(F.col("doc_id"), MODULUS) == HELD).alias("held_out"), "lang_pred", "score"
    )
