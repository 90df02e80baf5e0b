"""Compression of vectors to codes of a few bytes: one codebook for each part of a vector, by Lloyd's
rounds with heaps.

A vector's components become integers floor(scale * x) and it is cut into equal consecutive parts.
Each part position has a codebook. A round assigns each part to the nearest entry (squared Euclidean
distance, ties to the lower index) and then moves each entry to the componentwise floor of its parts'
mean; entries without parts stay.

Most parts needn't be looked at again in a round. Vectors lie in blocks, a row of a Parquet table
each, and a block keeps a heap for each entry and position. A part stands in its entry's heap under
the slack of its bounds when it was last scanned: distance to the second nearest entry less that to
its own, plus the entry's cumulative drift at that time. An entry's drift grows in a round by the way
it moved itself plus the longest way that any other moved, so a part's bounds can be violated only
once the drift has reached its key: only those are popped, and scanned exactly against all entries.
Arithmetic is exact: integers, in doubles where they stay below 2^53; bounds leave room for the
rounding of square roots.

A round is one job over the blocks. It writes the blocks' next state and, for each task, the change of
every entry's sum and count by the parts that moved, so a round ships what changed and never vectors.
The driver holds codebooks, sums and drifts: entries times dimensions numbers. States are tables in
the shared folder; a lost executor's blocks are read again from the last one.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor
do those whose length differs from that of the smallest vec_id. The first codebooks are the parts of
the vectors of smallest vec_id (null last; equal ids by their components); fewer rows than entries
make a smaller codebook. Repeated rows count each. A length that isn't a multiple of ``parts``, or
components whose squares leave 64 bits, are an error. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import BATCH_BYTES, in_batches, materialize, sized

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK_ROWS, BLOCK_NUMBERS = 8_192, 1_000_000
SAFE = 1e-9


@dataclass
class Codebooks:
    """values[part]: entries x components, drift[part]: what each entry's slack has lost so far."""

    values: list[np.ndarray]
    drift: list[np.ndarray]

    def moved(self, values: list[np.ndarray]) -> Codebooks:
        drift = []
        for old, new, lost in zip(self.values, values, self.drift, strict=True):
            way = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1)) * (1 + SAFE)
            first = int(np.argmax(way))
            others = np.full(len(way), way[first])
            others[first] = np.delete(way, first).max(initial=0.0)
            drift.append(lost + way + others)
        return Codebooks(values, drift)

    def digest(self) -> str:
        """Of all entries' decimal components, by part, entry and position."""
        return hashlib.sha256(",".join(str(x) for v in self.values for x in v.ravel().tolist()).encode()).hexdigest()


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    most = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    room = 4 * x.shape[1] * most * most
    if room >= 1 << 63:
        raise ValueError(f"components up to {most}: their squared distances leave 64 bits")
    if room >= 1 << 53:
        return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)
    a, b = x.astype(np.float64), entries.astype(np.float64)
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, and the slack: distance to the second nearest less that to the nearest."""
    if len(entries) == 1:
        return np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    d = distances(x, entries)
    own, row = d.argmin(1), np.arange(len(x))
    d = d.astype(np.float64, copy=False)  # rounds above 2^53, for which SAFE leaves room
    near = np.sqrt(np.maximum(d[row, own], 0))
    d[row, own] = np.inf
    second = np.sqrt(np.maximum(d.min(1), 0))
    return own, second - near - SAFE * (1 + second + near)


class Heaps:
    """Of one part position: rows under their keys, in heap order, entry after entry."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> None:
        self.keys, self.rows, self.ends = keys, rows, np.cumsum(sizes)
        self.open: dict[int, list[tuple[float, int]]] = {}

    @classmethod
    def of(cls, own: np.ndarray, keys: np.ndarray, entries: int) -> Heaps:
        rows = np.lexsort((keys, own))  # what is sorted is a heap
        return cls(keys[rows], rows, np.bincount(own, minlength=entries))

    def _span(self, entry: int) -> slice:
        return slice(int(self.ends[entry - 1]) if entry else 0, int(self.ends[entry]))

    def heap(self, entry: int) -> list[tuple[float, int]]:
        if entry not in self.open:
            s = self._span(entry)
            self.open[entry] = list(zip(self.keys[s].tolist(), self.rows[s].tolist(), strict=True))
        return self.open[entry]

    def pop(self, drift: np.ndarray) -> np.ndarray:
        """Rows whose bounds the drift of their entry has violated."""
        out: list[int] = []
        full = np.flatnonzero(np.diff(self.ends, prepend=0))
        begins = self.ends[full] - np.diff(self.ends, prepend=0)[full]
        for entry in full[self.keys[begins] <= drift[full]].tolist():
            heap, limit = self.heap(entry), drift[entry]
            while heap and heap[0][0] <= limit:
                out.append(heappop(heap)[1])
        return np.array(out, np.int64)

    def push(self, rows: np.ndarray, own: np.ndarray, keys: np.ndarray) -> None:
        for entry, item in zip(own.tolist(), zip(keys.tolist(), rows.tolist(), strict=True), strict=True):
            heappush(self.heap(entry), item)

    def closed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, rows and the number of them for each entry."""
        parts = [self.open.get(e) for e in range(len(self.ends))]
        spans = [self._span(e) for e in range(len(self.ends))]
        keys = [self.keys[s] if p is None else np.array([k for k, _ in p]) for p, s in zip(parts, spans, strict=True)]
        rows = [self.rows[s] if p is None else np.array([r for _, r in p], np.int64) for p, s in zip(parts, spans, strict=True)]
        return np.concatenate(keys), np.concatenate(rows), np.array([len(k) for k in keys])


def _finite(v: Column) -> Column:
    inf = F.lit(float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != inf))


STATE = "block long, vec_id array<long>, label array<{label}>, vectors binary, own binary, keys binary, heaps binary, sizes binary, part int, entry int, n long, sums array<long>"


class _Changes:
    """A task's change of sums and counts."""

    def __init__(self, books: Codebooks) -> None:
        self.sums = [np.zeros(v.shape, np.int64) for v in books.values]
        self.counts = [np.zeros(len(v), np.int64) for v in books.values]

    def add(self, part: int, x: np.ndarray, own: np.ndarray, sign: int) -> None:
        np.add.at(self.sums[part], own, sign * x)
        self.counts[part] += sign * np.bincount(own, minlength=len(self.counts[part]))

    def rows(self) -> Iterator[dict]:
        for part, (sums, counts) in enumerate(zip(self.sums, self.counts, strict=True)):
            for entry in np.flatnonzero(counts | sums.any(1)).tolist():
                yield {"part": part, "entry": entry, "n": int(counts[entry]), "sums": sums[entry].tolist()}


def _blocks(dim: int, scale: int, schema: pa.Schema):
    """Rows to blocks of vectors."""
    most = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32

        def out(held: pa.Table) -> pa.RecordBatch:
            x = np.floor(scale * held["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            if np.abs(x).max(initial=0) >= 1 << 62:
                raise ValueError("a component leaves 64 bits")
            kind = "h" if np.abs(x).max(initial=0) < 1 << 15 else "q"  # 16 or 64 bits
            row = {"block": block, "vec_id": held["vec_id"].to_pylist(), "label": held["label"].to_pylist(), "vectors": kind.encode() + x.astype(kind).tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= most:
                rows = pa.Table.from_batches(held)
                while len(rows) >= most:
                    yield out(rows.slice(0, most))
                    rows, block = rows.slice(most), block + 1
                held = rows.to_batches()
        if sum(map(len, held)):
            yield out(pa.Table.from_batches(held))

    return run


def _vectors(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, data[:1].decode(), offset=1).reshape(-1, dim).astype(np.int64)


def _round(books: Codebooks, schema: pa.Schema):
    """Blocks to their next state, and the task's changes behind them."""
    dim = sum(v.shape[1] for v in books.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changes = _Changes(books)
        for row in (r for b in batches for r in b.to_pylist()):
            x = _vectors(row["vectors"], dim)
            cut, n = np.split(x, len(books.values), axis=1), len(x)
            first = row["own"] is None
            before = None if first else np.frombuffer(row["own"], np.uint16).reshape(-1, n)
            old = [] if first else [np.frombuffer(row[c], k).reshape(len(cut), -1) for c, k in (("keys", "d"), ("heaps", np.int32), ("sizes", np.int32))]
            owns, states = [], []
            for part, (v, entries, drift) in enumerate(zip(cut, books.values, books.drift, strict=True)):
                if first:
                    own, slack = scan(v, entries)
                    heaps = Heaps.of(own, slack + drift[own], len(entries))
                    changes.add(part, v, own, 1)
                else:
                    heaps = Heaps(*[a[part] for a in old])
                    own = before[part].astype(np.int64)
                    again = heaps.pop(drift)
                    if len(again):
                        found, slack = scan(v[again], entries)
                        heaps.push(again, found, slack + drift[found])
                        was = own[again]
                        own[again] = found
                        gone = was != found
                        changes.add(part, v[again[gone]], was[gone], -1)
                        changes.add(part, v[again[gone]], found[gone], 1)
                owns.append(own)
                states.append(heaps.closed())
            row["own"] = np.array(owns, np.uint16).tobytes()
            for c, kind, some in zip(("keys", "heaps", "sizes"), ("d", np.int32, np.int32), zip(*states, strict=True), strict=True):
                row[c] = np.array(some).astype(kind).tobytes()
            yield pa.RecordBatch.from_pylist([row], schema=schema)
        last = list(changes.rows())
        if last:
            yield pa.RecordBatch.from_pylist(last, schema=schema)

    return run


def _coded(books: Codebooks, schema: pa.Schema):
    """Blocks to rows of vec_id, code, error and label."""
    dim = sum(v.shape[1] for v in books.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            x = _vectors(row["vectors"], dim)
            own = np.frombuffer(row["own"], np.uint16).reshape(len(books.values), len(x)).astype(np.int64)
            error = sum(((v - e[o]) ** 2).sum(1) for v, e, o in zip(np.split(x, len(own), axis=1), books.values, own, strict=True))
            digits = max(2, len(f"{max(len(v) for v in books.values) - 1:x}"))
            code = ["".join([f"{c:0{digits}x}" for c in cs]) for cs in own.T.tolist()]
            cols = [row["vec_id"], code, error, row["label"]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """(vec_id, code, error, label) of every vector, and the codebooks."""
    label = rows.schema["label"].dataType.simpleString()
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    kept = own.filter(_finite(F.col("embedding")))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    result = f"vec_id long, code string, error long, label {label}"
    dim = len(first[0].embedding) if first else parts
    if dim % parts:
        raise ValueError(f"{dim} components can't be cut into {parts} equal parts")
    start = np.floor(scale * np.array([r.embedding for r in first if len(r.embedding) == dim], np.float64).reshape(-1, dim)).astype(np.int64)
    values = np.split(start, parts, axis=1)
    books = Codebooks(values, [np.zeros(len(v)) for v in values])
    if not first:
        return rows.sparkSession.createDataFrame([], result), books
    ddl = STATE.format(label=label)
    schema = _arrow(ddl)
    blocks = kept.filter(F.size("embedding") == dim)
    state = materialize(in_batches(blocks, _blocks(dim, scale, schema), ddl, size=BATCH_BYTES), "vector-blocks")
    sums = [np.zeros(v.shape, np.int64) for v in values]
    counts = [np.zeros(len(v), np.int64) for v in values]
    for _ in range(rounds):
        state = materialize(in_batches(state.filter("vectors is not null"), _round(books, schema), ddl, size=BATCH_BYTES), "vector-round")
        changed = state.filter("part is not null").select("part", "entry", "n", F.posexplode("sums").alias("i", "v"))
        total = changed.groupBy("part", "entry", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        for r in total.collect():  # entries times components at most
            sums[r.part][r.entry, r.i] += r.v
            if r.i == 0:
                counts[r.part][r.entry] += r.n
        moved = [np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], v) for v, s, n in zip(books.values, sums, counts, strict=True)]
        books = books.moved(moved)
    state = materialize(in_batches(state.filter("vectors is not null"), _round(books, schema), ddl, size=BATCH_BYTES), "vector-round")
    found = state.filter("vectors is not null").select("vec_id", "label", "vectors", "own")
    return in_batches(found, _coded(books, _arrow(result)), result, size=BATCH_BYTES), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error: the errors summed over equal labels, nulls together."""
    codes = materialize(codes, "vector-codes")
    total = sized(materialize(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors"))
    return codes.alias("c").join(total.alias("t"), F.col("c.label").eqNullSafe(F.col("t.label"))).select("c.*", "t.label_error")
