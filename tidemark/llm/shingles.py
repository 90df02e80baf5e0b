"""Word shingles of whole texts as 64-bit hashes, vectorised over batches of documents.

Words are maximal runs of bytes other than ASCII white space, A-Z lower-cased. A word's
hash is a polynomial in random 64-bit values of its bytes, taken from prefix sums over the
batch, so no Python loop runs over words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_R = 0x9E3779B97F4A7C15 | 3
_RINV = pow(_R, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POW: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _POW.get(base)
    if got is None or len(got) < n:
        size = max(n, 1 << 20)
        got = np.full(size, _U(base))
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _POW[base] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@dataclass
class Sets:
    """Sorted distinct shingle hashes of each document: values[starts[i]:starts[i] + n[i]]."""

    values: np.ndarray
    starts: np.ndarray
    n: np.ndarray


def shingle_sets(data: np.ndarray, ends: np.ndarray, k: int = 5) -> Sets:
    """data: the bytes of all texts in a row; ends: where each text ends."""
    docs = len(ends)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    empty = Sets(np.zeros(0, np.uint64), np.zeros(docs, np.int64), np.zeros(docs, np.int64))
    if not len(data):
        return empty
    inside = ~_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[begins[begins < len(data)]] = False
    after[ends[ends > 0] - 1] = False
    ws, we = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    if not len(ws):
        return empty
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_R, len(data)), out=sums[1:])
    word = mix((sums[we] - sums[ws]) * _powers(_RINV, len(data))[ws] + (we - ws).astype(np.uint64))
    owner = np.searchsorted(ends, ws, side="right")
    count = np.bincount(owner, minlength=docs)
    parts, owners = [], []
    if len(word) >= k:
        h = word[: len(word) - k + 1].copy()
        for j in range(1, k):
            h = h * _U(0x2545F4914F6CDD1D) + word[j : len(word) - k + 1 + j]
        whole = owner[: len(h)] == owner[k - 1 :]
        parts.append(mix(h[whole]))
        owners.append(owner[: len(h)][whole])
    first = np.cumsum(count) - count
    for n in range(1, k):
        few = np.flatnonzero(count == n)
        if len(few):
            h = np.full(len(few), _U(n))
            for j in range(n):
                h = h * _U(0x2545F4914F6CDD1D) + word[first[few] + j]
            parts.append(mix(h ^ _U(0xA5A5A5A5A5A5A5A5)))
            owners.append(few)
    v, o = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((v, o))
    v, o = v[order], o[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[new], o[new]
    size = np.bincount(o, minlength=docs)
    return Sets(v, np.cumsum(size) - size, size)


def chunks(column, limit: int = 1 << 20):
    """Slices of an Arrow binary column, of about ``limit`` bytes: (first row, bytes, ends)."""
    n = len(column)
    if not n:
        return
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null(b"")
    big = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if big else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        at = to
