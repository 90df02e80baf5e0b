"""Canonical, length-limited Huffman codes of token ids, in numpy.

Lengths come from the coin collector's rule (package-merge): in each of ``max_bits`` rounds the
symbols, by rising count, are merged with pairs of the last round's items; of the last round the
2 (n - 1) lightest items are taken, and a symbol's length is the number of rounds in which it is
taken. Codes are canonical: by length, then id, so lengths alone say all.

Bits fill bytes from the highest bit. Every BLOCK ids the bit offset is noted, so blocks are
decoded on their own: all blocks of a stretch step through the table at once, an id a step.
"""

from __future__ import annotations

import numpy as np

MAX_BITS = 20
BLOCK = 256


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol, 0 for those that never occur; at most ``max_bits``."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols don't fit codes of {max_bits} bits")
    if n < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    rounds, packages = [], np.zeros(0, np.int64)
    for _ in range(max_bits):
        items = np.concatenate([weight, packages])
        at = np.argsort(items, kind="stable")
        items = items[at]
        rounds.append(np.cumsum(at < n))  # symbols among the first 1, 2, ... items
        even = len(items) // 2 * 2
        packages = items[0:even:2] + items[1:even:2]
    taken = 2 * (n - 1)
    for symbols in reversed(rounds):
        if not taken:
            break
        k = int(symbols[taken - 1])
        lengths[order[:k]] += 1
        taken = 2 * (taken - k)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol as a number of its length's bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint64)
    if len(order):
        size = lengths[order].astype(np.uint64)
        longest = size[-1]
        room = np.uint64(1) << (longest - size)  # codes of the longest length that each one covers
        codes[order] = (np.cumsum(room) - room) >> (longest - size)
    return codes


class Writer:
    """Bits of a growing sequence of ids. A block's offset counts from the first id's bit."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.length, self.code = lengths.astype(np.int64), canonical(lengths)
        self.bits, self.ids = 0, 0
        self.left = np.uint64(0)  # the bits of the word that isn't full
        self.offsets: list[np.ndarray] = []

    def add(self, ids: np.ndarray) -> bytes:
        """The bytes that ``ids`` complete."""
        if not len(ids):
            return b""
        size = self.length[ids]
        if not size.all():
            raise ValueError("an id without a code")
        begin = self.bits + np.cumsum(size) - size
        self.offsets.append(begin[-self.ids % BLOCK :: BLOCK])
        self.ids += len(ids)
        end = int(begin[-1] + size[-1])
        first = self.bits >> 6
        word, within = (begin >> 6) - first, begin & 63
        over = within + size - 64  # bits that don't fit the word
        code = self.code[ids]
        high = np.where(over > 0, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
        words = np.zeros((end >> 6) - first + 1, np.uint64)
        new = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[new]] = np.bitwise_or.reduceat(high, new)
        words[0] |= self.left
        spilled = np.flatnonzero(over > 0)  # at most one for each word
        words[word[spilled] + 1] |= code[spilled] << (64 - over[spilled]).astype(np.uint64)
        self.bits, self.left = end, words[-1]
        return words[:-1].astype(">u8").tobytes()

    def close(self) -> bytes:
        """The last bytes; no id follows."""
        rest = -(-(self.bits & 63) // 8)
        return np.array([self.left], ">u8").tobytes()[:rest]

    def checkpoints(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *self.offsets])


def table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For every string of ``width`` bits: the id whose code it begins with, times 64, and the code's length."""
    width = max(1, int(lengths.max(initial=0)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    filled = np.repeat(order.astype(np.int64) * 64 + size, 1 << (width - size))
    return np.concatenate([filled, np.full((1 << width) - len(filled), 1, np.int64)]), width


def decode(data: np.ndarray, offsets: np.ndarray, n_ids: int, codes: tuple[np.ndarray, int]) -> np.ndarray:
    """``n_ids`` ids of the blocks that begin at bit ``offsets`` of ``data`` (uint8); all but the last are full."""
    by_bits, width = codes
    if not n_ids:
        return np.zeros(0, np.int64)
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    wide = wide[:-3] << np.uint32(24) | wide[1:-2] << np.uint32(16) | wide[2:-1] << np.uint32(8) | wide[3:]
    at, last = offsets.astype(np.int64), len(wide) - 1
    out = np.empty((min(BLOCK, n_ids), len(at)), np.int64)
    for step in range(len(out)):  # the last block may run over its end; what it finds there is cut off
        seen = wide[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32) >> np.uint32(32 - width)
        found = by_bits[seen]
        out[step] = found >> 6
        at = at + (found & 63)
    return out.T.reshape(-1)[:n_ids] if len(out) == BLOCK else out[:, 0]
