"""Alignment of two tokenizers' tokens by byte offsets.

A is a byte-level BPE tokenizer, given a space and the text; B a sentencepiece model, given the text,
before which it puts a space. So both tile the same bytes. The ends of A's and of B's tokens, taken
together (union1d), cut these into elementary intervals; searchsorted finds the token of each side
that owns an interval, so each interval is one overlap of two tokens. Where both owners end, a group
closes; tokens of different groups never overlap. ``links`` says which pairs count: "ends" (pairs whose
byte ranges end together), "overlaps" (all overlapping pairs) or "products" (every A with every B of a
group, its group's product expanded).

A space between two characters that aren't white space begins a token on both sides, and no token
crosses it: A's pattern sees to that, and of B's pieces none holds its space mark behind another
character (checked; otherwise texts stay whole). So texts are cut there, and each distinct part is
encoded and aligned once in an epoch of about EPOCH_BYTES of text, which bounds memory. An epoch
leaves each document's counts and its parts as numbers, and one row with its distinct linked pairs,
how often each occurs, and the pairs of each part.

Counts of pairs over the whole corpus are sums over epochs: one shuffle of distinct pairs, of which
the highest for a B id is a table with a row for each id of B's vocabulary at most. A join brings the
counts back to each epoch's pairs, and a cogroup by epoch adds them up along the documents' parts. No
pair and no id has its rows in one task: a pair has one row an epoch, summed before the shuffle.

Defined cases: a null or empty text, and a text of which A's or B's token bytes don't join to a space
and the text, has no tokens: zeros and an empty group text. Rows of equal or null doc_id are
documents of their own. Extra columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import packed, split_spaces, unpacked, whole_texts
from tidemark.llm.common import BATCH_BYTES, in_batches, materialize

EPOCH_BYTES, CHUNK_BYTES, ENCODE_PARTS = 16_000_000, 2_000_000, 8_192
SPACE_MARK = "▁"
KINDS = ("ends", "overlaps", "products")


def byte_alphabet() -> dict[str, int]:
    """Of byte-level vocabularies: printable bytes stand for themselves, the others, in order, for the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Side:
    """A tokenizer of parts that begin with a space, and the bytes of its ids."""

    def __init__(self, tokens: list[bytes], encode, cuts: bool) -> None:
        self.tokens, self.encode, self.cuts = tokens, encode, cuts
        self.size = np.array([len(t) for t in tokens], np.int64)


@cache
def byte_level(path: str) -> Side:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf8") as f:
        spec = json.load(f)
    t, alphabet = Tokenizer.from_file(path), byte_alphabet()
    t.encode_special_tokens = True
    tokens = [b""] * t.get_vocab_size()
    for token, i in t.get_vocab().items():
        tokens[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    pre = spec.get("pre_tokenizer") or {}
    cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and spec.get("normalizer") is None
    return Side(tokens, lambda parts: [e.ids for e in t.encode_batch(parts, add_special_tokens=False)], cuts)


@cache
def sentence_pieces(path: str) -> Side:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    tokens = [bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
    plain = "a  b   ﬁ́"  # a model that normalizes gives other bytes for it
    same = b"".join(tokens[i] for i in sp.encode(plain)) == b" " + plain.encode()
    cuts = same and not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
    return Side(tokens, lambda parts: sp.encode([p[1:] for p in parts], num_threads=1), cuts)


def _flat(side: Side, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids and their number for each part."""
    ids, sizes = [np.zeros(0, np.int32)], []
    for at in range(0, len(parts), ENCODE_PARTS):
        found = side.encode(parts[at : at + ENCODE_PARTS])
        sizes += [len(f) for f in found]
        ids.append(np.fromiter((i for f in found for i in f), np.int32))
    return np.concatenate(ids), np.array(sizes, np.int64)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of the given sizes."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def _tiled(side: Side, ids: np.ndarray, sizes: np.ndarray, coded: list[bytes]) -> np.ndarray:
    """Whether the bytes of a part's tokens are the part's."""
    ok = _sums(side.size[ids], sizes) == np.array([len(c) for c in coded], np.int64)
    joined, at = b"".join(map(side.tokens.__getitem__, ids.tolist())), np.concatenate([[0], np.cumsum(_sums(side.size[ids], sizes))])
    for k, c in enumerate(coded):
        if ok[k] and joined[at[k] : at[k + 1]] != c:
            ok[k] = False
    return ok


class Aligned:
    """Alignment of many parts, one after the other: each part's end is an end on both sides.

    intervals: owners a and b (places among the ids) and whether both end; group: of each token.
    """

    def __init__(self, a: Side, b: Side, parts: list[str]) -> None:
        self.vocabulary = len(a.tokens), len(b.tokens)
        coded = [p.encode() for p in parts]
        (ids_a, n_a), (ids_b, n_b) = _flat(a, parts), _flat(b, parts)
        self.ok = _tiled(a, ids_a, n_a, coded) & _tiled(b, ids_b, n_b, coded)
        self.a, self.b = ids_a[np.repeat(self.ok, n_a)], ids_b[np.repeat(self.ok, n_b)]
        self.n_a, self.n_b = np.where(self.ok, n_a, 0), np.where(self.ok, n_b, 0)
        ends_a, ends_b = np.cumsum(a.size[self.a]), np.cumsum(b.size[self.b])
        ends = np.union1d(ends_a, ends_b)
        self.owner_a, self.owner_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        self.closes = (ends_a[self.owner_a] == ends) & (ends_b[self.owner_b] == ends)
        shared = ends[self.closes]
        self.group_a, self.group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        part_a = np.repeat(np.arange(len(parts)), self.n_a)
        self.part = part_a[self.owner_a]  # of each interval
        self.n_groups = np.bincount(self.part[self.closes], minlength=len(parts))

    def links(self, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Part, A id and B id of each linked pair of occurrences."""
        if kind == "products":
            size_a, size_b = (np.bincount(g, minlength=int(self.closes.sum())) for g in (self.group_a, self.group_b))
            first_b = np.cumsum(size_b) - size_b
            times = size_b[self.group_a]  # an A token meets all B tokens of its group
            i = np.repeat(np.arange(len(self.a)), times)
            nth = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
            j = first_b[self.group_a[i]] + nth
            return np.repeat(np.arange(len(self.n_a)), self.n_a)[i], self.a[i], self.b[j]
        some = self.closes if kind == "ends" else np.ones(len(self.closes), bool)
        return self.part[some], self.a[self.owner_a[some]], self.b[self.owner_b[some]]

    def texts(self) -> list[bytes]:
        """Each part's groups as ``a1,a2|b1;a3|b2,b3;``."""
        last_a = np.diff(self.group_a, append=-1) != 0
        last_b = np.diff(self.group_b, append=-1) != 0
        size_a, size_b = np.bincount(self.group_a), np.bincount(self.group_b)
        place_a = np.arange(len(self.a)) + (np.cumsum(size_b) - size_b)[self.group_a]
        place_b = np.arange(len(self.b)) + np.cumsum(size_a)[self.group_b]
        written = np.empty(len(self.a) + len(self.b), object)
        written[place_a] = _names(b",", b"|", self.vocabulary[0])[2 * self.a + last_a]
        written[place_b] = _names(b",", b";", self.vocabulary[1])[2 * self.b + last_b]
        flat, out, at = written.tolist(), [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append(b"".join(flat[at : at + n]))
            at += n
        return out


@cache
def _names(inner: bytes, last: bytes, most: int) -> np.ndarray:
    """At 2 i the decimal id i with ``inner`` behind it, at 2 i + 1 with ``last``; for ids below ``most``."""
    return np.array([b"%d%s" % (i, x) for i in range(most) for x in (inner, last)], object)


SCHEMA = "epoch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups {kind}, parts binary, pairs binary, counts binary, of_part binary"


def _packed(x: np.ndarray) -> bytes:
    """Numbers below 2^16 in two bytes, others in four."""
    return b"H" + x.astype(np.uint16).tobytes() if x.max(initial=0) < 1 << 16 else b"I" + x.astype(np.uint32).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, data[:1].decode(), offset=1)


def _epochs(path_a: str, path_b: str, kind: str, text: bool, epoch_bytes: int, schema: pa.Schema):
    """A row for each document, and behind an epoch's documents one with its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = byte_level(path_a), sentence_pieces(path_b)
        split = split_spaces if a.cuts and b.cuts else whole_texts
        epoch = TaskContext.get().partitionId() << 32

        def out(ids: list, streams: list, counts: list, filled: list, parts: dict[str, int]) -> Iterator[pa.RecordBatch]:
            names = list(parts)
            parts.clear()
            found = Aligned(a, b, names)
            ok = found.ok
            del names
            part, x, y = found.links(kind)
            groups, n_links = found.texts(), np.bincount(part, minlength=len(ok))
            used = np.zeros(len(ok), np.int64)
            each = []
            for i, stream, count, some in zip(ids, streams, counts, filled, strict=True):
                good = (_sums(~ok[stream], count) == 0) & some
                kept = stream[np.repeat(good, count)]
                used += np.bincount(kept, minlength=len(ok))
                each.append((i, kept, np.where(good, count, 0)))
            pairs, at = np.unique(x.astype(np.int64) << 32 | y, return_inverse=True)
            occurs = np.zeros(len(pairs), np.int64)
            np.add.at(occurs, at, used[part])
            for i, stream, count in each:
                cols = [pa.array(np.full(len(i), epoch)), i, *[pa.array(_sums(n[stream], count)) for n in (found.n_a, found.n_b, found.n_groups, n_links)]]
                said, cut, begin = [], [], 0
                for end in np.cumsum(count).tolist():
                    own = stream[begin:end]
                    whole = b"".join(map(groups.__getitem__, own.tolist()))[:-1]
                    said.append(whole.decode() if text else hashlib.sha256(whole).digest() if whole else b"")
                    cut.append(_packed(own))
                    begin = end
                cols += [pa.array(said, schema.field("groups").type), pa.array(cut, pa.binary()), *[pa.nulls(len(i), pa.binary())] * 3]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)
            row = {"epoch": epoch, "pairs": pairs.tobytes(), "counts": occurs.tobytes(), "of_part": packed(n_links, at)}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

        ids, streams, counts, filled, parts, held = [], [], [], [], {}, 0
        for batch in batches:
            texts = batch["text"].fill_null("")
            length = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
            at = 0
            while at < len(batch):  # texts of a bounded size at once
                begin = length[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(length, begin + CHUNK_BYTES, side="right")))
                some = texts.slice(at, to - at)
                stream, count = split(pc.binary_join_element_wise("", some, " "), parts)
                ids.append(batch["doc_id"].slice(at, to - at))
                streams.append(stream)
                counts.append(count)
                filled.append(pc.greater(pc.binary_length(some), 0).to_numpy(zero_copy_only=False))
                held += int(length[to - 1] - begin)
                at = to
                if held >= epoch_bytes:
                    yield from out(ids, streams, counts, filled, parts)
                    ids, streams, counts, filled, parts, held, epoch = [], [], [], [], {}, 0, epoch + 1
        if ids:
            yield from out(ids, streams, counts, filled, parts)

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Epochs' pairs as rows."""
    for b in batches:
        for epoch, pairs, counts in zip(*[b[c].to_pylist() for c in ("epoch", "pairs", "counts")], strict=True):
            key, n = np.frombuffer(pairs, np.int64), np.frombuffer(counts, np.int64)
            for at in range(0, len(key), 50_000):
                k, c = key[at : at + 50_000], n[at : at + 50_000]
                cols = [np.full(len(k), epoch), np.arange(at, at + len(k), dtype=np.int32), k, c]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["epoch", "place", "pair", "n"])


def _tallied(schema: pa.Schema):
    """An epoch's documents with the sums of their pairs' corpus-wide counts."""
    keep = [f for f in schema.names if f not in ("n_best", "count_sum")]

    def run(rows: pa.Table, counts: pa.Table) -> pa.Table:
        own = pc.is_valid(rows["of_part"])
        (of_part,) = rows.filter(own)["of_part"].to_pylist()
        docs = rows.filter(pc.invert(own))
        place, n = counts["place"].to_numpy(), counts["n"].to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = n, counts["best"].to_numpy()
        n_pairs, links = unpacked(of_part)
        sums, bests = _sums(count[links], n_pairs), _sums(best[links], n_pairs)
        streams = [_unpacked(p) for p in docs["parts"].to_pylist()]
        sizes = np.array([len(s) for s in streams], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *streams]).astype(np.int64)
        cols = [docs[f].combine_chunks() for f in keep]
        return pa.Table.from_arrays([*cols, pa.array(_sums(bests[flat], sizes)), pa.array(_sums(sums[flat], sizes))], schema=schema)

    return run


def align(docs: DataFrame, path_a: str, path_b: str, links: str = "ends", text: bool = True, epoch_bytes: int = EPOCH_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum of each document.

    groups: ``a1,a2|b1;a3|b2,b3``, the ids of each group in order; with ``text`` false only its SHA-256
    (binary; empty without tokens). A pair's count is the number of links that hold it in the whole
    corpus; n_best counts links whose pair is a most frequent one of its B id, count_sum adds counts.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    if links not in KINDS:
        raise ValueError(f"links must be one of {KINDS}")
    ddl = SCHEMA.format(kind="string" if text else "binary")
    arrow = lambda d: to_arrow_schema(T.StructType.fromDDL(d))
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(in_batches(small, _epochs(path_a, path_b, links, text, epoch_bytes, arrow(ddl)), ddl, size=BATCH_BYTES), "aligned-epochs")
    held = rows.filter("pairs is not null").select("epoch", "pairs", "counts")
    pairs = in_batches(held, _exploded, "epoch long, place int, pair long, n long", size=BATCH_BYTES)
    total = materialize(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    second = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    most = total.groupBy(second).agg(F.max("n").alias("most"))  # B's vocabulary bounds these rows
    known = total.withColumn("b", second).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    counts = pairs.select("epoch", "place", "pair").join(known, "pair").select("epoch", "place", "n", "best")
    result = f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups {'string' if text else 'binary'}, n_best long, count_sum long"
    both = rows.drop("pairs", "counts").groupBy("epoch").cogroup(counts.groupBy("epoch"))
    return both.applyInArrow(_tallied(arrow(result)), result)
