"""Token-ID files: documents' ids in canonical length-limited Huffman codes.

Writing. Texts are encoded with the tokenizers library and an end id is put behind each. The
corpus-wide count of every id (a row for each id of the vocabulary, summed by Spark) gives the
code lengths. Documents are range-partitioned and sorted by doc_id; a task codes its documents as
one stream of ids into one file and writes the file to the shared folder. A task that is run again
writes a file of another name, and only the files of finished tasks stand in the index, so a lost
executor leaves nothing but an unused file.

A folder holds ``index`` (Parquet: a row for each file with its path, first id's number and
counts), ``lengths`` (Parquet: a code length for each id) and files:

    code bits | bit offset of every 256th id, int64 | doc_id int64, null mark byte, n_ids int64
    of each document | int64: n_ids, n_documents, bytes of code | magic

Numbers are little-endian. Reading decodes the blocks between two offsets on their own through one
table; ``read_documents`` streams whole files, a task each, and ``read_ids`` fetches a stretch of
ids by its numbers and touches only the blocks that hold it.

Tokenizers in WORDWISE drop white space and never look across pieces of their pattern, so texts are
cut at white space, and each distinct piece is encoded by the library once while it is remembered (a
worker keeps about CACHED_WORDS); all others get whole texts. Memory: texts come in groups of
GROUP_BYTES, ids leave in chunks, and a file's documents are
bounded by IDS_PER_FILE ids (a longer document has a file to itself or shares one).

Defined cases: a null text counts as empty: it has the end id only. A null doc_id comes first.
Rows of equal doc_id are ordered by a hash of their ids, equal rows as they come. Extra columns are
ignored. An empty table gives an empty index and no documents.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import huffman
from tidemark.llm.alignment import byte_alphabet
from tidemark.llm.common import BATCH_BYTES, in_batches, materialize, n_shuffle, scratch

MAGIC = b"tm-ids-1"
IDS_PER_FILE, CHUNK_IDS, GROUP_BYTES = 1 << 28, 1 << 18, 16_000_000
CACHED_WORDS, CACHED_LENGTH = 300_000, 48
#: Fixed value: the pre-tokenizing patterns without white space whose matches are all that is kept.
WORDWISE = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


def _wordwise(path: str) -> bool:
    """Whether a tokenizer lowers, keeps only the pieces of such a pattern, and merges their bytes."""
    with open(path, encoding="utf8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    first, last = steps[0], steps[-1]
    split = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    plain = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    bytes_ = len(steps) == 2 and last.get("type") == "ByteLevel" and not last.get("add_prefix_space") and not last.get("use_regex")
    return split and plain and bytes_ and spec["model"]["type"] == "BPE" and first["pattern"].get("Regex") in WORDWISE


def gathered(batches: Iterator[pa.RecordBatch], size: int = GROUP_BYTES) -> Iterator[pa.Table]:
    """The same rows in tables of about ``size`` bytes of text, or of one longer text."""
    held, total = [], 0
    for b in batches:
        ends = np.cumsum(pc.binary_length(b["text"]).fill_null(0).to_numpy(), dtype=np.int64)
        at = 0
        while at < len(b):
            begin = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, begin + size - total, side="right")))
            held.append(b.slice(at, to - at))
            total, at = total + int(ends[to - 1] - begin), to
            if total >= size:
                yield pa.Table.from_batches(held)
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


def taken(values: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``values`` numbered ``rows``, one after the other, and their sizes; stretch k ends at ends[k]."""
    begin = np.concatenate([[0], ends[:-1]])[rows] if len(ends) else np.zeros(0, np.int64)
    size = ends[rows] - begin
    upto = np.cumsum(size)
    return values[np.repeat(begin - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)], size


class WordEncoder:
    """Ids of texts by words: each piece is encoded once while it is remembered.

    Words whose characters are all below U+0250, lowered too, are lowered and cut into the pattern's pieces
    here (for these characters lowering, composition and classes have been fixed in Unicode for long), and the
    library's model merges a piece's bytes; other words, and words that hold an added token in any case, are
    encoded whole. A group's words are cut at once, as lines of one string: no piece holds a line's end.
    """

    PIECE = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\x09-\x0d \x85\xa0a-z0-9\xaa\xb5\xba\xb2\xb3\xb9\xbc-\xbe\xdf-\xf6\xf8-\u024f]+")
    #: Letters below U+0250 whose lower case isn't.
    LEAVING = "".join(c for c in map(chr, range(0x250)) if max(c.lower()) > "\u024f")

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        self.numbers: dict[str, int] = {}
        self.letters = {b: c for c, b in byte_alphabet().items()}
        added = [f"(?i:{re.escape(t.content)})" for t in tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([r"[^\x00-\x{24f}]", f"[{self.LEAVING}]", *added])  # what isn't cut here
        self.flat, self.ends, self.seen = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keep the pieces that were met in several groups, unless these alone are too many."""
        kept = [p for p, k in self.numbers.items() if self.seen[k] > 1 and len(p) <= CACHED_LENGTH]
        kept = kept if len(kept) <= CACHED_WORDS // 2 else []
        at = np.array([self.numbers[p] for p in kept], np.int64)
        self.flat, size = taken(self.flat, self.ends, at)
        self.ends, self.seen = np.cumsum(size), np.ones(len(kept), np.int32)
        self.numbers = {p: k for k, p in enumerate(kept)}

    def _add(self, new: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        begin = self.ends[-1] if len(self.ends) else 0
        self.numbers.update(zip(new, range(len(self.ends), len(self.ends) + len(new)), strict=True))
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.ends = np.concatenate([self.ends, begin + np.cumsum(size, dtype=np.int64)])
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int32)])

    def _learn_pieces(self, new: list[str]) -> None:
        """By the library's BPE model alone. A piece's tokens go at once: lists of them would keep Python's collector busy."""
        tokenize, letters, ids, size = self.tokenizer.model.tokenize, self.letters, array("i"), array("i")
        for p in new:
            found = tokenize(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(letters))
            ids.extend([t.id for t in found])
            size.append(len(found))
        self._add(new, np.array(ids, np.int32), np.array(size, np.int64))

    def _learn_words(self, new: list[str]) -> None:
        """Through all the library's steps."""
        found = [e.ids for e in self.tokenizer.encode_batch(new, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        self._add(new, np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size)

    def __call__(self, texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids and their number for each text."""
        lists = pc.ascii_split_whitespace(texts.combine_chunks())
        coded = lists.flatten().dictionary_encode()
        if len(self.numbers) > CACHED_WORDS or len(self.flat) > 16 * CACHED_WORDS:
            self._forget()
        whole = pc.match_substring_regex(coded.dictionary, self.whole)
        cut, uncut = coded.dictionary.filter(pc.invert(whole)), coded.dictionary.filter(whole).to_pylist()
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(cut)], pa.int32()), cut), "\n")[0].as_py()
        pieces = self.PIECE.findall(lines.lower() + "\n" * bool(len(cut)))  # a line's end behind each word
        self._learn_pieces([p for p in dict.fromkeys(pieces) if p != "\n" and p not in self.numbers])
        self._learn_words([w for w in uncut if w not in self.numbers])
        self.numbers["\n"] = -1
        places = np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))
        del self.numbers["\n"]
        # Words in the order cut, uncut: how many pieces each has, and their places.
        breaks = np.flatnonzero(places < 0)
        of_words = np.concatenate([np.diff(breaks, prepend=-1) - 1, np.ones(len(uncut), np.int64)])
        places = np.concatenate([places[places >= 0], np.fromiter(map(self.numbers.__getitem__, uncut), np.int64, len(uncut))])
        self.seen[np.unique(places)] += 1
        ids, size = taken(self.flat, self.ends, places)
        word_ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(of_words)]
        mask = whole.to_numpy(zero_copy_only=False)
        place = np.empty(len(mask), np.int64)
        place[~mask], place[mask] = np.arange(len(cut)), len(cut) + np.arange(len(uncut))
        out, n = taken(ids, word_ends, place[coded.indices.to_numpy()])
        upto = np.concatenate([[0], np.cumsum(n)])
        words = np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)
        return out, np.diff(upto[words], prepend=0)


def _text_encoder(tokenizer):
    def run(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.int64) for e in tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.int64), *found]), np.array([len(f) for f in found], np.int64)

    return run


@cache
def _encoder(path: str):
    """A worker's encoder, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return (WordEncoder if _wordwise(path) else _text_encoder)(tokenizer), tokenizer.get_vocab_size()


def encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, row (a number that tells rows apart), n_ids, ids (little-endian, of two bytes if the vocabulary allows it, else four)."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, vocabulary = _encoder(path)
        width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
        row = TaskContext.get().partitionId() << 40
        for b in gathered(batches):
            ids, n = encoder(pc.fill_null(b["text"], ""))
            whole = np.insert(ids, np.cumsum(n), end_id).astype(f"<u{width}").tobytes()
            cut = np.concatenate([[0], np.cumsum(n + 1)]) * width
            data = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(whole)])
            docs_ = b["doc_id"].combine_chunks()
            yield pa.RecordBatch.from_arrays([docs_, pa.array(row + np.arange(len(b))), pa.array(n + 1), data], schema=schema)
            row += len(b)

    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_batches(small, run, "doc_id long, row long, n_ids long, ids binary", size=BATCH_BYTES)


def _numbers(b: pa.RecordBatch) -> np.ndarray:
    """The ids of a batch of coded documents."""
    data = b"".join(b["ids"].to_pylist())
    total = pc.sum(b["n_ids"]).as_py() or 0
    return np.frombuffer(data, f"<u{len(data) // total}" if total else "<u4")


def id_counts(coded: DataFrame) -> DataFrame:
    """id, n: each task counts its own ids, so at most a row for each id leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(_numbers(b))
            size = max(len(n), len(total))
            total = np.pad(total, (0, size - len(total))) + np.pad(n, (0, size - len(n)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return in_batches(coded.select("ids", "n_ids"), run, "id long, n long", size=BATCH_BYTES).groupBy("id").agg(F.sum("n").alias("n"))


def _open(path: str):
    """A file system for workers and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _writer(folder: str, lengths: np.ndarray):
    names = ["path", "first_doc", "first_key", "first_row", "n_docs", "n_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, docs, sizes, out, first = None, [], [], None, None
        bits = huffman.Writer(lengths)
        for b in batches:
            if not len(b):
                continue
            if out is None:
                first = [b[c][0].as_py() for c in ("doc_id", "key", "row")]
                where = f"{folder}/part-{uuid.uuid4().hex}.ids"
                fs, path = _open(where)
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(path)
            docs.append(b["doc_id"])
            sizes.append(b["n_ids"].to_numpy())
            ids = _numbers(b)
            for at in range(0, len(ids), CHUNK_IDS):
                out.write(bits.add(ids[at : at + CHUNK_IDS]))
        if out is None:
            return
        out.write(bits.close())
        ids, marks = pa.chunked_array(docs), pa.chunked_array(docs).is_null()
        out.write(bits.checkpoints().astype("<i8").tobytes())
        out.write(ids.fill_null(0).to_numpy().astype("<i8").tobytes() + marks.to_numpy().astype(np.uint8).tobytes())
        out.write(np.concatenate(sizes).astype("<i8").tobytes())
        out.write(np.array([bits.ids, len(ids), -(-bits.bits // 8)], "<i8").tobytes() + MAGIC)
        out.close()
        values = [[where], *[[x] for x in first], [len(ids)], [bits.ids]]
        kinds = [pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

    return run


def write(docs: DataFrame, path: str, end_id: int, folder: str, ids_per_file: int = IDS_PER_FILE, max_bits: int = huffman.MAX_BITS) -> None:
    """Encode all texts and write their ids under ``folder``, a new folder that executors can write to."""
    spark = docs.sparkSession
    coded = materialize(encode(docs, path, end_id), "coded-documents")
    counts = materialize(id_counts(coded), "id-counts")  # at most a row for each id of the vocabulary
    found = {r.id: r.n for r in counts.collect()}
    occurring = np.zeros(max(found, default=-1) + 1, np.int64)
    for i, n in found.items():
        occurring[i] = n
    lengths = huffman.code_lengths(occurring, max_bits)
    spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths.tolist())], "id long, bits int").coalesce(1).write.parquet(f"{folder}/lengths")
    total = int(occurring.sum())
    files = max(1, min(n_shuffle(spark), -(-total // (1 << 20))), -(-total // ids_per_file))
    order = ["doc_id", "key", "row"]
    sorted_ = coded.withColumn("key", F.xxhash64("ids")).repartitionByRange(files, *order).sortWithinPartitions(*order)
    written = in_batches(sorted_, _writer(folder, lengths), "path string, first_doc long, first_key long, first_row long, n_docs long, n_ids long", size=BATCH_BYTES)
    parts = materialize(written, "id-files")
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "first_key", "first_row").rowsBetween(Window.unboundedPreceding, -1)
    index = parts.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))  # a row for each file
    index.select("path", "first", "n_ids", "n_docs").coalesce(1).write.parquet(f"{folder}/index")


class _File:
    def __init__(self, path: str) -> None:
        fs, path = _open(path)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        foot = self._at(size - 32, 32)
        if foot[24:] != MAGIC:
            raise ValueError(f"not a token file: {path}")
        self.n_ids, self.n_docs, self.n_bytes = np.frombuffer(foot[:24], "<i8").tolist()
        self.blocks = -(-self.n_ids // huffman.BLOCK)

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def documents(self) -> tuple[pa.Array, np.ndarray]:
        n, at = self.n_docs, self.n_bytes + 8 * self.blocks
        ids, null = np.frombuffer(self._at(at, 8 * n), "<i8"), np.frombuffer(self._at(at + 8 * n, n), np.uint8)
        return pa.array(ids, mask=null.astype(bool)), np.frombuffer(self._at(at + 9 * n, 8 * n), "<i8")

    def ids(self, begin: int, end: int, codes) -> np.ndarray:
        """Ids of the blocks begin..end, by the bytes between their offsets."""
        count = min(end, self.blocks) - begin
        if count <= 0:
            return np.zeros(0, np.int64)
        offsets = np.frombuffer(self._at(self.n_bytes + 8 * begin, 8 * min(count + 1, self.blocks - begin)), "<i8")
        low = int(offsets[0]) >> 3
        high = self.n_bytes if begin + count >= self.blocks else (int(offsets[-1]) >> 3) + 1
        data = np.frombuffer(self._at(low, high - low), np.uint8)
        return huffman.decode(data, offsets[:count] - 8 * low, min(count * huffman.BLOCK, self.n_ids - begin * huffman.BLOCK), codes)


def _lengths(spark: SparkSession, folder: str) -> np.ndarray:
    rows = spark.read.schema("id long, bits int").parquet(f"{folder}/lengths").collect()  # as many as the vocabulary
    out = np.zeros(len(rows), np.uint8)
    for r in rows:
        out[r.id] = r.bits
    return out


def read_documents(spark: SparkSession, folder: str, blocks: int = 2_048) -> DataFrame:
    """doc_id, start (number of its first id), n_ids, ids (little-endian unsigned 32 bits) of every document.

    ``blocks`` blocks are decoded at once; a document's ids are held until it is whole.
    """
    lengths = _lengths(spark, folder)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = huffman.table(lengths)
        for path, first in (x for b in batches for x in zip(b["path"].to_pylist(), b["first"].to_pylist(), strict=True)):
            file = _File(path)
            docs, sizes = file.documents()
            ends = np.cumsum(sizes)
            given, held, at = 0, [], 0  # documents given, ids held and the number of the first of them
            for begin in range(0, file.blocks, blocks):
                held.append(file.ids(begin, begin + blocks, codes))
                upto = min((begin + blocks) * huffman.BLOCK, file.n_ids)
                to = int(np.searchsorted(ends, upto, side="right"))
                if to == given:
                    continue
                ids = np.concatenate(held)
                n = sizes[given:to]
                cut = np.concatenate([[0], np.cumsum(n)])
                whole = ids[: cut[-1]].astype("<u4").tobytes()
                data = pa.array([whole[4 * a : 4 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([docs[given:to], pa.array(first + at + cut[:-1]), pa.array(n), data], schema=schema)
                held, at, given = [ids[cut[-1] :]], at + int(cut[-1]), to

    return _files(spark, folder).mapInArrow(run, "doc_id long, start long, n_ids long, ids binary")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """The index, a file a task (a few where there are very many)."""
    index = spark.read.schema("path string, first long, n_ids long, n_docs long").parquet(f"{folder}/index")
    return index.repartition(max(1, min(index.count(), 20_000)))


def read_ids(spark: SparkSession, folder: str, begin: int, end: int) -> DataFrame:
    """position, id of the corpus's ids begin..end (the end left out): only blocks that hold some are read."""
    lengths = _lengths(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = huffman.table(lengths)
        for path, first in (x for b in batches for x in zip(b["path"].to_pylist(), b["first"].to_pylist(), strict=True)):
            file = _File(path)
            low, high = max(begin - first, 0), min(end - first, file.n_ids)
            for block in range(low // huffman.BLOCK, -(-high // huffman.BLOCK), 2_048):
                ids = file.ids(block, min(block + 2_048, -(-high // huffman.BLOCK)), codes)
                at = np.arange(len(ids)) + block * huffman.BLOCK
                own = (at >= low) & (at < high)
                yield pa.RecordBatch.from_arrays([pa.array(first + at[own]), pa.array(ids[own])], names=["position", "id"])

    index = spark.read.schema("path string, first long, n_ids long, n_docs long").parquet(f"{folder}/index")
    some = index.filter((F.col("first") < end) & (F.col("first") + F.col("n_ids") > begin))
    return some.mapInArrow(run, "position long, id long")


def folder_for(spark: SparkSession) -> str:
    return scratch(spark, "token-ids")

