"""Byte-level BPE encoding and decoding.

Encoding:

1. Cutting. A task cuts its texts by the tokenizer's pattern and brings them to distinct words,
   in epochs of about EPOCH_BYTES of text, which bounds memory. An epoch leaves its documents as
   streams of word numbers, packed, and its distinct words in buckets by hash. One shuffle takes
   the words to their buckets and each stream to a place of its epoch.
2. Folding. A bucket gathers the words of all epochs, so every word of the corpus is folded once.
   Spark higher-order functions fold the ranked merges over the word's byte array: the state holds
   its pieces, at first single bytes, and the rank of every neighbouring pair; a step joins the
   leftmost pair of lowest rank and looks up the two new pairs. Ranks come from a literal map of
   byte strings, dealt into many small maps by hash because a lookup in one Spark map is a scan.
3. Each epoch gets the ids of its words back from the buckets and lays them along its streams.
   Only vocabularies and packed streams move, never texts, and the streams move once: step 2 and
   this one read the same shuffle, so its rows go to both unfiltered and with all columns.

Words of over WINDOW bytes, on which the fold's copies would cost the square of the length, are
folded as overlapping windows. Windows are joined at a token that both have at the same place:
merges on the two sides of a boundary that no merge crosses don't depend on each other, so a
sequence of tokens is the word's encoding if each neighbouring two are neighbours in an encoding
of some stretch. Should two windows share no token, the word's merges are made by a heap instead;
in the same order, with the same ids.

Cutting takes a short way for the patterns in SPACED: a space between two characters that aren't
white space always begins a piece and no piece crosses it, so texts are first split there, and
the pattern runs over distinct parts only. For other patterns it runs over whole texts.

Decoding concatenates the ids' byte strings.

Defined cases: null texts count as empty and give no ids; an unknown or null id in decoding
is an error. Repeated rows are separate. Extra columns are ignored. The vocabulary's path
is a parameter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import cache
from weakref import WeakKeyDictionary
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import in_batches, n_shuffle

SLOTS = 65_536
#: 960 is a multiple of the lengths of the tokens that runs of one character merge into (16, 32, 48, 64, ...),
#: so the windows of a ruler break at the same places.
WINDOW, STRIDE = 1_440, 960
EPOCH_BYTES = 16_000_000
CHUNK_BYTES, ROW_WORDS = 2_000_000, 4_096
#: Fixed value: the pattern for which cutting at single spaces is right.
SPACED = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}
_declared: WeakKeyDictionary[SparkSession, set[str]] = WeakKeyDictionary()


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _variable(spark: SparkSession, kind: str, path: str, sql_type: str, rows: DataFrame | None, value: str) -> Column:
    """A session variable, set once in a session. Optimised plans hold its value as a literal."""
    name = f"bpe_{kind}_" + hashlib.md5(path.encode()).hexdigest()[:12]
    made = _declared.setdefault(spark, set())
    if name not in made:
        rows.createOrReplaceTempView(f"{name}_rows")
        spark.sql(f"declare or replace variable {name} {sql_type}")
        spark.sql(f"set var {name} = (select {value} from {name}_rows)")
        spark.catalog.dropTempView(f"{name}_rows")
        made.add(name)
    return F.expr(name)


def _vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token, id: bounded by the vocabulary's file."""
    rank = ranks(path)
    return spark.createDataFrame(pa.table({"token": pa.array(list(rank), pa.binary()), "id": pa.array(list(rank.values()), pa.int32())}))


def rank_map(spark: SparkSession, path: str) -> Column:
    """Literal: the ranks of all tokens, in SLOTS small maps by hash."""
    slot = F.xxhash64("token").bitwiseAND(F.lit(SLOTS - 1).cast("long"))
    small = _vocabulary(spark, path).groupBy(slot.alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("m"))
    slots = spark.range(SLOTS).select(F.col("id").alias("b")).join(small, "b", "left")
    in_order = "transform(array_sort(collect_list(struct(b, coalesce(m, cast(map() as map<binary,int>)) as m)), (x, y) -> cast(x.b - y.b as int)), s -> s.m)"
    return _variable(spark, "ranks", path, "array<map<binary,int>>", slots, in_order)


def pieces(spark: SparkSession, path: str) -> Column:
    """Literal: the byte string of each id (null for numbers that aren't ids), as array_join takes them.

    Cast before it is set: a cast literal would be folded, and its 50,000 strings printed in every plan.
    """
    some = _vocabulary(spark, path)
    all_ids = spark.range(max(ranks(path).values()) + 1).select(F.col("id").cast("int").alias("id")).join(some, "id", "left")
    in_order = "transform(array_sort(collect_list(struct(id, token)), (x, y) -> x.id - y.id), s -> cast(s.token as string))"
    return _variable(spark, "pieces", path, "array<string>", all_ids, in_order)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(word: Column, table: Column) -> Column:
    """The ids of one word (its byte array): a fold of ranked merges.

    The state's p holds the word's pieces, r the rank of each pair of neighbours (null if the two
    joined are no token): r[k] belongs to p[k - 1] and p[k], so r is null at both ends; j is the
    place in r of the first least rank. A step puts the joined piece x in place of its two.
    """

    def rank(b: Column) -> Column:
        return F.try_element_at(F.get(table, F.xxhash64(b).bitwiseAND(F.lit(SLOTS - 1).cast("long")).cast("int")), b)

    def state(p: Column, r: Column) -> Column:
        return _let(r, lambda q: F.struct(p.alias("p"), q.alias("r"), F.array_position(q, F.array_min(q)).cast("int").alias("j")))

    n = F.octet_length(word)
    singles = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(0), n), lambda i: F.when((i > 0) & (i < n), rank(F.substring(word, i, F.lit(2)))))

    def step(s: Column, _: Column) -> Column:
        p, r, j = s["p"], s["r"], s["j"]

        def join(x: Column) -> Column:
            two = F.array(rank(F.concat(F.get(p, j - 3), x)), rank(F.concat(x, F.get(p, j))))
            return state(
                F.concat(F.slice(p, F.lit(1), j - 2), F.array(x), F.slice(p, j + 1, n)),
                F.concat(F.slice(r, F.lit(1), j - 2), two, F.slice(r, j + 2, n)),
            )

        return F.when(j.isNull(), s).otherwise(_let(F.concat(F.get(p, j - 2), F.get(p, j - 1)), join))

    steps = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    return F.aggregate(steps, state(singles, pairs), step, lambda s: F.transform(s["p"], rank))


def long_word(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The same merges by a heap: leftmost pair of lowest rank first."""
    n = len(word)
    end = list(range(1, n + 1))  # part starting at i ends at end[i]
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = end[i] if i < n else n
        if not alive[i] or j >= n or end[j] != to or not alive[j]:
            continue
        alive[j], end[i] = False, to
        if to < n:
            before[to] = i
            if (r := rank.get(word[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (h := before[i]) >= 0 and (r := rank.get(word[h:to])) is not None:
            heapq.heappush(heap, (r, h, to))
    return [rank[word[i : end[i]]] for i in range(n) if alive[i]]


def windows(word: bytes) -> list[bytes]:
    """A word's overlapping windows: each begins STRIDE after the last one."""
    return [word[i : i + WINDOW] for i in range(0, max(1, len(word) - WINDOW + STRIDE), STRIDE)]


def stitched(parts: list[np.ndarray], size: np.ndarray) -> np.ndarray | None:
    """The ids of a word from those of its windows; None if two windows share no token.

    size: bytes of each id.
    """
    whole, ends = parts[0], np.cumsum(size[parts[0]])
    for k, ids in enumerate(parts[1:], 1):
        to = k * STRIDE + np.cumsum(size[ids])
        # A token is the same if its id and its end are.
        both, left, right = np.intersect1d(ends, to, assume_unique=True, return_indices=True)
        same = np.flatnonzero(whole[left] == ids[right])
        if not len(same):
            return None
        m = same[len(same) // 2]
        whole = np.concatenate([whole[: left[m] + 1], ids[right[m] + 1 :]])
        ends = np.concatenate([ends[: left[m] + 1], to[right[m] + 1 :]])
    return whole


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of small numbers as compressed bytes, the four bytes of a number apart."""
    out = [np.int64(len(a)).tobytes() + np.ascontiguousarray(np.asarray(a, np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    return squeezed(b"".join(out))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw, at, out = loose(data), 0, []
    while at < len(raw):
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        planes = np.frombuffer(raw, np.uint8, 4 * n, at + 8).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64))
        at += 8 + 4 * n
    return out


def squeezed(raw: bytes) -> bytes:
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def loose(data: bytes) -> bytes:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return pa.decompress(data[8:], n, codec="zstd", asbytes=True) if n else b""


def split_spaces(texts: pa.Array, parts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' parts as numbers in ``parts``, which grows; how many each text has.

    No piece of a pattern in SPACED crosses parts.
    """
    lists = pc.split_pattern(texts, " ")
    full = pc.list_value_length(lists).to_numpy()
    count = np.where(pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 0, full)
    coded = lists.flatten().dictionary_encode()
    names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    at = at[np.repeat(count > 0, full)]
    # Beginning and end of a part: not white space.
    head, tail = np.ones(len(names), bool), np.ones(len(names), bool)
    for k in [k for k, x in enumerate(names) if not x or x[0].isspace() or x[-1].isspace()]:
        x = names[k]
        head[k], tail[k] = bool(x) and not x[0].isspace(), bool(x) and not x[-1].isspace()
    first = np.zeros(len(at), bool)
    first[(np.cumsum(count) - count)[count > 0]] = True
    new = first.copy()
    if len(at):
        new[1:] |= tail[at[:-1]] & head[at[1:]]
    begins = np.flatnonzero(new)
    length = np.diff(np.append(begins, len(at)))
    number = np.full((2, len(names)), -1, np.int32)  # of each part within a text, and as its first
    for k in (0, 1):
        for i in np.unique(at[begins[(length == 1) & (first[begins] == k)]]).tolist():
            number[k, i] = parts.setdefault(names[i] if k else " " + names[i], len(parts))
    stream = number[first[begins].astype(np.int8), at[begins]]
    for k in np.flatnonzero(length > 1).tolist():  # parts that belong together
        b = begins[k]
        x = " ".join([names[i] for i in at[b : b + length[k]]])
        stream[k] = parts.setdefault(x if first[b] else " " + x, len(parts))
    owner = np.repeat(np.arange(len(count)), count)[begins]
    return stream, np.bincount(owner, minlength=len(count))


def whole_texts(texts: pa.Array, parts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Like split_spaces, with each text as one part."""
    return np.array([parts.setdefault(t, len(parts)) for t in texts.to_pylist()], np.int32), np.ones(len(texts), np.int64)


CUT = "key long, epoch long, seq int, ids array<{kind}>, data binary, words binary"


def _cut(pattern: str, buckets: int, epoch_bytes: int, chunk_bytes: int, kind: pa.DataType):
    """Rows with words: those of an epoch in bucket -1 - key. Rows with data, key is the epoch: at
    seq -1 the words of each part and the windows of long words, then runs of documents (ids) as
    part numbers."""
    schema = pa.schema([("key", pa.int64()), ("epoch", pa.int64()), ("seq", pa.int32()), ("ids", pa.list_(kind)), ("data", pa.binary()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        epoch = TaskContext.get().partitionId() << 32
        split = split_spaces if pattern in SPACED else whole_texts

        def row(seq: int, ids=None, data=None, words=None) -> pa.RecordBatch:
            key = epoch if words is None else -1 - seq
            cols = [[key], [epoch], [seq], [ids], [data], [words]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        def out(ids: list, streams: list[np.ndarray], counts: list[np.ndarray], parts: dict[str, int]) -> Iterator[pa.RecordBatch]:
            # Frequent parts get small numbers, which pack better.
            used = np.zeros(len(parts), np.int64)
            for stream in streams:
                used += np.bincount(stream, minlength=len(parts))
            by_use = np.empty(len(parts), np.int64)
            ranked = np.argsort(-used, kind="stable")
            by_use[ranked] = np.arange(len(parts))
            names = list(parts)
            parts.clear()
            words: dict[str, int] = {}
            flat, part_ends = array("i"), array("i")
            for p in [names[k] for k in ranked.tolist()]:
                flat.extend([words.setdefault(w, len(words)) for w in find(p)])
                part_ends.append(len(flat))
            del names
            coded = [w.encode() for w in words]
            words.clear()
            long = [k for k, w in enumerate(coded) if len(w) > WINDOW]
            folded = dict.fromkeys(w for w in coded if len(w) <= WINDOW)
            for k in long:
                folded.update(dict.fromkeys(windows(coded[k])))
            names = list(folded)
            for k, w in enumerate(names):
                folded[w] = k
            # A part's words: 0 for the next new one, else its number and 1. Long words come after all others.
            number = np.array([folded.get(w, -1) for w in coded], np.int64)
            number[long] = len(names) + np.arange(len(long))
            cut = [[folded[x] for x in windows(coded[k])] for k in long]
            folded.clear()
            bucket = np.array([crc32(w) % buckets for w in names], np.int64)
            order = np.argsort(bucket, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                own = [names[k] for k in some.tolist()]
                yield row(int(bucket[some[0]]), words=squeezed(np.int64(len(own)).tobytes() + np.array([len(w) for w in own], np.int32).tobytes() + b"".join(own)))
            flat_words = number[np.array(flat, np.int32)]
            new = np.zeros(len(flat_words), bool)
            new[np.unique(flat_words, return_index=True)[1]] = True
            in_turn = len(names) == len(coded) and not long  # no windows among the numbers
            marked = np.where(new, 0, flat_words + 1) if in_turn else flat_words + 1
            flat_cut = np.array([x for c in cut for x in c], np.int64)
            yield row(-1, data=packed(bucket, np.diff(np.array(part_ends), prepend=0), marked, np.array([len(c) for c in cut]), flat_cut))
            for seq, (i, stream, count) in enumerate(zip(ids, streams, counts, strict=True)):
                yield row(seq, ids=i.to_pylist(), data=packed(count, by_use[stream]))

        ids, streams, counts, parts, held = [], [], [], {}, 0
        for b in batches:
            texts = b["text"].fill_null("")
            length = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
            at = 0
            while at < len(b):  # texts of a bounded size at once
                begin = length[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(length, begin + chunk_bytes, side="right")))
                stream, count = split(texts.slice(at, to - at), parts)
                ids.append(b["doc_id"].slice(at, to - at))
                streams.append(stream)
                counts.append(count)
                held += int(length[to - 1] - begin)
                at = to
                if held >= epoch_bytes:
                    yield from out(ids, streams, counts, parts)
                    ids, streams, counts, parts, held, epoch = [], [], [], {}, 0, epoch + 1
        if ids:
            yield from out(ids, streams, counts, parts)

    return run


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's words, each once; its last row tells which of them each epoch has (back)."""
    schema = pa.schema([("bucket", pa.int32()), ("turn", pa.int32()), ("words", pa.list_(pa.binary())), ("back", pa.binary())])

    def out(bucket: int, rows: list) -> Iterator[pa.RecordBatch]:
        columns, counts = [], []
        for _, data in rows:
            raw = loose(data)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            ends = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int32, n, 8))]).astype(np.int32)
            columns.append(pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(raw[8 + 4 * n :])]))
            counts.append(n)
        coded = pa.concat_arrays(columns).dictionary_encode()
        epochs = np.array([e for e, _ in rows])
        back = packed(epochs >> 32, epochs & 0xFFFFFFFF, counts, coded.indices.to_numpy())
        names = coded.dictionary
        for lo in range(0, len(names), ROW_WORDS):
            some = names.slice(lo, ROW_WORDS)
            last = lo + ROW_WORDS >= len(names)
            lists = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), pa.concat_arrays([some]))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([lo // ROW_WORDS], pa.int32()), lists, pa.array([back if last else None], pa.binary())], schema=schema)

    bucket, rows = None, []
    for b in batches:
        for k, epoch, data in zip(b["key"].to_pylist(), b["epoch"].to_pylist(), b["words"], strict=True):
            if not data.is_valid:
                continue
            if k != bucket and rows:
                yield from out(-1 - bucket, rows)
                rows = []
            bucket = k
            rows.append((epoch, data.as_py()))
    if rows:
        yield from out(-1 - bucket, rows)


class _Lists:
    """Ragged array of ids."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values, self.ends = np.asarray(values, np.int32), np.cumsum(sizes, dtype=np.int64)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists ``rows`` one after the other, and where each ends."""
        if not len(rows):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        begins = np.concatenate([[0], self.ends[:-1]])[rows]
        size = self.ends[rows] - begins
        to = np.cumsum(size)
        return self.values[np.arange(to[-1]) + np.repeat(begins - (to - size), size)], to


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The folded words of a bucket, back to their epochs."""
    values, sizes = [], []
    for b in batches:
        for r in range(len(b)):
            values.append(b["values"][r].values.to_numpy())
            sizes.append(b["sizes"][r].values.to_numpy())
            if not b["back"][r].is_valid:
                continue
            task, epoch, count, index = unpacked(b["back"][r].as_py())
            all_sizes = np.concatenate(sizes)
            lists = _Lists(np.concatenate(values), all_sizes)
            values, sizes, lo, data = [], [], 0, []
            for n in count:
                rows = index[lo : lo + n]
                data.append(packed(all_sizes[rows], lists.take(rows)[0]))
                lo += n
            bucket = np.full(len(count), b["bucket"][r].as_py())
            yield pa.RecordBatch.from_arrays([pa.array((task << 32) + epoch), pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], ["key", "seq", "data"])


def _assemble(rank: dict[bytes, int], kind: pa.DataType):
    def table(data: bytes, dealt: list[bytes]) -> _Lists:
        """The ids of each part of the epoch."""
        bucket, part_sizes, marked, long_sizes, long_windows = unpacked(data)
        pairs = [unpacked(x) for x in dealt]
        words = _Lists(np.concatenate([np.zeros(0, np.int64), *[v for _, v in pairs]]), np.concatenate([np.zeros(0, np.int64), *[s for s, _ in pairs]]))
        place = np.empty(len(bucket), np.int64)  # from buckets back to the order of numbers
        place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
        flat, ends = words.take(place)
        sizes = np.diff(ends, prepend=0)
        if len(long_sizes):
            token = {r: t for t, r in rank.items()}
            size = np.zeros(max(token) + 1, np.int64)
            size[list(token)] = [len(t) for t in token.values()]
            own = np.split(flat, ends[:-1])
            found, lo = [], 0
            for n in long_sizes.tolist():
                cut = [own[w] for w in long_windows[lo : lo + n].tolist()]
                whole = stitched(cut, size)
                if whole is None:
                    text = [b"".join([token[i] for i in ids.tolist()]) for ids in cut]
                    whole = np.array(long_word(b"".join([t[:STRIDE] for t in text[:-1]]) + text[-1], rank))
                found.append(whole)
                lo += n
            flat, sizes = np.concatenate([flat, *found]), np.concatenate([sizes, [len(f) for f in found]])
        new = marked == 0
        number = np.where(new, np.cumsum(new) - 1, marked - 1)
        ids, stops = _Lists(flat, sizes).take(number)
        return _Lists(ids, np.diff(np.concatenate([[0], np.concatenate([[0], stops])[np.cumsum(part_sizes)]])))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        schema = pa.schema([("doc_id", kind), ("ids", pa.list_(pa.int32()))])
        if left["data"].null_count:  # words
            return schema.empty_table()
        left, right = left.sort_by("seq"), right.sort_by("seq")
        parts, out = table(left["data"][0].as_py(), right["data"].to_pylist()), []
        for ids, data in zip(left["ids"][1:], left["data"][1:], strict=True):
            count, stream = unpacked(data.as_py())
            flat, stops = parts.take(stream)
            bounds = np.concatenate([[0], np.concatenate([[0], stops])[np.cumsum(count)]])
            out.append(pa.RecordBatch.from_arrays([ids.values.cast(kind), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))], schema=schema))
        return pa.Table.from_batches(out, schema)

    return run


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    epoch_bytes: int = EPOCH_BYTES,
) -> DataFrame:
    """doc_id, ids (array<int>) for every row of docs."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    n = 2 * n_shuffle(spark)
    cut = in_batches(slim, _cut(pattern, n, epoch_bytes, min(epoch_bytes, CHUNK_BYTES), arrow), CUT.format(kind=name)).repartition(n, "key")
    distinct = in_batches(cut.sortWithinPartitions("key", "epoch"), _distinct, "bucket int, turn int, words array<binary>, back binary")
    # The literal stands once in the plan, whose text the driver keeps for each stage.
    folded = _let(rank_map(spark, path), lambda table: F.transform("words", lambda w: fold(w, table)))
    coded = distinct.select("bucket", "turn", "back", folded.alias("coded"))
    flat = coded.select("bucket", "turn", "back", F.transform("coded", F.size).alias("sizes"), F.flatten("coded").alias("values"))
    # A stage of its own, so that an executor holds one Python worker a core.
    ready = flat.repartition(n, "bucket").sortWithinPartitions("bucket", "turn")
    dealt = in_batches(ready, _deal, "key long, seq int, data binary")
    return cut.groupBy("key").cogroup(dealt.groupBy("key")).applyInArrow(_assemble(ranks(path), arrow), f"doc_id {name}, ids array<int>")


def decode(ids: Column, spark: SparkSession, path: str) -> Column:
    """The bytes of an ids column: the ids' byte strings one after the other."""
    table = pieces(spark, path)
    unknown = F.raise_error(F.lit("an id is not in the vocabulary")).cast("string")
    return F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(table, i), unknown)), "").cast("binary")
