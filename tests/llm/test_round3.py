"""Alignment, vector codes and token files against brute force, on odd tables and the registered queries."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import DATA
from tidemark.llm import alignment, huffman, token_files, vector_codes
from tidemark.llm.queries import QUERIES

public = pytest.importorskip("public_tokenizers")
CLASH = ["row", "epoch", "key", "n", "part", "place", "block", "own", "ids", "start", "error"]
DOC = "doc_id long, text string, lang string, source string"


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in CLASH})


TEXTS = [
    None, "", " ", "a", "a b", " a", "a ", "  a  b  ", "a\nb \n c\t\td", "<s> <|endoftext|> </s> <unk>", "x ▁ y", "▁", "naïve café — “quotes” ﬁ é",
    "日本語のテキスト と 英語", "x" * 5000, "= " * 3000, "=" * 3000, "don't we'll I'm", "a b c \u0085 d", "\x00\x01 \x1c x", "word " * 2000, "1234 56,789.0 + 3",
    "a b", "a b", "🙂 🙂🙂 👩‍👩‍👧", " \n", "the the the the", "The THE tHe",
]


# alignment ------------------------------------------------------------------------------


def aligned_brute(rows, kind="ends"):
    """(doc_id, n_a, n_b, n_groups, n_links, groups text, n_best, count_sum), from whole texts, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    # printable bytes for themselves, all others numbered from 256
    back, k = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            back[chr(b)] = b
        else:
            back[chr(256 + k)], k = b, k + 1
    found = []
    for i, text in rows:
        want = (" " + (text or "")).encode()
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        bytes_a = [bytes(back[c] for c in t.id_to_token(x)) for x in a]
        pieces = [sp.id_to_piece(x) for x in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(b, pieces, strict=True)]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            found.append((i, [], [], [], []))
            continue
        spans = lambda ts: [(sum(map(len, ts[:k])), sum(map(len, ts[: k + 1]))) for k in range(len(ts))] if len(ts) < 400 else _spans(ts)
        sa, sb = spans(bytes_a), spans(bytes_b)
        shared = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, p, q = [], 0, 0
        for e in shared:
            ga, gb = [], []
            while p < len(sa) and sa[p][1] <= e:
                ga.append(p)
                p += 1
            while q < len(sb) and sb[q][1] <= e:
                gb.append(q)
                q += 1
            groups.append((ga, gb))
        links = []
        for ga, gb in groups:
            for x in ga:
                for y in gb:
                    overlap = sa[x][0] < sb[y][1] and sb[y][0] < sa[x][1]
                    if kind == "products" or (overlap if kind == "overlaps" else sa[x][1] == sb[y][1]):
                        links.append((a[x], b[y]))
        found.append((i, a, b, [([a[x] for x in ga], [b[y] for y in gb]) for ga, gb in groups], links))
    counts = Counter(pair for *_, links in found for pair in links)
    most: dict = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    for i, a, b, groups, links in found:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield i, len(a), len(b), len(groups), len(links), said, sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links)


def _spans(tokens):
    ends = np.cumsum([len(t) for t in tokens]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


PATHS = [public.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]


@pytest.mark.parametrize("kind", alignment.KINDS)
@pytest.mark.parametrize("epoch", [50, 16_000_000])
def test_alignment(spark, kind, epoch):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a b"), (None, "a b"), (None, None)]
    df = frame(spark, [(i, t, None, None) for i, t in rows])
    got = alignment.align(df.repartition(3), *PATHS, links=kind, epoch_bytes=epoch).select(COLUMNS).collect()
    assert Counter(map(tuple, got)) == Counter(aligned_brute(rows, kind))


def test_alignment_of_nothing(spark):
    assert alignment.align(frame(spark, []), *PATHS).count() == 0
    with pytest.raises(ValueError):
        alignment.align(frame(spark, []), *PATHS, links="none")


def test_alignment_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    want = Counter((*r[:5], sha(r[5]), *r[6:]) for r in aligned_brute(docs))
    names = ["groups_sha256" if c == "groups" else c for c in COLUMNS]
    assert Counter(map(tuple, QUERIES["op11_alignment"](spark, DATA).select(names).collect())) == want


# vector codes ---------------------------------------------------------------------------


def codes_brute(rows, entries, parts=4, rounds=4):
    """Whole scans in every round, with Python's integers. rows: (vec_id, vector, label)."""
    kept = [(i, [math.floor(1024 * x) for x in v], g) for i, v, g in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for _, v, _ in kept] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(x, books[p])[1] for x in cut[p]]
            new = []
            for k, e in enumerate(books[p]):
                mine = [x for x, o in zip(cut[p], own, strict=True) if o == k]
                new.append([sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else e)
            books[p] = new
    found = [[nearest(x, books[p]) for x in cut[p]] for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{found[p][n][1]:02x}" for p in range(parts)), sum(found[p][n][0] for p in range(parts)), g) for n, (i, _, g) in enumerate(kept)], digest


@pytest.mark.parametrize("entries", [1, 5, 16])
def test_vector_codes(spark, entries):
    rng = np.random.default_rng(entries)
    rows = [(i, [float(x) for x in rng.normal(size=12).round(2)], int(i % 3) if i % 5 else None) for i in range(150)]
    rows += [(3, rows[4][1], 0)] * 3 + [(None, rows[5][1], None)] * 60 + [(900 + i, [0.0] * 12, 1) for i in range(60)]
    rows += [(200, None, 1), (201, [], 1), (202, [None] + [0.0] * 11, 1), (203, [float("nan")] * 12, 1), (204, [float("-inf")] * 12, 1), (-1, [40.0] * 12, 2), (205, [-0.0001] * 12, 2)]
    df = frame(spark, rows, "vec_id long, embedding array<double>, label int").repartition(5)
    codes, books = vector_codes.compress(df, entries=entries)
    want, digest = codes_brute(rows, entries)
    assert books.digest() == digest
    got = vector_codes.with_label_errors(codes).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label) for r in got) == Counter(want)
    by_label = Counter()
    for _, _, e, g in want:
        by_label[g] += e
    assert all(r.label_error == by_label[r.label] for r in got)


def test_vector_codes_of_few_and_wide_values(spark):
    schema = "vec_id long, embedding array<double>, label string"
    codes, _ = vector_codes.compress(frame(spark, [], schema))
    assert codes.count() == 0
    wide = [(i, [1e4 * (i % 7), -1e4 * i, 0.5, 1e4], "a") for i in range(40)] + [(99, [1.0] * 8, "b")]  # another length takes no part
    codes, books = vector_codes.compress(frame(spark, wide, schema), entries=8)
    want, digest = codes_brute(wide[:40], 8)
    assert books.digest() == digest and Counter(map(tuple, codes.collect())) == Counter(want)
    with pytest.raises(ValueError):
        vector_codes.compress(frame(spark, [(1, [1.0] * 5, "a")], schema))


def test_heaps_pop_what_the_drift_violates():
    rng = np.random.default_rng(0)
    own, keys = rng.integers(0, 7, 500), rng.normal(size=500)
    h = vector_codes.Heaps.of(own, keys, 8)
    for _ in range(5):
        drift = rng.normal(size=8)
        out = h.pop(drift)
        assert sorted(out.tolist()) == np.flatnonzero(keys <= drift[own]).tolist()
        own[out], keys[out] = rng.integers(0, 8, len(out)), rng.normal(size=len(out)) + 1
        h.push(out, own[out], keys[out])
        h = vector_codes.Heaps(*h.closed())


def test_few_parts_are_scanned_again():
    """Bounds do their work: on grouped vectors a late round pops few parts."""
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(16, 8)) * 4000).astype(np.int64)[rng.integers(0, 16, 4000)] + rng.integers(-50, 50, (4000, 8))
    books = vector_codes.Codebooks([x[:16].copy()], [np.zeros(16)])
    own, slack = vector_codes.scan(x, books.values[0])
    heaps, popped = vector_codes.Heaps.of(own, slack, 16), []
    for _ in range(6):
        new = np.array([x[own == k].sum(0) // max(1, (own == k).sum()) if (own == k).any() else books.values[0][k] for k in range(16)])
        books = books.moved([new])
        out = heaps.pop(books.drift[0])
        found, slack = vector_codes.scan(x[out], new)
        heaps.push(out, found, slack + books.drift[0][found])
        own[out] = found
        assert (own == vector_codes.distances(x, new).argmin(1)).all()
        popped.append(len(out))
    assert popped[-1] < 0.2 * len(x)


# components -----------------------------------------------------------------------------


@pytest.mark.parametrize("shape", ["stars", "path", "random", "none"])
def test_components_by_few_rounds(spark, shape, monkeypatch):
    """Edges that are stars take no round, others none to see that nothing changes."""
    from tidemark.llm import components as module

    rng = np.random.default_rng(1)
    edges = {"stars": [(k // 10 * 10, k) for k in range(40)], "path": [(k + 1, k) for k in range(30)], "random": rng.integers(0, 60, (45, 2)).tolist(), "none": []}[shape]
    written, materialize = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, tag: written.append(tag) or materialize(df, tag))
    got = {r.node: r.root for r in module.components(spark.createDataFrame([(int(a), int(b)) for a, b in edges] * 2, "a long, b long")).collect()}
    low = {x: x for a, b in edges if a != b for x in (a, b)}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert got == low
    assert shape in ("path", "random") or written == ["edges"]
    assert len(written) <= 11


# token files ----------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "bits"), [(1, 20), (2, 1), (5, 3), (300, 9), (300, 20)])
def test_huffman(n, bits):
    rng = np.random.default_rng(n)
    counts = np.maximum(1, (1e5 / np.arange(1, n + 1) ** 2).astype(np.int64))
    lengths = huffman.code_lengths(np.concatenate([[0], counts, [0]]), bits)
    assert lengths[0] == lengths[-1] == 0 and lengths.max() <= bits and sum(2.0 ** -int(b) for b in lengths if b) <= 1
    if bits == 20 and n > 2:  # unlimited: as heavy as a plain Huffman tree
        heap = sorted(counts.tolist())
        cost = 0
        while len(heap) > 1:
            a, b, *heap = heap
            cost += a + b
            heap = sorted([*heap, a + b])
        assert int((lengths[1:-1] * counts).sum()) == cost
    ids = rng.integers(1, n + 1, 3 * huffman.BLOCK + 17)
    w = huffman.Writer(lengths)
    cuts = [0, 1, 7, 300, 300, len(ids)]
    data = np.frombuffer(b"".join(w.add(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)) + w.close(), np.uint8)
    codes, at = huffman.table(lengths), w.checkpoints()
    assert huffman.decode(data, at, len(ids), codes).tolist() == ids.tolist()
    assert huffman.decode(data, at[1:3], 2 * huffman.BLOCK, codes).tolist() == ids[huffman.BLOCK : 3 * huffman.BLOCK].tolist()
    canonical = huffman.canonical(lengths)
    said = sorted(format(int(c), f"0{b}b") for c, b in zip(canonical, lengths, strict=True) if b)
    assert all(not y.startswith(x) for x, y in zip(said, said[1:], strict=False))
    with pytest.raises(ValueError):
        w.add(np.array([0]))


def test_huffman_needs_room():
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5, np.int64), 2)
    assert not huffman.code_lengths(np.zeros(4, np.int64)).any()


def token_brute(rows, file="word_bpe_49k.json"):
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(public.path(file)), 0
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        yield i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids
        at += len(ids)


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("per_file", [40, 1 << 25])
def test_token_files(spark, file, per_file):
    rows = [(7 * k % 1000 - 50, t) for k, t in enumerate(TEXTS * 3)]
    folder = token_files.folder_for(spark)
    odd = [(None, "first of all"), *rows]
    token_files.write(frame(spark, [(i, t, None, None) for i, t in odd]).repartition(3), public.path(file), 1, folder, ids_per_file=per_file)
    index = spark.read.parquet(f"{folder}/index").collect()
    assert len(index) > 3 or per_file > 40
    got = token_files.read_documents(spark, folder, blocks=3).orderBy("start").collect()
    want = list(token_brute([odd[0], *sorted(rows)], file))
    assert [(r.doc_id, r.start, r.n_ids, zlib.crc32(r.ids)) for r in got] == [w[:4] for w in want]
    flat = [x for w in want for x in w[4]]
    for a, b in ((0, 1), (len(flat) // 3, len(flat) // 3 + 700), (len(flat) - 5, len(flat) + 9), (5, 5)):
        some = token_files.read_ids(spark, folder, a, b).orderBy("position").collect()
        assert [(r.position, r.id) for r in some] == list(enumerate(flat))[a:b]


def test_token_files_of_repeated_ids_and_of_nothing(spark):
    rows = [(1, "a b"), (1, "c"), (1, "a b"), (0, None)]
    folder = token_files.folder_for(spark)
    token_files.write(frame(spark, [(i, t, None, None) for i, t in rows]), public.path("word_bpe_49k.json"), 1, folder)
    got = token_files.read_documents(spark, folder).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_ids) for r in got) == {(1, 3): 2, (1, 2): 1, (0, 1): 1} and got[0].doc_id == 0
    assert [r.start for r in got] == np.cumsum([0, *[r.n_ids for r in got[:-1]]]).tolist()
    folder = token_files.folder_for(spark)
    token_files.write(frame(spark, []), public.path("word_bpe_49k.json"), 1, folder)
    assert token_files.read_documents(spark, folder).count() == 0


def test_token_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    got = QUERIES["op13_token_ids"](spark, DATA).orderBy("start").collect()
    assert [tuple(r) for r in got] == [w[:4] for w in token_brute(docs)]


def test_known_words_are_cut_at_once():
    """No Python call for each word of a group whose words are known; ids as from the library."""
    import sys

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    odd = ["İstanbul", "ȺB Ɓa Ɇf", "ſtraße STRASSE", "\u212Aelvin", "ΑΣ ΑΣΑ", "don't DON'T 'LL", "a\x1cb\x85c\xa0d", "x²³ 12.5", "", " \n ", "ÀÉ\u0301"]
    odd += [f"{a}{t}{b}" for t in added for t in (t, t.upper(), t.lower()) for a, b in (("", ""), ("x", "y "), (" ", "'s"))]
    texts = [*odd, " ".join(f"w{k}x{k * 7919 % 1000}" for k in range(5000)), "of words"]
    encode = token_files.WordEncoder(whole)
    for _ in range(2):
        calls = 0

        def count(frame, event, arg):
            nonlocal calls
            calls += event in ("call", "c_call")

        sys.setprofile(count)
        ids, n = encode(pa.chunked_array([pa.array(texts)]))
        sys.setprofile(None)
        want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert calls < 2_000
    assert [x.tolist() for x in encode(pa.chunked_array([pa.array(["", " "])]))] == [[], [0, 0]]


# rulers ---------------------------------------------------------------------------------


@pytest.mark.parametrize("file", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_rulers_come_from_the_fold(spark, file):
    """Runs of one character and of short patterns: all windows share a token, so none is left to the heap."""
    from tidemark.llm import bpe

    rank = bpe.ranks(public.path(file))
    size = np.zeros(max(rank.values()) + 1, np.int64)
    for token, i in rank.items():
        size[i] = len(token)
    rulers = [bytes([c]) * n for c in b"=-_*#.~+" for n in (5000, 4999, 3001)] + [p * 1201 for p in (b"=-", b"abc", b"-+-", b"haha", "—".encode())]
    for w in rulers:
        whole = bpe.stitched([np.array(bpe.long_word(x, rank)) for x in bpe.windows(w)], size)
        assert whole is not None and whole.tolist() == bpe.long_word(w, rank)


def test_toxicity_over_all_held_out_labels(spark):
    """Of all held-out texts labelled toxic, those without a toxic word among them, at least 9 of 14 are found."""
    data = f"{DATA}/../sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.toxic is not None}
    own = [(r.predicted, truth[r.doc_id]) for r in QUERIES["op3_toxicity"](spark, data).collect() if r.held_out and r.doc_id in truth]
    toxic = [p for p, t in own if t]
    assert len(toxic) == 14 and sum(toxic) >= 9
    assert sum(p for p, t in own if not t) <= 1


def test_tokenize_plan_does_not_print_the_vocabulary(spark):
    """The driver keeps a plan's text for each step of adaptive execution, several times."""
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some words, é and 世界"), (2, None)], "doc_id long, text string")
    plan = corpus_pipeline.tokenize(spark, docs, "")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    assert len(plan._jdf.queryExecution().explainString(mode)) < 50_000
    texts = {1: "some words, é and 世界", 2: ""}
    assert {r.doc_id: r.decoded_sha256 for r in plan.collect()} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()}
