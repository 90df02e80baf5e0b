"""Each operator against brute force, on small tables with nulls, ties, repeats and odd columns."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, exact_dedup, gbt, language, line_dedup, mixing, near_dedup, quality, toxicity, warc

#: Extra columns named like the operators' own.
CLASH = ["row", "node", "n", "kept", "keep_id", "rank", "__id", "__gone", "size", "key"]
DOC = "doc_id long, text string, lang string, source string"


def frame(spark, rows, schema=DOC):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("x") for c in CLASH})


def docs_of(spark, texts, first=0):
    return frame(spark, [(first + i, t, "en", "s") for i, t in enumerate(texts)])


ODD = [None, "", " ", "a", "a  b", "a\tb", "a b ", "A b", "a b", None, "x" * 5000, "é b", "one two three four five six", "one two  three four five six"]


def test_exact(spark):
    rows = [(i, t, None, None) for i, t in enumerate(ODD)] + [(3, "a", None, None), (None, "a", None, None), (None, "only", None, None)]
    got = exact_dedup.exact_groups(frame(spark, rows).repartition(5), fan_in=2).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    want = {hashlib.sha256(t.encode()).hexdigest(): (min((x for x in ids if x is not None), default=None), len(ids)) for t, ids in groups.items()}
    assert len(got) == len(rows)
    for h, (keep, n) in want.items():
        mine = [r for r in got if r.text_sha256 == h]
        assert len(mine) == n and {(r.keep_id, r.group_size) for r in mine} == {(keep, n)} and sum(r.kept for r in mine) == 1
    left = exact_dedup.drop_copies(frame(spark, rows))
    assert left.count() == len(groups) and left.columns == frame(spark, rows).columns
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


@pytest.mark.parametrize("min_run", [1, 2, 3, 4])
def test_lines(spark, min_run):
    rng = random.Random(min_run)
    texts = ["\n".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(40)] + [None, "", "\n\n\n", "z", "z"]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, texts), min_run).collect()}
    seen, want = set(), {}
    for i, t in enumerate(texts):
        lines = [] if t is None else t.split("\n")
        gone = set()
        for k in range(len(lines) - min_run + 1):
            w = tuple(lines[k : k + min_run])
            if w in seen:
                gone |= set(range(k, k + min_run))
            seen.add(w)
        want[i] = (len(lines), len(gone), None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    assert {i: (r.n_lines, r.n_deleted, r.text) for i, r in got.items()} == want
    assert line_dedup.dedup_lines(frame(spark, []), min_run).count() == 0


def test_long_lines(spark):
    long, short = " ".join(f"w{i}" for i in range(60)), "a b c"
    texts = [long, f"x\n{long}\ny", f"{short}\np\nq", f"{short}\nr\np\nq", long, f"u\n{long}\nv\n {long}\n{long}", short, None, ""]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, texts), long_words=50).collect()}
    want = [long, "x\ny", f"{short}\np\nq", f"{short}\nr", "", f"u\nv\n {long}", short, None, ""]
    assert [got[i].text for i in range(len(texts))] == want
    assert [got[i].n_deleted for i in range(len(texts))] == [0, 1, 0, 2, 1, 2, 0, 0, 0]


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    return ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}) if w else set()


def near_brute(texts, percent):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("percent", [80, 85])
def test_near(spark, percent):
    rng = random.Random(percent)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = list(ODD)
    for _ in range(40):
        base = [word() for _ in range(rng.randint(8, 120))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    hot = [word() for _ in range(300)]
    for _ in range(150):  # one large group, denser than a tree's window
        copy = list(hot)
        copy[rng.randrange(300)] = word()
        texts.append("  ".join(copy).upper())
    got = {r.doc_id: r for r in near_dedup.near_groups(docs_of(spark, texts), percent).collect()}
    roots, sizes = near_brute(texts, percent)
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (roots[i] == i) for i in range(len(texts)))
    left = near_dedup.drop_near_copies(docs_of(spark, texts), percent)
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == sorted(set(roots))
    assert near_dedup.near_groups(frame(spark, [])).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_near_hub(spark, percent):
    """Copies that each link to one text but not to each other, in regions far denser than a window."""
    rng = random.Random(1000 + percent)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    hub = [word() for _ in range(600)]
    texts = []
    for _ in range(1000):
        copy = list(hub)
        for at in rng.sample(range(600), 9):
            copy[at] = word()
        texts.append(" ".join(copy))
    texts.insert(500, " ".join(hub))
    far = list(hub)  # in the same regions, but linked with nothing
    for at in range(0, 600, 30):
        far[at] = word()
    texts.append(" ".join(far))
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs_of(spark, texts), percent).collect()}
    assert [got[i] for i in range(len(texts))] == [0] * 1001 + [1001]


def test_near_candidates_over_short_partitions(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**32, (40, near_dedup.VALUES), dtype=np.uint64)
    sig = np.repeat(base, rng.integers(1, 33, 40), axis=0)
    sig[:, 8:] = np.where(rng.random(sig[:, 8:].shape) < 0.05, 7, sig[:, 8:])
    rows = [(i + 1, bytearray(x.astype(near_dedup.BIG).tobytes())) for i, x in enumerate(sig)]
    nodes = spark.createDataFrame(rows, "node long, signature binary")
    want = {(i + 1, j + 1) for i in range(len(sig)) for j in range(i + 1, len(sig)) if any((sig[i, o[:4]] == sig[j, o[:4]]).all() for o in near_dedup.ORDERS)}
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for part_rows in (4000, 30):
            got = {(r.a, r.b) for r in near_dedup.candidates(nodes, part_rows=part_rows).collect()}
            assert want <= got and len(got) <= len(want) + 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_near_template(spark, parts):
    """A region whose pairs are alike but, save for 150 pairs, not linked; also over partitions without rows."""
    rng = random.Random(844)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    template, texts = [word() for _ in range(844)], []
    for _ in range(150):
        own = [word() for _ in range(200)]
        other = list(own)
        for at in rng.sample(range(200), 6):
            other[at] = word()
        texts += [" ".join(template + own), " ".join(template + other)]
    rows = docs_of(spark, texts).repartition(parts).filter("doc_id is not null")
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(rows, 85).collect()}
    roots, _ = near_brute(texts, 85)
    assert len(set(roots)) == 150 and [got[i] for i in range(300)] == roots


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[100:160] = x[100]  # a hot vector, also among the queries
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1020, [], 1), (1040, [0.0] * 16, 1), (1060, [float("nan")] * 16, 1), (1080, [None] * 16, 1), (1100, [1.0], 1), (None, [1.0] * 16, 1)]
    rows += [rows[20], rows[21]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in CLASH})
    got = ann.nearest(df, k=20).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(range(0, 600, 20))
    v = x.astype(float)
    hits = 0
    for q, found in by.items():
        ids = [i for i in range(600) if i != q]
        want = [i for _, i in sorted((-float(v[i] @ v[q]), i) for i in ids)][:20]
        assert [r for r, *_ in sorted(found)] == list(range(1, 21))
        assert all(abs(s - v[i] @ v[q]) < 1e-9 for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(want))
        if q == 100:
            assert [i for _, i, _ in sorted(found)] == want
    assert hits / (20 * len(by)) >= 0.9
    assert ann.nearest(df.filter("vec_id < 5"), k=20).count() == 4
    assert ann.nearest(df.filter("false")).count() == 0


def test_nearest_with_a_repeated_id(spark):
    """One id's rows fill neither its class nor its list."""
    x = np.random.default_rng(6).standard_normal((60, 16)).round(3)
    x[20:39] = x[20]  # ids 20 to 38 share a vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[20].tolist())] * 100 + [(25, x[20].tolist())] * 2
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=20).collect()
    for q in (0, 20, 40):
        want = sorted((-float(np.dot(v, x[q])), i) for i, v in rows if i != q)[:20]
        found = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [i for _, i, _ in found] == [i for _, i in want]
        assert all(abs(s + w) < 1e-9 for (*_, s), (w, _) in zip(found, want, strict=True))


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), None, rng.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"])) for i in range(600)]
    rows += [(600, None, None, "a"), (601, "", None, "e"), (602, "\x0b w\tw ", None, "f"), rows[0]]
    got = mixing.mix(frame(spark, rows)).collect()
    again = mixing.mix(frame(spark, rows[::-1]).repartition(7)).collect()
    key = lambda r: (r.doc_id, r.size, r.target, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    size: dict = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, total, free = {}, sum(size.values()), set(names)
    while True:  # share again until none is above its cap
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken: dict = {}
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source] and r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert sum(taken.values()) <= total
    assert all(abs(taken[s] - target[s]) <= 80 for s in names)
    assert mixing.mix(frame(spark, [])).count() == 0


@pytest.mark.parametrize("file", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_bpe_equals_tiktoken(spark, file):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path(file)
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    rng = random.Random(6)
    texts = [
        *ODD, "hello  world\n\n  it's 'quoted' you'll we've  ", "naïve café 日本語 🙂🙂 ①②", " x  y　 z", "  ", " a", "a ", "\r\n\t x",
        "".join(rng.choice("abcde") for _ in range(6000)), "0" * 3000, "x" * 100_000, "abc" * 3000, "\n".join(["a b", " c", "d ", "", " "] * 3), "-" * 2500 + " " * 50, "<|endoftext|>", "ab" * 510, "ab" * 514,
        "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 600), rng.randint(0x4E00, 0x4E50), 10, 32])) for _ in range(3000)),
    ]
    ids = bpe.encode(docs_of(spark, texts), path, public.PATTERN)
    got = {r.doc_id: r for r in ids.withColumn("back", bpe.decode(F.col("ids"), spark, path)).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == enc.encode_ordinary(t or ""), i
        assert bytes(got[i].back).decode() == (t or "")
    # Small epochs give the same ids, and so does the pattern over whole texts.
    again = bpe.encode(docs_of(spark, texts * 2).coalesce(1), path, public.PATTERN, epoch_bytes=2000)
    assert {r.doc_id % len(texts): r.ids for r in again.collect()} == {i: r.ids for i, r in got.items()}
    again = bpe.encode(docs_of(spark, texts * 2).coalesce(1), path, f"(?:{public.PATTERN})")
    assert {r.doc_id % len(texts): r.ids for r in again.collect()} == {i: r.ids for i, r in got.items()}
    assert bpe.encode(frame(spark, []), path, public.PATTERN).count() == 0


def test_warc(spark):
    html = ["<p>a</p>", None, "", "a\r\n\r\nb", "\r\n\r\n", "\r\n", "é", "<p>a</p>", "x" * 100_000, "WARC/1.1\r\nContent-Length: 5\r\n\r\nxxxxx", "ends\r\n\r\n"]
    rows = [(i, f"http://h/{i}\r\nX: y", h) for i, h in enumerate(html)] + [(3, None, "a\r\n\r\nb"), (None, "u", "é"), (20, "u", "é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in CLASH})
    got = warc.captures(df.repartition(3), keep_body=True).collect()
    assert len(got) == len(rows)
    first: dict = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    left = [(i, h or "") for i, _, h in rows]
    for r in got:
        a, m = r.response, r.metadata
        page = int(a.page_id) if a.page_id else None
        h = next(h for i, h in left if i == page and len(h.encode()) == a.payload_bytes)
        left.remove((page, h))
        assert a.payload_digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        assert r.request.concurrent_to == m.concurrent_to == a.record_id and r.request.warc_type == "request"
        if a.warc_type == "response":
            assert bytes(a.body).decode() == h and first[h] == page and a.refers_to is None
        else:
            assert int(a.refers_to) == first[h] and not a.body
    assert not left
    small = warc.captures(df, min_revisit_bytes=5).collect()
    assert all(r.response.warc_type == "response" for r in small if r.response.payload_bytes < 5)
    assert warc.captures(df.filter("false")).count() == 0


def test_warc_of_fully_repeated_pages(spark):
    """Of rows equal in all columns one is the response, the others revisit it."""
    rows = [(5, "u", "same")] * 6 + [(7, "u", "same"), (9, "v", None), (9, "v", None), (1, "w", "other"), (None, "x", "y"), (None, "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = [(r.response.page_id, r.response.warc_type, r.response.refers_to) for r in warc.captures(df).collect()]
    want = [("5", "response", None)] + [("5", "revisit", "5")] * 5 + [("7", "revisit", "5"), ("9", "response", None), ("9", "revisit", "9"), ("1", "response", None)]
    assert sorted(map(str, got)) == sorted(map(str, want + [("", "response", None), ("", "revisit", "")]))
    assert warc.captures(df).select("capture_id").distinct().count() == len(rows)


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = gbt.fit(x, y)
    fresh = rng.standard_normal((1000, 5))
    assert ((model.predict(fresh) > 0.5) == ((fresh[:, 0] > 0.3) ^ (fresh[:, 1] > 0))).mean() > 0.95
    s = np.linspace(0, 1, 200)
    cal = gbt.fit_isotonic(s, (s > 0.7).astype(float))
    out = cal(s)
    assert (np.diff(out) >= -1e-12).all() and out.min() >= 0 and out.max() <= 1 and cal(np.array([0.9]))[0] > 0.9
    assert gbt.fit(np.zeros((0, 0)), np.zeros(0)).predict(np.zeros((3, 5))).tolist() == [0.5] * 3
    assert gbt.fit_isotonic(np.array([0.1]), np.array([1.0]))(np.array([0.2])).tolist() == [0.2]


def test_trees_walk_like_a_scalar_walk():
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((300, 4)).round(1), rng.integers(0, 2, 300).astype(float)
    model = gbt.fit(x, y, trees=7, depth=3)

    def walk(row):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.predict(x), [walk(r) for r in x])


def test_convolution_like_a_scalar_one():
    rng = np.random.default_rng(4)
    tables = {w: rng.normal(size=(w, 256, language.FILTERS)).astype(np.float32) for w in language.WIDTHS}
    out, bias = rng.normal(size=(language.FILTERS * len(tables), 3)), rng.normal(size=3)
    x = language.windows(bytes(rng.integers(0, 256, 600).astype(np.uint8)))
    got = language.Network(["a", "b", "c"], tables, out, bias).compile().probabilities(x)
    for row, p in zip(x, got, strict=True):
        pooled = []
        for w, t in tables.items():
            for k in range(language.FILTERS):
                pooled.append(max(0.0, max(sum(float(t[j, row[i + j], k]) for j in range(w)) for i in range(len(row) - w + 1))))
        e = np.exp(np.array(pooled) @ out + bias - max(np.array(pooled) @ out + bias))
        assert np.allclose(p, e / e.sum(), atol=1e-4)


def test_windows_are_stitched_or_left_to_the_heap():
    rank = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abab": 257}
    size = np.array([1] * 256 + [2, 4])
    word = b"ab" * 1500
    cut = [np.array(bpe.long_word(w, rank)) for w in bpe.windows(word)]
    assert bpe.stitched(cut, size).tolist() == bpe.long_word(word, rank)
    assert bpe.stitched([np.array([257] * 270), np.array([97] + [257] * 200)], size) is None  # never at one place


def test_long_texts_in_lines_and_mixing(spark):
    long = "\n".join(f"line {i}" for i in range(30_000))
    got = {r.doc_id: r.n_deleted for r in line_dedup.dedup_lines(docs_of(spark, [long, "x", long + "\nnew"])).collect()}
    assert got == {0: 0, 1: 0, 2: 30_000}
    sizes = {r.doc_id: r.size for r in mixing.mix(docs_of(spark, ["w " * 300_000, "w"])).collect()}
    assert sizes == {0: 300_000, 1: 1}


def labelled(spark, n=400):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice("alpha beta gamma delta you the of stone".split()) for _ in range(rng.randint(5, 60))]
        bad, junk = i % 4 == 1, i % 4 == 2
        if bad:
            words.insert(rng.randrange(len(words)), "vequ" + rng.choice(["a", "oir", "er"]))
        text = " ".join(words)
        docs.append((i, text.upper() + "!!!" if junk else text, "en", "s"))
        labels.append((i, int(not junk), int(bad)))
    docs += [(n, None, None, None), (n + 1, "", None, None), (n + 2, "x" * 200_000, None, None), (None, "null id", None, None), docs[5]]
    labels += [(n, None, None), (9999, 1, 1), labels[3]]
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


@pytest.mark.parametrize(("score", "label"), [(quality.score_quality, 1), (toxicity.score_toxicity, 2)])
def test_classifiers(spark, score, label):
    docs, labels, rows = labelled(spark)
    got = score(docs, labels).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[label] for r in labels.collect() if r[label] is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    empty = labels.filter("false")
    assert {r.score for r in score(docs, empty).collect()} == {0.5}
    assert score(docs.filter("false"), labels).count() == 0


def test_keep_good(spark):
    docs, labels, rows = labelled(spark)
    left = quality.keep_good(docs, labels)
    assert left.columns == docs.columns
    want = {r.doc_id for r in quality.score_quality(docs, labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in left.select("doc_id").collect()} == want


def test_language(spark):
    words = {"en": "the and of with this stone", "de": "der und nicht über straße ein", "es": "el que años de niño los"}
    rng = random.Random(2)
    rows = []
    for i in range(240):
        lang = sorted(words)[i % 3]
        rows.append((i, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randint(8, 300))), lang, "s"))
    rows += [(240, None, "en", "s"), (241, "", "en", "s"), (242, "12 34 !", "en", "s"), (243, "der und", None, "s"), (None, "the and of", "en", "s"), rows[0]]
    got = language.predict_language(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 240}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert {r.lang_pred for r in got if r.doc_id in (240, 241, 242)} == {"und"}
    marks = ["² ½ ①", "12 — _", "\u0301 Ⅻ", "五 ²", "ß"]
    odd = rows + [(300 + i, t, None, None) for i, t in enumerate(marks)]
    found = language.predict_language(frame(spark, odd)).filter("doc_id >= 300").collect()
    assert [r.lang_pred == "und" for r in sorted(found)] == [True, True, True, False, False]
    assert {r.lang_pred for r in language.predict_language(frame(spark, [(1, "a b", None, None)])).collect()} == {"und"}
    assert language.predict_language(frame(spark, [])).count() == 0
