"""The registered queries on the test tables, and the pipeline's stages against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import near_brute
from tests.oracle import DATA, check
from tidemark.llm import bpe, toxicity
from tidemark.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    check(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"pipeline"}))
def test_row_for_each_input(spark, name):
    got = QUERIES[name](spark, DATA)
    if name.startswith("op2"):
        vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
        asked = vectors.filter("vec_id % 20 = 0").count()
        assert got.count() == asked * min(20, vectors.count() - 1)
    else:
        docs = spark.read.parquet(f"{DATA}/documents.parquet")
        assert got.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0 and got.count() == docs.count()


def test_near_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    roots, sizes = near_brute([r.text for r in rows], 85)
    got = {r.doc_id: r for r in QUERIES["op7_near_dedup"](spark, DATA).collect()}
    assert [got[r.doc_id].component_id for r in rows] == [rows[k].doc_id for k in roots]
    assert [got[r.doc_id].n_shingles for r in rows] == sizes


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality_filter", "exact_dedup", "near_dedup", "mixing", "tokenize"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, [docs.orderBy("doc_id").collect()]
    for name, stage in p.STAGES:
        docs = p.materialize(stage(spark, docs, DATA), name)
        kept.append(docs.orderBy("doc_id").collect())
        assert name == "tokenize" or docs.columns == columns
    raw, good, exact, near, mixed, tokens = kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    left = {r.doc_id for r in good}
    clean = [r.doc_id for r in raw if labels.get(r.doc_id) == 1]
    junk = [r.doc_id for r in raw if labels.get(r.doc_id) == 0]
    assert sum(i in left for i in clean) >= 0.95 * len(clean) and sum(i in left for i in junk) <= 0.3 * len(junk)
    firsts: dict = {}
    for r in good:
        firsts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert [r.doc_id for r in exact] == sorted(firsts.values())
    roots, _ = near_brute([r.text for r in exact], 80)
    assert [r.doc_id for r in near] == [exact[i].doc_id for i in sorted(set(roots))]
    times: dict = {}
    for r in mixed:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r.doc_id, r.source, r.text) for r in near], columns=["doc_id", "source", "text"]))
    want = {i: taken // size for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({ORACLE['op8_mixing']})").fetchall() if size}
    assert times == {i: n for i, n in want.items() if n} and max(times.values()) <= 3
    assert [tuple(r) for r in tokens] == sorted(encoded([(r.doc_id, r.text) for r in mixed]))


def encoded(rows):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) by the tiktoken library."""
    public, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.ranks(public.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for i, text in rows:
        ids = enc.encode_ordinary(text or "")
        yield i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_query_against_tiktoken(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    got = QUERIES["op6_bpe"](spark, DATA).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == list(encoded([(r.doc_id, r.text) for r in docs]))


def test_nearest_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    ids = np.array([r.vec_id for r in rows])
    found: dict = {}
    for r in QUERIES["op2_ann"](spark, DATA).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    asked = [k for k, i in enumerate(ids) if i % 20 == 0]
    for k in asked:
        score = x @ x[k]
        want = [i for _, i in sorted((-s, i) for s, i in zip(score, ids, strict=True) if i != ids[k])][:20]
        mine = sorted(found[ids[k]])
        assert [r for r, *_ in mine] == list(range(1, len(want) + 1))
        at = dict(zip(ids.tolist(), score, strict=True))
        assert all(abs(s - at[i]) < 1e-9 for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & set(want)) / len(want)
    assert set(found) == {ids[k] for k in asked} and hits >= 0.9 * len(asked)


@pytest.mark.parametrize(("name", "label", "modulus", "held"), [("op3_toxicity", "toxic", 4, 2), ("op4_quality", "quality", 3, 1)])
def test_classifier_queries_on_held_out_labels(spark, name, label, modulus, held):
    data = f"{DATA}/../sf0.01"  # sf0.001 has too few labels
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r[label] is not None}
    got = QUERIES[name](spark, data).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) for r in got)
    texts = {r.doc_id: (r.text or "").lower() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    own = [(r.predicted, truth[r.doc_id], r.doc_id) for r in got if r.held_out and r.doc_id in truth]
    clean = [a for a, b, _ in own if b == (0 if label == "toxic" else 1)]
    assert clean and sum(a == (0 if label == "toxic" else 1) for a in clean) >= 0.95 * len(clean)
    # Some labels mark texts without a toxic word; nothing can be learned of these.
    found = [a for a, b, i in own if b == 1 and (label != "toxic" or set(re.findall(r"\w+", texts[i])) & set(toxicity.LEXICON))]
    assert found and all(found)


def test_language_query_on_held_out_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet").collect()}
    got = QUERIES["op9_language"](spark, f"{DATA}/../sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and len(got) == len(docs)
    own = [(r.lang_pred, docs[r.doc_id].lang) for r in got if r.held_out and docs[r.doc_id].lang is not None and r.lang_pred != "und"]
    assert sum(a == b for a, b in own) >= 0.95 * len(own)


def test_stages_with_odd_rows(spark):
    """Nulls, empty and long texts, repeated ids and extra columns named like the operators' own."""
    import corpus_pipeline as p

    base = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(None, "a null id", "en", None, 9), (10**6, None, None, None, None), (10**6 + 1, "", None, "web", 0), (10**6 + 2, "long word " * 60_000, "en", "web", 1), (10**6 + 3, "x" * 300_000, "en", "web", 1)]
    docs = base.unionByName(spark.createDataFrame(odd, base.schema)).unionByName(base.filter("doc_id < 5"))
    for c in ("node", "seq", "n", "key", "copies", "__id", "size", "kept", "row"):
        docs = docs.withColumn(c, F.lit("x"))
    for name, stage in p.STAGES:
        kept = p.materialize(stage(spark, docs, DATA), name)
        assert name == "tokenize" or kept.columns == docs.columns
        if name in ("exact_dedup", "near_dedup"):
            assert kept.count() <= docs.count() and kept.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        docs = kept
    assert docs.count()


def test_pipeline_of_nothing(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter(F.lit(False))
    for name, stage in p.STAGES:
        docs = p.materialize(stage(spark, docs, DATA), name)
        assert docs.count() == 0
