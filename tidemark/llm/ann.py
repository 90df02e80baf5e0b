"""Approximate nearest neighbours by a hash-prefix forest (largest inner product).

A vector's hash in a tree is a string of BITS signs of random projections. A tree is the
sorted array of its shard's hashes. A query descends every tree to its longest matching
prefix; then all trees ascend together, one bit shorter at a time, until the prefix ranges
hold ``effort`` times the shard's vectors (counted in all trees together). The union of
those ranges is scored exactly in double precision.

On unstructured data near neighbours are barely nearer than the rest, so a high recall needs
a large part of a shard: with the defaults about 70 % of it is scored, for a measured recall
of 0.98 on 10,000 vectors of 64 dimensions and 0.95 on 500. Clustered data need far less.

Layout: distinct vectors are dealt into shards of about SHARD_ROWS. A shard's vectors move once
and its forest is built once; all distinct query vectors then pass by it in blocks of BLOCK_ROWS.
A shard returns the best k + 1 of each query, which are merged per query. A task's memory is
bounded by the two sizes. Queries are a stated set (ids divisible by ``every``).

Vectors that are equal form one class, which is searched once; of a class only the k + 1
smallest distinct ids can be in any result, each with the count of its rows, and a
distributed running count finds those, whatever the size of the class. So hot vectors need
no cap that would lose rows. The list of a query vector also goes by distinct ids.

Defined cases: vectors that are null, empty, zero, hold a null or a non-finite component,
or whose dimension isn't the most frequent one (the smallest of several) take no part. A
null vec_id takes no part. Repeated rows of one id and vector are candidates once each;
a query never meets rows of its own id. Ties go to the smaller vec_id. With fewer than k
candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, materialize, n_shuffle
from tidemark.llm.mixing import running_sum

BITS, TREES, EFFORT = 48, 40, 1.2
SHARD_ROWS, BLOCK_ROWS = 8192, 512


def planes(dim: int) -> np.ndarray:
    return np.random.default_rng(64).standard_normal((TREES, dim, BITS))


def hashes(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(trees, rows) hash strings as integers, first sign in the highest bit."""
    weights = (np.uint64(1) << np.arange(BITS, dtype=np.uint64)[::-1])
    return np.stack([((x @ p[t] > 0).astype(np.uint64) * weights).sum(1, dtype=np.uint64) for t in range(len(p))])


class Forest:
    def __init__(self, x: np.ndarray) -> None:
        self.x, self.planes = x, planes(x.shape[1])
        h = hashes(x, self.planes)
        self.order = np.argsort(h, axis=1, kind="stable")
        self.sorted = np.take_along_axis(h, self.order, axis=1)

    def ranges(self, q: np.ndarray, need: float) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query the range of the sorted array at the query's depth."""
        h = hashes(q, self.planes)
        trees, m = h.shape
        lo, hi = np.zeros((trees, m), np.int64), np.zeros((trees, m), np.int64)
        open_ = np.arange(m)
        for depth in range(BITS, -1, -1):
            width = np.uint64(BITS - depth)
            low = (h[:, open_] >> width) << width
            up = low + ((np.uint64(1) << width) - np.uint64(1))
            for t in range(trees):
                lo[t, open_] = np.searchsorted(self.sorted[t], low[t], side="left")
                hi[t, open_] = np.searchsorted(self.sorted[t], up[t], side="right")
            open_ = open_[(hi[:, open_] - lo[:, open_]).sum(0) < need]
            if not len(open_):
                break
        return lo, hi

    def search(self, q: np.ndarray, k: int, effort: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, row, score of up to k rows each."""
        n = len(self.x)
        lo, hi = self.ranges(q, min(effort, len(self.planes)) * n)
        qs, rows, scores = [], [], []
        for i in range(len(q)):
            mark = np.zeros(n, bool)
            for t in range(len(self.planes)):
                mark[self.order[t, lo[t, i] : hi[t, i]]] = True
            if mark.sum() < min(n, 4 * k):  # all trees at the same few rows: the root holds the rest
                mark[:] = True
            c = np.flatnonzero(mark)
            s = self.x[c] @ q[i]
            if len(c) > k:
                # ties at the edge stay, the merge orders them by id
                c, s = (a[s >= np.partition(s, len(s) - k)[len(s) - k]] for a in (c, s))
            qs.append(np.full(len(c), i))
            rows.append(c)
            scores.append(s)
        return np.concatenate(qs), np.concatenate(rows), np.concatenate(scores)


def _search(dim: int, k: int, effort: float):
    """Rows come by shard, its vectors before the queries: the forest is built once, queries pass by it."""

    def matrix(t: pa.Table) -> np.ndarray:
        return np.array(t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, forest, own = None, [], None, None
        for b in batches:
            t = pa.Table.from_batches([b])
            begins = np.flatnonzero(np.diff(t["shard"].to_numpy(), prepend=-1)).tolist()
            begins = begins if not len(b) or begins[:1] == [0] else [0, *begins]
            for lo, hi in zip(begins, [*begins[1:], len(b)], strict=True):
                part = t.slice(lo, hi - lo)
                if part["shard"][0].as_py() != shard:
                    shard, held, forest = part["shard"][0].as_py(), [], None
                asks = part["asks"].to_numpy()
                if not asks.all():
                    held.append(part.filter(pa.array(~asks)))
                queries = part.filter(pa.array(asks))
                for at in range(0, queries.num_rows if held else 0, BLOCK_ROWS):
                    if forest is None:
                        own = pa.concat_tables(held).combine_chunks()
                        forest = Forest(matrix(own))
                    some = queries.slice(at, BLOCK_ROWS)
                    qs, found, scores = forest.search(matrix(some), k, effort)
                    keys = [some["key"].combine_chunks().take(pa.array(qs)), own["key"].combine_chunks().take(pa.array(found))]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(scores)], ["qkey", "key", "score"])

    return run


def _finite(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        .filter("vec_id is not null and v is not null and cardinality(v) > 0")
        .filter(~bad & F.exists("v", lambda x: x != 0.0))
        .withColumn("v", F.transform("v", lambda x: x + 0.0))
    )
    good = good.withColumn("key", F.concat_ws("-", F.xxhash64("v"), F.xxhash64(F.lit(64), "v")))
    return materialize(good, "vectors")


def nearest(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    effort: float = EFFORT,
) -> DataFrame:
    """query_id, rank, vec_id, score."""
    rows = _finite(vectors, id_col, vector_col)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = dims["d"] if dims else 0
    rows = rows.filter(F.size("v") == dim)
    # Ids of a class are counted once each: the query's own id may be among them, its rows don't push out others.
    ids = rows.groupBy("key", "vec_id").agg(F.least(F.count("*"), F.lit(k)).alias("copies")).withColumn("one", F.lit(1).cast("long"))
    members = materialize(running_sum(ids, ["key", "vec_id"], "one", ["key"], "nth").filter(F.col("nth") <= k + 1), "members")
    asked = rows.filter(F.col("vec_id") % every == 0)
    classes = materialize(rows.groupBy("key").agg(F.first("v").alias("v")), "classes")
    queries = materialize(asked.groupBy("key").agg(F.first("v").alias("v")), "queries")
    shards = max(1, -(-classes.count() // SHARD_ROWS))
    data = classes.select(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(shards)).cast("long").alias("shard"), F.lit(False).alias("asks"), "key", "v")
    every_shard = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    ask = queries.select(every_shard, F.lit(True).alias("asks"), "key", "v")
    met = data.unionByName(ask).repartition(max(shards, n_shuffle(rows.sparkSession)), "shard").sortWithinPartitions("shard", "asks")
    hits = in_batches(met, _search(dim, k + 1, effort), "qkey string, key string, score double", 10_000)
    hits = materialize(hits, "hits")
    # The k + 1 best classes of each query, with all that tie with the last.
    by_query = Window.partitionBy("qkey").orderBy(F.desc("score"))
    best = hits.withColumn("r", F.rank().over(by_query)).filter(F.col("r") <= k + 1)
    pairs = best.select("qkey", "key", "score").join(members.select("key", "vec_id", "copies"), "key")
    # Down to the first row of the k + 1st distinct id: without any one id, k others stay.
    of_id = Window.partitionBy("qkey", "vec_id").orderBy(F.desc("score"), "key")
    listed = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id", "key").rowsBetween(Window.unboundedPreceding, 0)
    firsts = pairs.withColumn("new", (F.row_number().over(of_id) == 1).cast("int"))
    short = firsts.withColumn("nth", F.sum("new").over(listed)).filter(F.col("nth") <= k + 1).select("qkey", "vec_id", "score", "copies")
    for_id = asked.select(F.col("key").alias("qkey"), F.col("vec_id").alias("query_id")).distinct()
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        for_id.join(materialize(short, "short"), "qkey").filter("vec_id != query_id")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
