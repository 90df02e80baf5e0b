"""MinHash near-dedup over an LSH forest.

1. One pass over whole texts makes each document's set of word shingles, its MinHash
   signature and a fingerprint of the set. Documents with equal sets form one node.
2. Every tree orders all nodes by its own arrangement of the signature: a global range sort,
   so a region of any size spans tasks. Neighbours in that order that share a prefix of
   at least ``min_depth`` values are candidates. The depth adapts to the region: around a
   pair, the region at the depth of their common prefix must hold at most ``window`` + 1
   nodes, then all its pairs are candidates; in denser regions a node at first meets its
   ``close`` next neighbours and the region's first node, and deeper regions are searched
   by themselves. Rows at partition ends meet in a second small step.
3. Candidates are confirmed on full sets, in two rounds: first one candidate for each node,
   then all candidates whose two nodes are not connected yet. Links between nodes that are
   connected anyway change nothing, so they aren't compared.
4. A denser region whose nodes aren't all connected by then is compared whole: its nodes are
   dealt into blocks, and two blocks meet in a task, which counts the common shingles of all
   their pairs. Only blocks that lie in one component are left out. So all pairs of a region
   are candidates, whatever its size.
5. Components of the confirmed links.

Defined cases: texts that are null, empty or white space have an empty set and are linked
with nothing. Texts of fewer than five words have one shingle, the whole sequence. Rows
repeated under one doc_id share its result. A null doc_id is never a component's id unless
no other is there. Extra columns are ignored. An empty table gives an empty result.

Sets hold 64-bit hashes of shingles; two different shingles share one with a chance of
about 1 in 10**19 for a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BATCH_BYTES, in_batches, materialize, n_shuffle, sized
from tidemark.llm.components import components
from tidemark.llm.mixing import running_sum
from tidemark.llm.shingles import chunks, mix, shingle_sets

VALUES, TREES, DEPTH = 64, 16, 8
MIN_DEPTH, WINDOW = 4, 32
CHUNK = 1 << 18  # bytes of text shingled at once, whole texts
#: Shingles of a block of a dense region (each node counts NODE more), columns of its matrix.
BLOCK, NODE, COLUMNS = 250_000, 256, 2_048
_rng = np.random.default_rng(85)
_MUL = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(1, 2**63, VALUES, dtype=np.uint64)
#: Tree t begins with values of its own (4 t to 4 t + 3), then takes others.
ORDERS = [[(4 * t + j) % VALUES for j in range(4)] + [(4 * (t + 5 + 3 * (j % 2)) + j) % VALUES for j in range(4, DEPTH)] for t in range(TREES)]
BIG = np.dtype(">u4")


def _rows(with_sets: bool, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, ends in chunks(b["text"], CHUNK):
                s = shingle_sets(data, ends, k)
                full = np.flatnonzero(s.n)
                starts = s.starts[full]
                node, second = np.zeros(len(ends), np.uint64), np.zeros(len(ends), np.uint64)
                if len(full):
                    node[full] = mix(np.add.reduceat(s.values, starts) + s.n[full].astype(np.uint64))
                    second[full] = np.add.reduceat(mix(s.values ^ np.uint64(0x5555)), starts)
                ids = b["doc_id"].slice(at, len(ends))
                arrays = [ids, pa.array(s.n, pa.int64()), pa.array(node.view(np.int64)), pa.array(second.view(np.int64))]
                names = ["doc_id", "n", "node", "second"]
                if with_sets:
                    offsets = np.concatenate([s.starts, [len(s.values)]]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(s.values.view(np.int64))))
                    names.append("members")
                else:
                    sig = np.zeros((len(ends), VALUES), BIG)
                    if len(full):
                        for j in range(VALUES):
                            low = np.minimum.reduceat((s.values ^ _XOR[j]) * _MUL[j], starts)
                            sig[full, j] = (low >> np.uint64(32)).astype(np.uint32)
                    arrays.append(pa.array([row.tobytes() for row in sig], pa.binary()))
                    names.append("signature")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def shingled(docs: DataFrame, id_col: str, text_col: str, with_sets: bool, k: int = 5) -> DataFrame:
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    last = "members array<long>" if with_sets else "signature binary"
    return in_batches(slim, _rows(with_sets, k), f"doc_id {kind}, n long, node long, second long, {last}", size=BATCH_BYTES)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not len(b):
            continue
        sig = np.frombuffer(b"".join(b["signature"].to_pylist()), BIG).reshape(len(b), VALUES)
        for t, order in enumerate(ORDERS):
            keys = np.ascontiguousarray(sig[:, order])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(b), t, np.int32)), pa.array([x.tobytes() for x in keys], pa.binary()), b["node"]], ["tree", "key", "node"]
            )


def neighbours(tree: np.ndarray, key: np.ndarray, min_depth: int, window: int, close: int) -> np.ndarray:
    """Pairs of positions in sorted rows. key: (n, DEPTH) values."""
    n = len(tree)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    same = np.cumprod(key[1:] == key[:-1], axis=1).sum(1)
    lcp = np.where(tree[1:] == tree[:-1], same, -1)
    size, first = np.zeros((DEPTH + 1, n), np.int64), np.zeros((DEPTH + 1, n), np.int64)
    for d in range(min_depth, DEPTH + 1):
        begin = np.flatnonzero(np.concatenate([[True], lcp < d]))
        count = np.diff(np.concatenate([begin, [n]]))
        size[d], first[d] = np.repeat(count, count), np.repeat(begin, count)
    out = []
    shared = np.full(n, DEPTH)
    for s in range(1, min(window, n - 1) + 1):
        shared = np.minimum(shared[: n - s], lcp[s - 1 :])
        i = np.flatnonzero(shared >= min_depth)
        if not len(i):
            break
        small = size[shared[i], i] <= window + 1
        i = i[small | (s <= close)]
        out.append(np.stack([i, i + s], axis=1))
    for d in range(min_depth, DEPTH + 1):
        dense = np.flatnonzero((size[d] > window + 1) & (first[d] != np.arange(n)))
        if d < DEPTH:  # a deeper region's first node stands for it
            dense = dense[first[d + 1][dense] == dense]
        out.append(np.stack([first[d][dense], dense], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _search(min_depth: int, window: int, close: int):
    """Pairs within a partition, and its first and last rows for the ends' step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = ["a", "b", "edge", "head", "tree", "key"]
        carry = None
        opened = False
        tail = None

        def ends(t: pa.Table, edge: int, head: bool) -> pa.RecordBatch:
            m = t.num_rows
            return pa.RecordBatch.from_arrays(
                [t["node"].combine_chunks(), t["node"].combine_chunks(), pa.array(np.full(m, edge)), pa.array(np.full(m, head)),
                 t["tree"].combine_chunks(), t["key"].combine_chunks()], names,
            )

        for b in batches:
            if not len(b):
                continue
            t = pa.Table.from_batches([b])
            if not opened:
                yield ends(t.slice(0, window), part - 1, True)
                opened = True
            old = 0 if carry is None else carry.num_rows
            both = t if carry is None else pa.concat_tables([carry, t])
            both = both.combine_chunks()
            tree = both["tree"].to_numpy()
            key = np.frombuffer(b"".join(both["key"].to_pylist()), BIG).reshape(-1, DEPTH)
            node = both["node"].to_numpy()
            p = neighbours(tree, key, min_depth, window, close)
            p = p[p[:, 1] >= old]
            yield _pairs(node[p[:, 0]], node[p[:, 1]], names)
            carry = both.slice(max(0, both.num_rows - 4 * window))
            tail = carry
        if tail is not None:
            yield ends(tail.slice(max(0, tail.num_rows - window)), part, False)

    return run


def _pairs(a: np.ndarray, b: np.ndarray, names: list[str]) -> pa.RecordBatch:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    keep = lo != hi
    got = np.unique(np.stack([lo[keep], hi[keep]], axis=1), axis=0) if keep.any() else np.zeros((0, 2), np.int64)
    m = len(got)
    return pa.RecordBatch.from_arrays(
        [pa.array(got[:, 0], pa.int64()), pa.array(got[:, 1], pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()),
         pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names,
    )


def candidates(nodes: DataFrame, min_depth: int = MIN_DEPTH, window: int = WINDOW, close: int = 4, part_rows: int = 4000) -> DataFrame:
    """Distinct pairs a < b of nodes that are neighbours in some tree, at least all of regions of up to window + 1 nodes.

    nodes: node, signature. A partition of the order has about part_rows rows, so tables of any
    size have partitions longer than a window; shorter ones are seen through.
    """
    spark = nodes.sparkSession
    rows = in_batches(nodes.select("node", "signature"), _trees, "tree int, key binary, node long")
    n = max(1, min(n_shuffle(spark), nodes.count() * TREES // part_rows + 1))
    ordered = rows.repartitionByRange(n, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = materialize(
        in_batches(ordered, _search(min_depth, window, close), "a long, b long, edge long, head boolean, tree int, key binary"),
        "neighbours",
    )

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by([("tree", "ascending"), ("key", "ascending"), ("a", "ascending")])
        key, tree, node = np.frombuffer(b"".join(t["key"].to_pylist()), BIG).reshape(-1, DEPTH), t["tree"].to_numpy(), t["a"].to_numpy()
        once = np.ones(len(node), bool)  # a short partition's rows are both its first and its last
        once[1:] = (node[1:] != node[:-1]) | (tree[1:] != tree[:-1]) | (key[1:] != key[:-1]).any(1)
        key, tree, node = key[once], tree[once], node[once]
        p = neighbours(tree, key, min_depth, window, close)
        r = _pairs(node[p[:, 0]], node[p[:, 1]], ["a", "b", "edge", "head", "tree", "key"])
        return pa.Table.from_batches([r]).select(["a", "b"])

    inner = found.filter("edge is null").select("a", "b")
    ends = found.filter("edge is not null")
    # Edges on the two sides of a partition of fewer rows than a window are one place.
    size = {r.edge: r["count"] for r in ends.filter("not head").groupBy("edge").count().collect()}  # a number for each partition
    place, moved = 0, []
    for e in range(max(size, default=0)):
        if size.get(e, 0) >= window:
            place = e
        elif e > place:
            moved.append((e, place))
    if moved:
        to = F.broadcast(spark.createDataFrame(moved, "edge long, place long"))
        ends = ends.join(to, "edge", "left").withColumn("edge", F.coalesce("place", "edge")).drop("place")
    return inner.unionByName(ends.filter("edge >= 0").groupBy("edge").applyInArrow(meet, "a long, b long")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sets meet 100 * intersection >= percent * union."""
    size = "cardinality(members)"
    left = sets.selectExpr("node as a", "members as am")
    right = sets.selectExpr("node as b", "members as bm")
    both = pairs.join(left, "a").join(right, "b")
    inter = "cast(cardinality(array_intersect(am, bm)) as long)"
    return both.filter(
        f"100 * {inter} >= {percent} * ({size.replace('members', 'am')} + {size.replace('members', 'bm')} - {inter})"
    ).select("a", "b")


def crowds(nodes: DataFrame) -> DataFrame:
    """region, node, n of the regions of MIN_DEPTH values that hold over WINDOW + 1 nodes.

    A region goes by a hash of its tree and values; two that share one are compared as one.
    """
    prefix = f"substring(signature, {4 * 4} * t + 1, {4 * MIN_DEPTH})"  # tree t begins with value 4 t
    each = nodes.select("node", "n", F.expr(f"explode(transform(sequence(0, {TREES - 1}), t -> xxhash64(t, {prefix})))").alias("region"))
    dense = materialize(each.groupBy("region").count().filter(F.col("count") > WINDOW + 1).select("region"), "dense")
    return materialize(each.join(sized(dense), "region").select("region", "node", "n"), "crowds")


def _forest(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """The links a, b less those that close a circle."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, kept = list(range(len(ids))), []
    for x, y in np.unique(at.reshape(2, -1), axis=1).T.tolist():
        p, q = x, y
        while up[p] != p:
            up[p] = p = up[up[p]]
        while up[q] != q:
            up[q] = q = up[up[q]]
        if p != q:
            up[q] = p
            kept.append((x, y))
    got = ids[np.array(kept, np.int64).reshape(-1, 2)]
    return pa.table({"a": pa.array(got[:, 0], pa.int64()), "b": pa.array(got[:, 1], pa.int64())})


def common_shingles(values: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(left, right) sizes of the intersections of sets. owner: the set of each value; left, right: sets."""
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, owner = (np.cumsum(count > 1) - 1)[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    inter = np.zeros((len(left), len(right)))
    for c in range(0, int((count > 1).sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [c, c + COLUMNS])
        has = np.zeros((max(left.max(), right.max()) + 1, COLUMNS), np.float32)
        has[owner[lo:hi], column[lo:hi] - c] = 1
        inter += has[left] @ has[right].T
    return inter


def crowd_links(crowd: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b between components of comp (or nodes outside it) that share a dense region."""
    at = comp.select("node", "root")
    placed = crowd.join(sized(at), "node", "left").select("region", F.coalesce("root", "node").alias("comp"), "node", (F.col("n") + NODE).alias("weight"))
    split = placed.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("region")
    split = materialize(split, "split-regions")
    open_ = materialize(placed.join(sized(split), "region"), "open")
    dealt = running_sum(open_, ["region", "comp", "node"], "weight", ["region"], "upto").select(
        "region", "comp", "node", F.floor((F.col("upto") - F.col("weight")) / BLOCK).alias("block")
    )
    dealt = materialize(dealt, "dealt")
    blocks = materialize(dealt.groupBy("region", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), "blocks")
    end = lambda c: blocks.select("region", F.col("block").alias(c), F.col("lo").alias(f"lo{c}"), F.col("hi").alias(f"hi{c}"))
    meets = materialize(
        end("i").join(end("j"), "region").filter("i <= j and least(loi, loj) < greatest(hii, hij)").select("region", "i", "j"), "meets"
    )
    sent = (
        meets.select("region", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
        .join(dealt, ["region", "block"]).join(sets, "node").select("region", "i", "j", "block", "comp", "members")
    )

    def meet(t: pa.Table) -> pa.Table:
        members = t["members"].combine_chunks()
        n = members.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        block, comp_ = t["block"].to_numpy(), t["comp"].to_numpy()
        left, right = np.flatnonzero(block == t["i"][0].as_py()), np.flatnonzero(block == t["j"][0].as_py())
        if not len(left) or not len(right):
            return _forest(np.zeros(0, np.int64), np.zeros(0, np.int64))
        inter = common_shingles(members.flatten().to_numpy(), np.repeat(np.arange(len(n)), n), left, right)
        linked = (100 * inter >= percent * (n[left][:, None] + n[right] - inter)) & (comp_[left][:, None] != comp_[right])
        x, y = np.nonzero(linked)
        return _forest(comp_[left[x]], comp_[right[y]])

    return sent.groupBy("region", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (node, root) after further links a, b."""
    if not links.limit(1).count():
        return comp
    at = lambda c: comp.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    over = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")
    )
    top = components(over).select(F.col("node").alias("root"), F.col("root").alias("top"))
    raised = materialize(top, "raised")
    old = comp.alias("r").join(sized(raised), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = raised.join(comp.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return materialize(old.unionByName(new), "components")


def near_groups(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """doc_id, n_shingles, node, second, component_id, kept for every row of docs."""
    rows = materialize(shingled(docs, id_col, text_col, False, k), "signatures")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    nodes = materialize(
        rows.filter("n > 0").groupBy("node", "second", "n").agg(low.alias("low"), F.first("signature").alias("signature"))
        .select("node", "n", F.col("low.doc_id").alias("low_id"), "signature"),
        "nodes",
    )
    pairs = materialize(candidates(nodes), "candidates")
    crowd = crowds(nodes)
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowd.select("node")).distinct()
    wanted = materialize(met.join(nodes.select("node", "low_id"), "node"), "wanted")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = sized(wanted.select("low_id").distinct())
    texts = slim.join(chosen, F.col("doc_id").eqNullSafe(F.col("low_id")), "left_semi")
    sets = shingled(texts, "doc_id", "text", True, k).filter("n > 0").join(sized(wanted.select("node")), "node", "left_semi")
    sets = materialize(sets.select("node", "members"), "sets")
    # An id repeated with one text would give its node twice.
    if sets.count() > wanted.count():
        sets = materialize(sets.dropDuplicates(["node"]), "sets")
    one = pairs.groupBy(F.col("b")).agg(F.min("a").alias("a")).select("a", "b")
    links = materialize(confirmed(one, sets, percent), "links")
    comp = materialize(components(links), "components")
    at = lambda c: comp.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    rest = (
        pairs.join(one, ["a", "b"], "left_anti").join(sized(at("a")), "a", "left").join(sized(at("b")), "b", "left")
        .filter("ra is null or rb is null or ra != rb")
    )
    more = materialize(confirmed(rest.select("a", "b"), sets, percent), "more-links")
    root = joined(comp, more)
    if crowd.limit(1).count():
        root = joined(root, materialize(crowd_links(crowd, root, sets, percent), "crowd-links"))
    full = nodes.join(sized(root), "node", "left").select("node", "low_id", F.coalesce("root", "node").alias("root"))
    least = full.join(sized(root.select("node")), "node", "left_semi").groupBy("root").agg(F.min("low_id").alias("component_id"))
    named = materialize(full.join(sized(materialize(least, "least")), "root", "left").select("node", F.coalesce("component_id", "low_id").alias("component_id")), "named")
    return rows.join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "node", "second",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each near-duplicate group, all columns kept."""
    gone = materialize(near_groups(docs, percent, id_col, text_col).filter("not kept").select("doc_id").distinct(), "near-copies")
    return docs.alias("d").join(sized(gone).alias("g"), F.col(f"d.{id_col}").eqNullSafe(F.col("g.doc_id")), "left_anti")
