"""Near copies among embeddings: a threshold graph found by NN-descent.

Neighbour lists start from a few random-hyperplane partitions, whose cells are compared within themselves, and are
refined by local joins: the members of a vector's list, and the vectors that list it, are compared with each other, as
neighbours of neighbours are likely neighbours.  Only lists with new members are joined again.  A list is saturated when
even its last member is over the threshold; it is enlarged, and as more may be missing than any list should hold, the
links inside components with lists saturated at their largest are counted in full, block by block.  As many partitions
are made as a pair at the threshold needs to share a cell of one of them.

An audit compares sampled vectors with all others: recall is that of the distinct neighbours of a vector, averaged over
vectors with about equally many, so that a dense group does not hide small ones.  The sample grows until it has ENOUGH
vectors with few neighbours.  Partitions are added while the audit fails; where it still does, or cannot tell because so few
vectors have links, all vectors are compared with all others, block by block.

Equal vectors are one node with a weight.  Cosines are computed in double precision throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.common import components, stored

TREES, CELL = 4, 512
LIST, LARGEST = 8, 32
PIVOTS = 256  # lists that one group joins
TURNS = 6
AUDITED, RECALL, ATTEMPTS = 256, 0.97, 3
ENOUGH, MOST_AUDITED = 64, 4096  # sampled vectors with few neighbours, and vectors compared to find them
EDGES = "node long, other long, cos double"


def _units(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _table(node, other, cos) -> pa.Table:
    return pa.table({"node": pa.array(node, pa.int64()), "other": pa.array(other, pa.int64()), "cos": pa.array(cos, pa.float64())})


def _none() -> pa.Table:
    return _table([], [], [])


def _best_of_cell(cell: pa.Table) -> pa.Table:
    ids, x = cell.column("node").to_numpy(), _units(cell.column("v"))
    if len(ids) < 2:
        return _none()
    cos = x @ x.T
    np.fill_diagonal(cos, -2.0)
    k = min(LIST, len(ids) - 1)
    best = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    return _table(np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(cos, best, axis=1).ravel())


def _trees(bits: int, threshold: float) -> int:
    """The partitions by which a pair at the threshold shares a cell of one at least, with probability RECALL."""
    together = (1 - np.arccos(np.clip(threshold, -1.0, 1.0)) / np.pi) ** bits
    return TREES if together >= 1 else max(TREES, int(np.ceil(np.log(1 - RECALL) / np.log1p(-together))))


def _partitioned(nodes: DataFrame, total: int, seed: int, threshold: float) -> DataFrame:
    """Edges between vectors of one cell, for each of several random partitions; large cells are dealt out by hash."""
    bits = max(0, int(np.ceil(np.log2(max(total, 1) / (CELL / 2)))))
    trees = _trees(bits, threshold)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = _units(part.column("v"))
                planes = np.random.default_rng([seed, int(d)]).standard_normal((int(d), trees * bits)) if bits else np.zeros((int(d), 0))
                signs = (x @ planes > 0).reshape(len(x), trees, bits) if bits else np.zeros((len(x), trees, 0), bool)
                code = (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2) if bits else np.zeros((len(x), trees), np.int64)
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("node"), part.column("dim"), part.column("v"), pa.array(np.full(len(x), t, np.int32)), pa.array(code[:, t])], names=["node", "dim", "v", "tree", "code"]
                    )

    kind = dict(nodes.dtypes)["v"]
    coded = nodes.select("node", "dim", "v").mapInArrow(codes, f"node long, dim int, v {kind}, tree int, code long")
    sizes = coded.groupBy("tree", "dim", "code").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("parts"))
    # one key of its own for each part, or the parts of a large cell would stay in the task that the join left them in
    part = F.xxhash64("tree", "code", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))
    dealt = coded.join(sizes, ["tree", "dim", "code"]).withColumn("part", part)
    return dealt.groupBy("dim", "part").applyInArrow(_best_of_cell, EDGES)


def _join_lists(group: pa.Table) -> pa.Table:
    """Better neighbours among the members of each list; every member brings the cosine it must beat."""
    pivot = group.column("pivot").to_numpy()
    order = np.argsort(pivot, kind="stable")
    group = group.take(pa.array(order))
    pivot, ids, new, worst = (group.column(c).to_numpy() for c in ("pivot", "member", "new", "worst"))
    lengths = pa.compute.list_value_length(group.column("v")).to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1]]))
    found: dict[tuple[int, int], float] = {}
    for a, b in zip(starts, np.append(starts[1:], len(pivot)), strict=True):
        if b - a < 2 or not new[a:b].any() or lengths[a] != lengths[a:b].max():
            continue
        x = _units(group.column("v").slice(a, b - a))
        cos = x @ x.T
        better = (cos > worst[a:b, None]) & (new[a:b, None] | new[None, a:b])
        np.fill_diagonal(better, False)
        i, j = np.nonzero(better)
        found.update(zip(zip(ids[a + i].tolist(), ids[a + j].tolist(), strict=True), cos[i, j].tolist(), strict=True))
    if not found:
        return _none()
    node, other = zip(*found, strict=True)
    return _table(node, other, list(found.values()))


def _trimmed(edges: DataFrame) -> DataFrame:
    """The `k` best of each list; equal cosines in the order of the other's number."""
    w = Window.partitionBy("node").orderBy(F.desc("cos"), "other")
    return edges.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= F.col("k")).drop("_place")


def _refine(lists: DataFrame, nodes: DataFrame, total: int, threshold: float) -> DataFrame:
    """One turn: enlarge saturated lists, join all lists with new members, and keep the best."""
    full = F.col("_n") >= F.col("_k")
    state = lists.groupBy("node").agg(F.count(F.lit(1)).alias("_n"), F.max("k").alias("_k"), F.min("cos").alias("_min"))
    state = state.withColumn("_to", F.when(full & (F.col("_min") >= threshold), F.least(2 * F.col("_k"), F.lit(LARGEST))).otherwise(F.col("_k")))
    state = state.select("node", F.col("_to").alias("k"), F.when(F.col("_n") >= F.col("_to"), F.col("_min")).otherwise(-1.0).alias("worst"))
    state = stored(state, "nn-state")
    forward = lists.select(F.col("node").alias("pivot"), F.col("other").alias("member"), "new", F.col("cos"))
    backward = lists.select(F.col("other").alias("pivot"), F.col("node").alias("member"), "new", F.col("cos"))
    near = Window.partitionBy("pivot").orderBy(F.desc("new"), F.desc("cos"), "member")
    backward = backward.withColumn("_place", F.row_number().over(near)).where(F.col("_place") <= LARGEST).drop("_place")
    members = forward.unionByName(backward).groupBy("pivot", "member").agg(F.max("new").alias("new"))
    members = members.join(state.select(F.col("node").alias("member"), "worst"), "member").join(nodes.select(F.col("node").alias("member"), "v"), "member")
    groups = members.withColumn("_group", F.pmod(F.xxhash64("pivot", F.lit(3)), F.lit(max(1, -(-total // PIVOTS)))))
    better = groups.groupBy("_group").applyInArrow(_join_lists, EDGES)
    both = lists.select("node", "other", "cos", F.lit(False).alias("new")).unionByName(better.withColumn("new", F.lit(True)))
    both = both.groupBy("node", "other").agg(F.max("cos").alias("cos"), F.min("new").alias("new"))
    return stored(_trimmed(both.join(state.select("node", "k"), "node")), "nn-lists")


def _forest(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (rows, then columns of `linked`) that connect what its links connect, each place but one of a group once."""
    rows, cols = linked.shape
    adjacent = linked if same else np.block([[np.zeros((rows, rows), bool), linked], [linked.T, np.zeros((cols, cols), bool)]])
    root = np.arange(len(adjacent))
    while True:
        low = np.minimum(root, np.where(adjacent, root[None, :], len(root)).min(axis=1, initial=len(root)))
        low = low[low]
        if (low == root).all():
            break
        root = low
    own = np.flatnonzero(root != np.arange(len(root)))
    return own, root[own]


def _block_links(members: DataFrame, threshold: float, join: bool = False) -> DataFrame:
    """Links inside whole components (columns component, node, weight, v), counted block against block.

    Rows without `other` hold a node's links and distinct neighbours, to be summed; with `join`, rows with `other` connect
    all that links connect."""

    def rows(node, other, links, near) -> pa.Table:
        other = pa.nulls(len(node), pa.int64()) if other is None else pa.array(other, pa.int64())
        return pa.table({"node": pa.array(node, pa.int64()), "other": other, "n_links": pa.array(links, pa.int64()), "n_near": pa.array(near, pa.int64())})

    def count(pair: pa.Table) -> pa.Table:
        left, right = pair.filter(pa.compute.field("first")), pair.filter(pa.compute.field("second"))
        a, b = left.column("node").to_numpy(), right.column("node").to_numpy()
        if not len(a) or not len(b):
            return rows([], None, [], [])
        same = pair.column("i")[0].as_py() == pair.column("j")[0].as_py()
        linked = _units(left.column("v")) @ _units(right.column("v")).T >= threshold
        linked &= a[:, None] != b[None, :]
        node, links, near = a, linked @ right.column("weight").to_numpy(), linked.sum(axis=1)
        if not same:
            node, near = np.concatenate([a, b]), np.concatenate([near, linked.sum(axis=0)])
            links = np.concatenate([links, left.column("weight").to_numpy() @ linked])
        some = near > 0
        out = [rows(node[some], None, links[some], near[some])]
        if join and some.any():
            used = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            places = a[used[0]] if same else np.concatenate([a[used[0]], b[used[1]]])
            own, root = _forest(linked[np.ix_(*used)], same)
            out.append(rows(places[own], places[root], np.zeros(len(own)), np.zeros(len(own))))
        return pa.concat_tables(out)

    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))
    dealt = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("against", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(
        "component", "node", "weight", "v", F.least("own", "against").alias("i"), F.greatest("own", "against").alias("j"),
        (F.col("own") <= F.col("against")).alias("first"), (F.col("own") >= F.col("against")).alias("second"),
    )
    return dealt.groupBy("component", "i", "j").applyInArrow(count, "node long, other long, n_links long, n_near long")


def _summed(counts: DataFrame) -> DataFrame:
    """(node, n_links, n_near) of block counts."""
    return counts.where("other is null").groupBy("node").agg(F.sum("n_links").alias("n_links"), F.sum("n_near").alias("n_near"))


def _all_links(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The component labels and links of all nodes, by comparing each with all of its length."""
    found = stored(_block_links(nodes.select(F.col("dim").alias("component"), "node", "weight", "v"), threshold, join=True), "nn-all")
    labels = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    return labels, stored(_summed(found), "nn-links")


def _true_near(nodes: DataFrame, asked: list, threshold: float) -> dict[int, int]:
    """The exact number of distinct neighbours of a few vectors, by comparing them with all."""
    own = {d: [r for r in asked if len(r["v"]) == d] for d in {len(r["v"]) for r in asked}}
    own = {d: (np.array([r["node"] for r in some], np.int64), np.array([r["v"] for r in some], float)) for d, some in own.items()}
    own = {d: (ids, x / np.linalg.norm(x, axis=1, keepdims=True)) for d, (ids, x) in own.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                if d not in own:
                    continue
                part = batch.filter(pa.array(dims == d))
                x, others = _units(part.column("v")), part.column("node").to_numpy()
                for at in range(0, len(own[d][0]), CELL):
                    ids = own[d][0][at : at + CELL]
                    linked = (own[d][1][at : at + CELL] @ x.T >= threshold) & (ids[:, None] != others[None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(linked.sum(axis=1), pa.int64())], names=["node", "n"])

    got = nodes.select("node", "dim", "v").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()
    return {r["node"]: r["n"] for r in got}


def _sampled(nodes: DataFrame, total: int, threshold: float, seed: int) -> dict[int, int]:
    """The distinct neighbours of sampled vectors, or nothing if too few of them have few neighbours to audit by."""
    size = AUDITED
    while total:
        asked = nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(size).select("node", "v").collect()
        truth = _true_near(nodes, asked, threshold)
        if size >= total or sum(0 < n <= LARGEST for n in truth.values()) >= ENOUGH:
            return truth
        if size >= MOST_AUDITED:
            break
        size *= 4
    return {}


def _holds(truth: dict[int, int], have: dict[int, int]) -> bool:
    """Whether recall, averaged over the vectors of each class of neighbour counts, is enough in every class."""
    classes: dict[int, list[float]] = {}
    for node, n in truth.items():
        if n:
            classes.setdefault(n.bit_length(), []).append(min(1.0, have.get(node, 0) / n))
    return all(np.mean(r) >= RECALL for r in classes.values())


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, seed: int = 17) -> DataFrame:
    """(key, n_links, component_id, kept): one row per row of `rows`.

    n_links counts the other rows whose cosine is at least the threshold.  Vectors that are null, empty or zero or hold
    null or non-finite components link with nothing, and vectors of different lengths never link.  A row with a null key
    takes part and is kept only if its component has no key at all.  Repeated rows link with each other.
    """
    base = rows.select(F.col(key).cast("long").alias("_key"), F.col(vector).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    base = stored(base.withColumn("node", F.when(good, F.xxhash64("v"))), "nn-rows")
    nodes = base.where("node is not null").groupBy("node").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("weight"), F.min("_key").alias("first_key"))
    nodes = stored(nodes.withColumn("dim", F.size("v")), "nn-nodes")
    total = nodes.count()
    truth = _sampled(nodes, total, threshold, seed)

    lists = None
    for attempt in range(ATTEMPTS if truth else 0):
        fresh = _partitioned(nodes, total, seed + attempt, threshold).groupBy("node", "other").agg(F.max("cos").alias("cos"))
        fresh = fresh.withColumns({"new": F.lit(True), "k": F.lit(LIST)})
        if lists is not None:
            fresh = fresh.unionByName(lists).groupBy("node", "other").agg(F.max("cos").alias("cos"), F.min("new").alias("new"), F.max("k").alias("k"))
            fresh = fresh.withColumn("k", F.max("k").over(Window.partitionBy("node")))
        lists = stored(_trimmed(fresh), "nn-lists")
        for _ in range(TURNS):
            lists = _refine(lists, nodes, total, threshold)
            if lists.where(F.col("new") & (F.col("cos") >= threshold)).isEmpty():
                break
        close = lists.where(F.col("cos") >= threshold)
        edges = stored(close.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "nn-edges")
        labels = components(edges)
        stuck = close.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k")).where(f"n >= {LARGEST} and n >= k").select("node")
        dense = stored(labels.join(stuck, "node").select("component").distinct(), "nn-dense")
        members = labels.join(dense, "component").join(nodes.select("node", "weight", "v"), "node")
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        weights = nodes.select(F.col("node").alias("other"), "weight")
        counted = both.join(labels.join(dense, "component", "left_anti"), "node").join(weights, "other").groupBy("node").agg(F.sum("weight").alias("n_links"), F.count(F.lit(1)).alias("n_near"))
        links = stored(counted.unionByName(_summed(_block_links(members, threshold))), "nn-links")
        sample = links.join(F.broadcast(base.sparkSession.createDataFrame([(n,) for n in truth], "node long")), "node", "left_semi")
        if _holds(truth, {r["node"]: r["n_near"] for r in sample.collect()}):
            break
    else:
        labels, links = _all_links(nodes, threshold)
    reached = nodes.select("node", "weight", "first_key").join(labels, "node", "left").withColumn("_label", F.coalesce("component", "node"))
    smallest = reached.groupBy("_label").agg(F.min("first_key").alias("component_id"))
    final = reached.join(smallest, "_label").join(links, "node", "left")
    final = final.select("node", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = base.select("_key", "node").join(final, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("_key")).otherwise(F.col("component_id"))
    return out.select(
        F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("_key") == component, component.isNull()).alias("kept"),
    )
