"""Mixing overlapping sources to target weights by a minimum-cost flow.

Documents are summed by membership pattern (the set of sources they belong to).  A flow then carries words from patterns
to source quotas: the first use of a pattern's words is free and every further repetition costs more, so repetition
is spread before it is deepened.  What a pattern has to give is finally taken from whole documents in a seeded order.

Only one row per pattern and one per source reach the driver.  Sources are the names of a mixture, a short list by
nature; documents stay distributed, and a pattern that holds a third of them is spread over `BUCKETS` hash buckets.
"""

from __future__ import annotations

import json
from collections import defaultdict, deque
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.common import WORD, row_back, stored, whole_row

BUCKETS = 4096
RESULTS = ("copies", "taken", "for_source", "source_size", "target")


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: Mapping, weights: Mapping, total: float, most: float) -> dict:
    """Share `total` by weight; nothing gets over `most` times its size, the excess is shared again by weight."""
    targets, open_, rest = {k: 0.0 for k in sizes}, [k for k in sizes if sizes[k] > 0 and weights[k] > 0], float(total)
    while open_:
        share = rest / sum(weights[k] for k in open_)
        full = [k for k in open_ if share * weights[k] > most * sizes[k]]
        if not full:
            targets.update({k: share * weights[k] for k in open_})
            break
        for k in full:
            targets[k] = float(most * sizes[k])
            rest -= targets[k]
        open_ = [k for k in open_ if k not in set(full)]
    return targets


class _Flow:
    """Successive shortest paths on a small integer network."""

    def __init__(self) -> None:
        self.out: dict = defaultdict(list)
        self.edges: list[list] = []  # [to, capacity left, cost]

    def add(self, a, b, capacity: int, cost: int) -> int:
        self.edges += [[b, capacity, cost], [a, 0, -cost]]
        self.out[a].append(len(self.edges) - 2)
        self.out[b].append(len(self.edges) - 1)
        return len(self.edges) - 2

    def cheapest(self, start, end) -> list[int] | None:
        far, via, queue, waiting = {start: 0}, {}, deque([start]), {start}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in self.out[a]:
                b, left, cost = self.edges[e]
                if left and far[a] + cost < far.get(b, 1 << 60):
                    far[b], via[b] = far[a] + cost, e
                    if b not in waiting:
                        waiting.add(b)
                        queue.append(b)
        if end not in far:
            return None
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = self.edges[via[at] ^ 1][0]
        return path

    def run(self, start, end) -> None:
        while path := self.cheapest(start, end):
            least = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= least
                self.edges[e ^ 1][1] += least


def route(capacity: Mapping[str, int], members: Mapping[str, Sequence], quotas: Mapping, most: int) -> dict[str, dict]:
    """Words each pattern gives to each source: a maximum flow of least repetition cost.

    The r-th use of a pattern's words costs (r - 1) squared a word, which is convex."""
    net, pipes = _Flow(), {}
    for p in sorted(capacity):
        for r in range(most):
            net.add("from", ("p", p), int(capacity[p]), r * r)
        for s in members[p]:
            pipes[p, s] = net.add(("p", p), ("s", s), 1 << 62, 0)
    for s, quota in quotas.items():
        net.add(("s", s), "to", int(quota), 0)
    net.run("from", "to")
    given: dict[str, dict] = {p: {} for p in capacity}
    for (p, s), e in pipes.items():
        given[p][s] = net.edges[e ^ 1][1]
    return given


def by_code_point(names) -> list:
    return sorted(names, key=lambda s: (s is None, "" if s is None else s))


def cycled_weights(names, weights: Sequence[float] = (5, 2, 1)) -> dict:
    """Weights dealt in turn to the sources by code point, null last."""
    return {s: weights[i % len(weights)] for i, s in enumerate(by_code_point(names))}


def mix(docs: DataFrame, size: str, sources: str, seed: int = 17, most: int = 3, weights=cycled_weights, share: float = 1.0, key: str = "doc_id") -> DataFrame:
    """`docs` with `copies` (0 to `most`), `taken` (copies times size), `for_source` and the targets of their sources.

    size: a long column.  sources: an array column, the sources a document belongs to; null or empty is a source of its
    own named null, as is a null element.  weights: a function from the source names to their weights.
    share: the part of all words that the mix has.  The order in which documents of a pattern are taken is that of a
    seeded hash of `key`, then key and size, so equal input gives equal output; equal rows are interchangeable.
    A document of size 0 takes nothing.  An empty table gives an empty table.  The results replace columns of their names.
    """
    spark = docs.sparkSession
    listed = F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, F.array_sort(F.array_distinct(sources))).otherwise(F.array(F.lit(None).cast("string")))
    # to_json keeps a null element apart from the text "null"
    base = docs.select(
        whole_row(docs), F.col(key).alias("_key"), F.to_json(listed).alias("_pattern"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"),
        F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(BUCKETS)).alias("_bucket"),
    )
    sums = base.groupBy("_pattern", "_bucket").agg(F.sum("_size").alias("w"))
    sums = stored(sums, "mix-sums")
    capacity = {r["_pattern"]: r["w"] for r in sums.groupBy("_pattern").agg(F.sum("w").alias("w")).collect()}
    members = {p: json.loads(p) for p in capacity}
    sizes: dict = defaultdict(int)
    for p, names in members.items():
        for s in names:
            sizes[s] += capacity[p]
    targets = capped_targets(sizes, weights(sizes), share * sum(capacity.values()), most)
    given = route(capacity, members, {s: round(targets[s]) for s in by_code_point(sizes)}, most)

    rows, routes = [], []
    for p in capacity:
        words = sum(given[p].values())
        whole = min(words // capacity[p], most) if capacity[p] else 0
        rows.append((p, int(whole), int(words - whole * capacity[p])))
        at = 0
        for s in members[p]:
            routes.append((p, s, at / words if words else 0.0, (at := at + given[p][s]) / words if words else 1.0, sizes[s], float(targets[s])))
    plan = spark.createDataFrame(rows, "_pattern string, _whole long, _extra long")
    running = Window.partitionBy("_pattern").orderBy("_bucket")
    edge = (
        sums.withColumn("_upto", F.sum("w").over(running)).join(F.broadcast(plan), "_pattern")
        .where("_upto >= _extra and _upto - w < _extra")
        .select("_pattern", F.col("_bucket").alias("_edge"), (F.col("_upto") - F.col("w")).alias("_before"))
        .groupBy("_pattern").agg(F.min("_edge").alias("_edge"), F.min_by("_before", "_edge").alias("_before"))
    )
    # one row per pattern, as many as the flow had
    placed = base.join(F.broadcast(plan), "_pattern").join(F.broadcast(edge), "_pattern", "left")
    at_edge = F.coalesce(F.col("_bucket") == F.col("_edge"), F.lit(False))
    order = Window.partitionBy("_pattern").orderBy(F.xxhash64("_key", F.lit(seed)), "_key", "_size")
    outside = placed.where(~at_edge).withColumn("_more", F.coalesce(F.col("_bucket") < F.col("_edge"), F.lit(False)).cast("int"))
    # of the bucket in which the quota ends, documents as long as more than half of them fits
    inside = placed.where(at_edge).withColumn("_cum", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.withColumn("_more", (2 * (F.col("_before") + F.col("_cum")) - F.col("_size") <= 2 * F.col("_extra")).cast("int")).drop("_cum")
    chosen = outside.unionByName(inside)
    chosen = chosen.withColumn("copies", F.least(F.col("_whole") + F.col("_more"), F.lit(most)))
    # which of its sources a document serves: by the parts of the pattern's flow
    routed = spark.createDataFrame(routes, "_pattern string, for_source string, _lo double, _hi double, source_size long, target double")
    point = F.pmod(F.xxhash64("_key", F.lit(seed + 1)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    single = F.array_sort(F.collect_list(F.struct("_hi", "for_source", "source_size", "target")))
    per = routed.where("_hi > _lo or _hi = 1").groupBy("_pattern").agg(single.alias("_routes"))
    chosen = chosen.join(F.broadcast(per), "_pattern", "left").withColumn("_at", F.filter("_routes", lambda r: r["_hi"] > point)[0])
    return chosen.select(
        *row_back(docs, RESULTS), "copies", (F.col("copies") * F.col("_size")).alias("taken"),
        F.col("_at.for_source").alias("for_source"), F.col("_at.source_size").alias("source_size"), F.col("_at.target").alias("target"),
    )
