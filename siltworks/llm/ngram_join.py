"""Near copies by the Jaccard similarity of word n-grams: an exact join with vertical partitioning.

N-grams are ordered by hash, and the order is cut into fragments.  The overlap of two documents is the sum of the overlaps of
their fragments, each counted by itself, so no count needs a whole long document.

What is compared is narrowed without losing a pair.  A pair over the threshold t shares all but (1 - t) of either set.

1. Documents with equal sets are one node.
2. Peeling: of a node's n-grams in the first part of the order, all but (1 - t) of its whole set must occur in another node.
   Blocks of documents send each distinct n-gram once to its key range, which answers by a bit: another node has it.
3. Of the nodes left, n-grams that no other has are set aside; each counts against its node.  What a pair over the
   threshold may differ in is then a small number B.  The order is cut into 1, 2, 4, ... fragments; once a node has more
   than B fragments with n-grams in them, one of these must be equal in both.  So nodes are listed by their whole
   fragments, at every cut up to the one that is fine enough for them, and a pair is taken from the coarsest cut that is
   fine enough for it.  A passage or a word that many documents share makes no list: all of a fragment must agree.
4. A list is not expanded into pairs: its members are compared with a few leaders, those with the fewest n-grams of their
   own, and lists whose members have come into one component are closed.  Rounds go on while they find links and until the
   members outside the largest component of their list make no more pairs than the lists have members, `ROUNDS` at most; these
   pairs are then compared one by one, a long list block by block, each in one of the lists it shares.  So every link either is found or joins two nodes that are already connected.

N-grams are known by 48-bit hashes, sets by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import components, stored
from siltworks.llm.exchange import FAN, SEVERAL, answers_of, cuts, exchange, merged

PROBED = 0.3  # the first part of the order, by which nodes are peeled; must be over 1 - threshold
BLOCK, BLOCK_DOCS = 300_000, 20_000  # n-grams and documents a block has
SPAN = 500_000  # n-grams a key range gets, about
SIEVE_BITS = 1 << 25
STRIPS = 256
MEMO = 100_000  # hashes of words a task remembers
FRAGMENTS = 4
ROUNDS, LEADERS = 4, 1  # rounds of comparison with leaders, at most, and leaders of a list in each
LIST = 256  # members of a list that meet at a time
_TOP = 1 << 48


def grams(words: list[bytes], width: int, hashes: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct 48-bit hashes of the n-grams; of a shorter text the whole sequence is one; none without words."""
    if not words:
        return np.zeros(0, dtype=np.int64)
    for w in set(words):
        if w not in hashes:
            hashes[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(width, len(h))
    total = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total = (total ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(29)
    return np.unique(total >> np.uint64(16)).astype(np.int64)


def _six(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    low = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, :6] = low
    return wide.view(np.int64).ravel()


SETS = "block long, doc_ids array<long>, texts array<long>, nodes array<long>, sizes array<long>, lengths array<long>, keys binary"
BLOCKS = "block long, nodes array<long>, lengths array<long>, keys binary"


def _sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Blocks of documents: doc_id, hash of the text, node (the hash of the set) and size of each, and the first part of its
    set, `lengths` long."""
    limit = int(PROBED * _TOP)
    names = [x.split()[0] for x in SETS.split(", ")]

    def block(number: int, rows: list[tuple]) -> pa.RecordBatch:
        *columns, parts = zip(*rows, strict=True)
        values = [[number], *([c] for c in columns), [[len(x) // 6 for x in parts]]]
        arrays = [pa.array(v, pa.list_(pa.int64()) if i else pa.int64()) for i, v in enumerate(values)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([b"".join(parts)], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[bytes, int] = {}
        number, rows, held = TaskContext.get().partitionId() << 32, [], 0
        for part in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                raw = (t or "").encode()
                g = grams(raw.lower().split(), width, hashes)
                first = _six(g[: np.searchsorted(g, limit)])
                names_ = (int(np.uint64(x).astype(np.int64)) for x in (xxhash.xxh64_intdigest(raw, 42), xxhash.xxh64_intdigest(g.tobytes())))
                rows.append((i, *names_, len(g), first))
                held += len(first) // 6
                if held >= BLOCK or len(rows) >= BLOCK_DOCS:
                    yield block(number, rows)
                    number, rows, held = number + 1, [], 0
            if len(hashes) > MEMO:
                hashes = {}
        if rows:
            yield block(number, rows)

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, SETS)


def _blocks(fragments: DataFrame) -> DataFrame:
    """The fragments' n-grams as blocks; a node may be in several, with other n-grams in each."""

    def block(number: int, nodes: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
        lists = [pa.array([v], pa.list_(pa.int64())) for v in (nodes, [len(k) for k in keys])]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([_six(np.concatenate(keys))], pa.binary())], names=[x.split()[0] for x in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, nodes, keys, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for node, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if len(raw.values):
                    nodes.append(node)
                    keys.append(raw.values.to_numpy())
                    held += len(keys[-1])
                if held >= BLOCK:
                    yield block(number, nodes, keys)
                    number, nodes, keys, held = number + 1, [], [], 0
        if nodes:
            yield block(number, nodes, keys)

    return stored(fragments.select("node", "grams").mapInArrow(run, BLOCKS), "gram-blocks")


def _wide(raw: bytes) -> np.ndarray:
    """Keys of the exchange: the 48 bits on top."""
    return _from_six(raw).view(np.uint64) << np.uint64(16)


def _asks(row: dict) -> tuple[int, np.ndarray, np.ndarray]:
    owners = np.repeat(np.asarray(row["nodes"], dtype=np.int64), row["lengths"])
    return row["block"], *merged(_wide(row["keys"]), owners[:, None], SEVERAL)


def _shared(blocks: DataFrame, total: int, which: bool) -> DataFrame:
    """(node, k) or, with `which`, (node, grams): how many or which of a node's n-grams another node has as well.

    A row for every row of a block that has n-grams; `total`: how many n-grams there are in all."""
    spans = max(1, total // SPAN)
    answers = exchange(blocks, _asks, SEVERAL, spans, FAN)
    ranges = cuts(spans, FAN)

    def finish(asked: pa.Table, answered: pa.Table) -> pa.Table:
        nodes, counts, found = [], [], []
        replies = answered.to_pylist()
        for row in asked.to_pylist():
            keys = _wide(row["keys"])
            if len(keys):
                distinct = np.unique(keys)
                shared = answers_of(distinct, replies, SEVERAL, ranges)[np.searchsorted(distinct, keys)]
                for node, n, part, mine in zip(row["nodes"], row["lengths"], *(np.split(x, np.cumsum(row["lengths"])[:-1]) for x in (keys, shared)), strict=True):
                    if n:
                        nodes.append(node)
                        counts.append(int(np.count_nonzero(mine)))
                        found.append(_six((part[mine] >> np.uint64(16)).astype(np.int64)) if which else None)
        second = pa.array(found, pa.binary()) if which else pa.array(counts, pa.int64())
        return pa.table([pa.array(nodes, pa.int64()), second], names=["node", "grams" if which else "k"])

    kind = "node long, grams binary" if which else "node long, k long"
    return blocks.select("block", "nodes", "lengths", "keys").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, kind)


def _sieve(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids, of a fixed size whatever their number: it lets all of them pass, and few others."""
    h = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(SIEVE_BITS))
    words = ids.select(h.alias("h")).selectExpr("shiftright(h, 5) as w", "shiftleft(1L, cast(h & 31 as int)) as bit")
    got = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()
    sieve = np.zeros(SIEVE_BITS // 32, dtype=np.uint32)
    sieve[got["w"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return sieve


def _fragments(docs: DataFrame, key: str, text: str, width: int, sieve: np.ndarray) -> DataFrame:
    """(doc_id, node, n, fragment, grams, sizes): the sets of the documents that pass the sieve, cut along the order of
    n-grams; sizes, at the first fragment: how many n-grams each of `STRIPS` strips of the order has."""
    edges = np.array([_TOP * k // FRAGMENTS for k in range(1, FRAGMENTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[bytes, int] = {}
        for batch in batches:
            h = batch.column("h").to_numpy()
            batch = batch.filter(pa.array((sieve[h >> 5] >> (h & 31).astype(np.uint32) & 1).astype(bool)))
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                doc, node, n, fragment, parts, sizes = [], [], [], [], [], []
                for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    g = grams((t or "").encode().lower().split(), width, hashes)
                    for f, piece in enumerate(np.split(g, np.searchsorted(g, edges))):
                        for column, v in ((doc, i), (node, np.uint64(xxhash.xxh64_intdigest(g.tobytes())).astype(np.int64)), (n, len(g)), (fragment, f), (parts, piece)):
                            column.append(v)
                        sizes.append(None if f else np.bincount(g // (_TOP // STRIPS), minlength=STRIPS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(fragment, pa.int32()), pa.array(parts, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))],
                    names=["doc_id", "node", "n", "fragment", "grams", "sizes"],
                )
                hashes = {} if len(hashes) > MEMO else hashes

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(SIEVE_BITS)).alias("h"), F.col(text).alias("text"))
    return rows.where("doc_id is not null").mapInArrow(run, "doc_id long, node long, n long, fragment int, grams array<long>, sizes array<int>")


def _signatures(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Each node's fragments at every cut it needs, as hashes; before: its fragments at the cut before."""
    for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
        out: list[list] = [[], [], [], [], []]
        for node, n, raw in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "grams")), strict=True):
            g = np.sort(_from_six(b"".join(raw)))
            own = n - len(g)
            # the best a partner could be: as large as the threshold allows, with no n-gram of its own
            spare = (n + n * 100 // percent) * (100 - percent) // (100 + percent) - own
            if spare < 0:
                continue
            mixed = g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            before, level = -1, 0
            while before <= spare and level <= 48:
                fragment = g >> (48 - level)
                starts = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
                salt = (fragment[starts].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(level)
                key = np.add.reduceat(mixed, starts) ^ salt
                key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                out[0].append((key ^ (key >> np.uint64(32))).astype(np.int64))
                for column, v in zip(out[1:], (node, n, own, before), strict=True):
                    column.append(np.full(len(starts), v, dtype=np.int64))
                before, level = len(starts), level + 1
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "node", "n", "own", "before"])


def _budget(n, m, own, other_own, percent: int):
    """How many shared n-grams two nodes may differ in, of those that other nodes have; below 0 they cannot link."""
    return F.floor((n + m) * (100 - percent) / F.lit(100.0 + percent) + 1e-9).cast("long") - own - other_own


def _lists(fragments: DataFrame, percent: int) -> DataFrame:
    """(gram, node, n, own, before): the lists of nodes with an equal fragment, those with two members that might link."""
    total = fragments.agg(F.sum(F.size("grams"))).first()[0] or 0
    shared = _shared(_blocks(fragments), total, True)
    # a node has its n-grams in FRAGMENTS rows at most
    shared = shared.groupBy("node").agg(F.collect_list("grams").alias("grams"))
    sizes = fragments.where("fragment = 0").select("node", "n")
    shared = shared.join(sizes, "node").select("node", "n", "grams")
    rows = shared.mapInArrow(lambda it: _signatures(it, percent), "gram long, node long, n long, own long, before long")
    rows = stored(rows, "gram-signatures")
    best = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("_k"), F.max("n").alias("_n"), F.min("own").alias("_own")).where("_k > 1")
    kept = rows.join(best, "gram").where(F.col("before") <= _budget(F.col("n"), F.col("_n"), F.col("own"), F.col("_own"), percent))
    return kept.select("gram", "node", "n", "own", "before")


def _linked(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs over the threshold: overlaps counted per fragment, then summed.

    Sets that are close have strips of close sizes: the differences of the sizes add up to no more than the sets differ in.
    Only pairs for which that leaves room are counted."""
    strips = lambda x: fragments.where("fragment = 0").select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sizes").alias(f"sizes_{x}"))
    apart = F.aggregate(F.zip_with("sizes_a", "sizes_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda t, d: t + d)
    pairs = pairs.join(strips("a"), "a").join(strips("b"), "b").where((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b")
    side = lambda x: fragments.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), "fragment", F.col("grams").alias(f"grams_{x}"))
    partial = pairs.join(side("a"), "a").join(side("b"), ["b", "fragment"])
    partial = partial.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("common"))
    summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common"))
    return summed.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def _pairs(left: DataFrame, right: DataFrame, percent: int, tested: DataFrame | None) -> DataFrame:
    """Untested pairs of nodes of one list and different components that may link and have no coarser list to be found in."""
    both = left.join(right, [c for c in left.columns if c in right.columns]).where("label <> other_label and node <> other")
    budget = _budget(F.col("n"), F.col("other_n"), F.col("own"), F.col("other_own"), percent)
    # no overlap can be larger than what either has in common with any other node
    common = F.least(F.col("n") - F.col("own"), F.col("other_n") - F.col("other_own"))
    enough = (100 + percent) * common >= percent * (F.col("n") + F.col("other_n"))
    both = both.where((100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")) & enough & (F.greatest("before", "other_before") <= budget))
    if "lists" in left.columns:
        fits = lambda c: F.transform(F.filter(c, lambda e: e["before"] <= budget), lambda e: e["gram"])
        # two members outside meet from both sides: once is enough
        both = both.where((F.col("gram") == F.array_min(F.array_intersect(fits("lists"), fits("other_lists")))) & (~F.col("_outside") | (F.col("node") < F.col("other"))))
    both = both.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    return both if tested is None else both.join(tested, ["a", "b"], "left_anti")


def _dealt(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members outside the largest component and all members of each list, for a join that deals a long list into
    blocks of about `LIST` rows and meets them block by block, so that no key has more than two blocks.

    Members outside are dealt into `_outer` blocks of their own and come to each of the list's `_blocks`; all others come to the
    `_outer` ones alone.  So rows are those of the lists and a part in `LIST` of the pairs there are to compare.

    Each row has all open lists of its node, which are no more than the fragments it was cut into: a pair of nodes with several
    lists in common is taken from the least of them alone."""
    parts = {n: F.ceil(F.col(c) / LIST).cast("int") for n, c in (("_blocks", "_all"), ("_outer", "_out"))}
    salted = open_.withColumns(parts).withColumn("_hash", F.xxhash64("node"))
    salted = salted.join(open_.groupBy("node").agg(F.collect_list(F.struct("gram", "before")).alias("lists")), "node")
    own, every = (lambda n: F.pmod("_hash", n).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    left = salted.where("label <> _top").select("gram", own("_outer").alias("_a"), every("_blocks").alias("_b"), *MEMBER, "lists")
    right = salted.select("gram", every("_outer").alias("_a"), own("_blocks").alias("_b"), *_as_other(), F.col("lists").alias("other_lists"), (F.col("label") != F.col("_top")).alias("_outside"))
    return left, right


MEMBER = ("node", "n", "own", "before", "label")


def _as_other(name: str | None = None) -> list:
    return [F.col(f"{name}.{c}" if name else c).alias("other" if c == "node" else f"other_{c}") for c in MEMBER]


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash): one row per row of `docs`; text_hash is xxhash64 of the text, as Spark has it.

    Words are separated by ASCII white space and lower-cased in A-Z.  Documents link when their sets' intersection is at
    least `percent` per cent of the union; component_id is the smallest doc_id reachable.  A text without words (null, empty)
    links with nothing.  A row with a null doc_id links only with its exact copies, whose smallest id it gets, else null.
    Repeated rows are copies.  An empty table gives an empty table.
    """
    if 100 * (1 - PROBED) >= percent:
        raise ValueError(f"percent must be over {100 * (1 - PROBED)}")
    blocks = stored(_sets(docs, key, text, width), "gram-sets")
    each = F.explode(F.arrays_zip("doc_ids", "texts", "nodes", "sizes", "lengths")).alias("x")
    sets = blocks.select(each).select(F.col("x.doc_ids").alias("doc_id"), F.col("x.texts").alias("text_hash"), F.col("x.nodes").alias("node"), F.col("x.sizes").alias("n"), F.col("x.lengths").alias("probed"))
    nodes = sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"), F.max("probed").alias("probed"))
    nodes = stored(nodes, "gram-nodes")
    total = sets.agg(F.sum("probed")).first()[0] or 0
    need = F.col("probed") - (F.col("n") - F.ceil(F.col("n") * percent / F.lit(100.0) - 1e-9).cast("long"))
    # the rows of copies all say the same
    known = _shared(blocks, total, False).groupBy("node").agg(F.max("k").alias("k"))
    left = nodes.join(known, "node", "left").where(F.coalesce("k", F.lit(0)) >= need).where("first_id is not null")
    left = stored(left.select("node", F.col("first_id").alias("doc_id")), "gram-left")
    # texts are read again where they lie; only the sets of nodes that are left move
    fragments = _fragments(docs, key, text, width, _sieve(left.select("doc_id")))
    fragments = stored(fragments.join(left, ["node", "doc_id"], "left_semi").dropDuplicates(["node", "fragment"]).drop("doc_id"), "gram-fragments")
    lists = stored(_lists(fragments, percent), "gram-lists")

    listed = lists.count()
    tested = links = found = None
    labelled = stored(lists.withColumn("label", F.col("node")), "gram-labelled")
    for turn in range(ROUNDS + 1):
        # of each list: its members, and the component that has most of them
        counts = labelled.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("_k"))
        apart = counts.groupBy("gram").agg(F.sum("_k").alias("_all"), F.max(F.struct("_k", "label")).alias("_most")).where("_all > _most._k")
        apart = stored(apart.select("gram", "_all", F.col("_most.label").alias("_top"), (F.col("_all") - F.col("_most._k")).alias("_out")), "gram-apart")
        left_over = apart.agg(F.sum(F.col("_out") * F.col("_all"))).first()[0] or 0
        last = turn == ROUNDS or left_over <= listed or (found is not None and found.isEmpty())
        open_ = labelled.join(apart.select("gram", "_all", "_out", "_top"), "gram")
        if last:  # what is still apart is compared in full, members outside the largest component with all
            left_side, right = _dealt(open_)
        else:  # all members with a leader of each of some groups of components
            bucket = F.pmod(F.xxhash64("label", F.lit(turn)), F.lit(LEADERS))
            lead = F.min_by(F.struct(*MEMBER), F.struct("own", F.xxhash64("node", F.lit(turn)))).alias("_lead")
            left_side, right = open_.drop("_all", "_out", "_top"), open_.groupBy("gram", bucket.alias("_bucket")).agg(lead).select("gram", *_as_other("_lead"))
        pairs = stored(_pairs(left_side, right, percent, tested), "gram-pairs")
        found = stored(_linked(pairs, fragments, percent), "gram-links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        if last:
            break
        known = labels.select("node", F.col("component").alias("_c"))
        labelled = stored(lists.join(known, "node", "left").withColumn("label", F.coalesce("_c", "node")).drop("_c"), "gram-labelled")
    reached = nodes.select("node", "first_id", "rows").join(labels, "node", "left").withColumn("_label", F.coalesce("component", "node"))
    smallest = reached.groupBy("_label").agg(F.min("first_id").alias("component_id"))
    joined = reached.where("component is not null").join(smallest, "_label").select("node", "component_id")
    # nodes of one document and no link need no look-up
    alone = reached.where("component is null and rows > 1").select("node", F.col("first_id").alias("component_id"))
    found = joined.unionByName(alone)
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    return sets.select("doc_id", "text_hash", "n", "node").join(found, "node", "left").select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), component, "text_hash")
