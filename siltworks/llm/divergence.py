"""How the sources of a language differ in their words, over every term and every pair of sources.

Single-pass in-memory indexing: a task builds the postings of a block (term, source, occurrences) in memory until it is full
and spills them as runs sorted by term, one per hash shard, cut into pages.  A shard merges its runs with a heap: pages come
in the order of their first terms, so only pages that overlap are open at a time, whatever the shard's size is.  What
leaves the merge are the frequencies of the terms that enough documents have.

Pairs of sources then cost no more than what they share.  With p0 the share of a term that a source lacks, the sum over all
terms is that of two sources without any term, plus a term for every count of either source (few counts are distinct), plus
corrections for terms that both have.  The corrections are streamed term by term into one sum per pair and buffer.
All of it is whole-number arithmetic.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.llm.common import stored, text_of

BLOCK_POSTINGS = 1_500_000  # entries of (term, document) a block holds
BLOCK_TERMS = 300_000  # distinct terms a block holds
PAGE = 50_000  # postings a page holds, about
PAIRS = 2_000_000  # pairs of postings that are worked out at a time
BUFFER = 200_000  # postings that are looked at together
SCALE = 1_000_000_000

RUNS = "shard int, lang string, first binary, terms binary, docs binary, sources_of binary, source binary, n binary, names array<string>"
FREQUENCIES = "lang string, term string, source string, n long, total long"

# Fixed by the contract: terms are runs of ASCII letters and of all characters beyond ASCII; A-Z count as a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _press(numbers: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(np.asarray(numbers).astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpress(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


class _Block:
    """Postings of the documents since the last spill."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.term, self.group, self.n = [], [], []
        self.size = 0

    def add(self, lang: str, source: str, words: list[bytes]) -> None:
        if not words:
            return
        place = self.terms
        ids = np.fromiter((place.setdefault(w, len(place)) for w in words), dtype=np.int64, count=len(words))
        ids, n = np.unique(ids, return_counts=True)
        self.term.append(ids)
        self.n.append(n)
        self.group.append(np.full(len(ids), self.groups.setdefault((lang, source), len(self.groups)), dtype=np.int64))
        self.size += len(ids)

    def runs(self, shards: int) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        words, groups = list(self.terms), list(self.groups)
        by_name = sorted(range(len(words)), key=words.__getitem__)
        rank = np.empty(len(words), dtype=np.int64)
        rank[by_name] = np.arange(len(words))
        shard_of = np.fromiter((xxhash.xxh32_intdigest(w) % shards for w in words), dtype=np.int64, count=len(words))
        langs = sorted({x for x, _ in groups}, key=str.encode)
        lang_place = {x: i for i, x in enumerate(langs)}
        lang_of = np.array([lang_place[x] for x, _ in groups])
        term, group, n = np.concatenate(self.term), np.concatenate(self.group), np.concatenate(self.n)
        order = np.lexsort((group, rank[term], lang_of[group], shard_of[term]))
        term, group, n = term[order], group[order], n[order]
        new = np.concatenate([[True], (term[1:] != term[:-1]) | (group[1:] != group[:-1])])
        at = np.flatnonzero(new)
        docs = np.diff(np.append(at, len(term)))  # a document has one entry a term
        n, term, group = np.add.reduceat(n, at), term[at], group[at]
        # a page never crosses a shard or a language, nor parts a term
        part = shard_of[term] * len(langs) + lang_of[group]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
        for a, z in zip(starts, [*starts[1:], len(term)], strict=True):
            while a < z:
                e = min(a + PAGE, z)
                while e < z and term[e] == term[e - 1]:
                    e += 1
                yield self._page(int(shard_of[term[a]]), langs[lang_of[group[a]]], words, groups, term[a:e], group[a:e], n[a:e], docs[a:e])
                a = e

    @staticmethod
    def _page(shard: int, lang: str, words: list[bytes], groups: list[tuple[str, str]], term, group, n, docs) -> pa.RecordBatch:
        at = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        own = [words[i] for i in term[at].tolist()]
        used, source = np.unique(group, return_inverse=True)
        row = (
            shard, lang, own[0], zstandard.ZstdCompressor(level=1).compress(b" ".join(own)), _press(np.add.reduceat(docs, at)),
            _press(np.diff(np.append(at, len(term)))), _press(source), _press(n), [groups[g][1] for g in used.tolist()],
        )
        kinds = (pa.int32(), pa.string(), *[pa.binary()] * 6, pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in RUNS.split(", ")])


def _index(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    block = _Block()
    for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
        for text, lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            block.add(lang, source, text.encode().translate(_TABLE).split())
            if block.size >= BLOCK_POSTINGS or len(block.terms) >= BLOCK_TERMS:
                yield from block.runs(shards)
                block = _Block()
    yield from block.runs(shards)


def _opened(row: dict) -> Iterator[tuple[bytes, int, list[tuple[str, int]]]]:
    """(term, documents, [(source, occurrences)]) of a page, in the order of terms."""
    terms = zstandard.ZstdDecompressor().decompress(row["terms"]).split(b" ")
    docs, sizes = _unpress(row["docs"]).tolist(), _unpress(row["sources_of"]).tolist()
    source, n, names = _unpress(row["source"]).tolist(), _unpress(row["n"]).tolist(), row["names"]
    at = 0
    for term, d, k in zip(terms, docs, sizes, strict=True):
        yield term, d, [(names[s], c) for s, c in zip(source[at : at + k], n[at : at + k], strict=True)]
        at += k


def merged(pages: Iterator[dict]) -> Iterator[tuple[tuple[int, bytes, bytes], int, dict[str, int]]]:
    """((shard, lang, term), documents, occurrences by source) out of pages in the order of (shard, lang, first term).

    A page is opened when the merge has come to its first term, and is gone after its last."""
    heap: list[tuple] = []
    opened = 0
    waiting = next(pages, None)
    key, docs, counts = None, 0, {}
    while heap or waiting is not None:
        while waiting is not None:
            first = (waiting["shard"], waiting["lang"].encode(), bytes(waiting["first"]))
            if heap and heap[0][0] < first:
                break
            rows = _opened(waiting)
            heapq.heappush(heap, (first, opened, next(rows), rows))
            opened += 1
            waiting = next(pages, None)
        at, number, (_, d, postings), rows = heap[0]
        if at != key:
            if key is not None:
                yield key, docs, counts
            key, docs, counts = at, 0, {}
        docs += d
        for source, n in postings:
            counts[source] = counts.get(source, 0) + n
        following = next(rows, None)
        if following is None:
            heapq.heappop(heap)
        else:
            heapq.heapreplace(heap, ((*at[:2], following[0]), number, following, rows))
    if key is not None:
        yield key, docs, counts


def _merge(batches: Iterator[pa.RecordBatch], least_docs: int) -> Iterator[pa.RecordBatch]:
    pages = (row for b in batches for k in range(b.num_rows) for row in b.slice(k, 1).to_pylist())
    names = [x.split()[0] for x in FREQUENCIES.split(", ")]
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    out: list[tuple] = []
    for (_, lang, term), docs, counts in merged(pages):
        if docs >= least_docs:
            total = sum(counts.values())
            out += [(lang.decode(), term.decode(), s, n, total) for s, n in counts.items()]
        if len(out) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _shards(spark: SparkSession) -> int:
    """As many shards as the cluster is set to shuffle into; a merge streams, so a shard may be of any size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def frequencies(docs: DataFrame, least_docs: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, term, source, n, total): occurrences of each kept term in each source that has it, and in the whole language.

    A language keeps the terms that at least `least_docs` of its documents have.  Nulls are read as ''."""
    shards = _shards(docs.sparkSession)
    rows = docs.select(text_of(text).alias("t"), text_of(lang).alias("l"), text_of(source).alias("s"))
    runs = stored(rows.mapInArrow(lambda it: _index(it, shards), RUNS), "term-runs")
    ordered = runs.repartition(shards, "shard").sortWithinPartitions("shard", "lang", "first")
    return stored(ordered.mapInArrow(lambda it: _merge(it, least_docs), FREQUENCIES), "term-frequencies")


def _div(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """floor((a - b)^2 / (a + b)); shares are at most SCALE + 1, so that squares have room in 64 bits."""
    return (a - b) ** 2 // (a + b)


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, h, extra), g < h: what terms that both sources have add to the sum; rows in the order of (lang, term)."""

    def work(g: np.ndarray, p: np.ndarray, p0: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        """ends: for each posting, where its term's postings end."""
        names, place = np.unique(g, return_inverse=True)
        later = ends - np.arange(len(g)) - 1
        a = 0
        upto = np.cumsum(later)
        while a < len(g):
            z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
            left = np.repeat(np.arange(a, z), later[a:z])
            if len(left):
                first = np.cumsum(later[a:z]) - later[a:z]
                right = np.arange(len(left)) - np.repeat(first, later[a:z]) + left + 1
                extra = _div(p[left], p[right]) - _div(p[left], p0[right]) - _div(p0[left], p[right]) + _div(p0[left], p0[right])
                x, y = place[left], place[right]
                pair = np.minimum(x, y) * len(names) + np.maximum(x, y)
                codes, which = np.unique(pair, return_inverse=True)
                # sums of halves are exact in doubles: a half is below 2^20 and 2^40, pairs are below 2^32
                high, low = (np.bincount(which, part.astype(float), len(codes)).astype(np.int64) for part in (extra >> 20, extra & ((1 << 20) - 1)))
                yield pa.RecordBatch.from_arrays([pa.array(names[codes // len(names)]), pa.array(names[codes % len(names)]), pa.array((high << 20) + low)], names=["g", "h", "extra"])
            a = z

    def flush(held: list[pa.RecordBatch], last: bool):
        t = pa.Table.from_batches(held)
        g, p, p0, new = (t.column(c).to_numpy() for c in ("g", "p", "p0", "term_no"))
        starts = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]]))
        cut = len(g) if last else int(starts[-1])  # the last term may go on
        sizes = np.diff(np.append(starts, len(g)))
        ends = np.repeat(starts + sizes, sizes)
        rest = [] if cut == len(g) else t.slice(cut).combine_chunks().to_batches()
        return work(g[:cut], p[:cut], p0[:cut], ends[:cut]), rest

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BUFFER:
            made, held = flush(held, False)
            yield from made
    if sum(b.num_rows for b in held):
        yield from flush(held, True)[0]


def _share(n: Column, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), in decimals, which hold any count."""
    top = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.expr("1L") + F.call_function("div", top, (F.col(total) + 2 * F.col(terms)).cast("decimal(20,0)"))


def _apart(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part `pair`: how far a source is from each other source of its language, over all kept terms of the language.  Part
    `term`: the `top` terms that set a source apart from its language by being more frequent in it.  Nulls are read as ''.
    A source without terms is a source.  Ties rank by item.  Repeated rows count as often as they occur.  An empty table
    gives an empty table; a language without kept terms has pairs of value 0.
    """
    found = frequencies(docs, least_docs, text, lang, source)
    groups = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source")).distinct()
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    terms = found.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("all"))
    groups = groups.join(sums, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["size", "v", "all"])
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), "size", "v")))
    groups = stored(groups.withColumn("g", F.monotonically_increasing_id()), "term-groups")

    known = found.join(groups.select("lang", "source", "g", "size", "v", "all", "p0"), ["lang", "source"])
    known = known.withColumns({"p": _share(F.col("n"), "size", "v"), "q": _share(F.col("total"), "all", "v")})
    known = stored(known.select("lang", "source", "term", "g", "n", "p", "p0", "q"), "term-shares")

    # distinct terms lie apart by a hash of language and term; equal hashes of two terms would have to be neighbours to matter
    ordered = known.repartition("lang", "term").sortWithinPartitions("lang", "term")
    numbered = ordered.select("g", "p", "p0", F.xxhash64(F.struct("lang", "term")).alias("term_no"))
    extras = numbered.mapInArrow(_corrections, "g long, h long, extra long").groupBy("g", "h").agg(F.sum("extra").alias("extra"))

    counts = known.groupBy("lang", "g", "p", "p0").agg(F.count(F.lit(1)).alias("terms"))
    others = groups.select("lang", F.col("g").alias("h"), F.col("p0").alias("q0"))
    single = counts.join(others, "lang").where("g <> h").select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"), (F.col("terms") * (_apart("p", "q0") - _apart("p0", "q0"))).alias("single"))
    single = single.groupBy("g", "h").agg(F.sum("single").alias("single"))

    left = groups.select("lang", "v", "g", "p0", F.col("source").alias("a"))
    right = groups.select("lang", F.col("g").alias("h"), F.col("p0").alias("q0"), F.col("source").alias("b"))
    pairs = left.join(right, "lang").where("g < h").join(single, ["g", "h"], "left").join(extras, ["g", "h"], "left")
    none = F.lit(0).cast("long")
    pairs = pairs.withColumn("value", F.coalesce(F.col("v") * _apart("p0", "q0"), none) + F.coalesce("single", none) + F.coalesce("extra", none))
    both = pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pair_rows = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", rank)
    term_rows = known.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value"))
    return pair_rows.unionByName(term_rows.withColumn("rank", rank).where(F.col("rank") <= top))
