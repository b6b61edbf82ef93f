"""Phrases that many texts repeat, scored as collocations, counted level by level.

Texts are coded once into chunks of one language, each with a dictionary of its own words, and written.  A language's chunks are
dealt into shards of about `SHARD_WORDS` words, whatever the input's partitions are, and written in that order.  Then, for phrases
of 1, 2, ... words:

1. Every shard counts its phrases whose two parts, without the first and without the last word, may be frequent.  A shard is
   sorted in parts, by the highest bits of the hashes, and what is counted leaves the task at once.
2. The counts meet by hash ranges, which keep what has the support in all shards together.
3. The hashes of what they keep are dealt into a bitmap, by which the next level tells what may be frequent.  What is in it by
   chance alone cannot have the support, nor can what contains it: counts are exact.

What a level looks at depends on what is frequent in the whole input and not on how many shards there are.  A phrase's words are
read once, out of a chunk that has it.  Phrases are known by 64-bit hashes of language and words.
"""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.llm.common import stored

CHUNK_WORDS = 400_000  # a text goes on in the next chunk at the end of a piece
SHARD_WORDS = 8_000_000
RANGE_WORDS = 4_000_000  # words of the input a hash range is made for, at least
PARTS = 4  # bits of a hash by which a shard is sorted in parts
BATCH = 4  # chunks, or counts of a shard for a range, that go to Python together: Spark holds a batch outside its heap
READ = 10_000  # phrases whose words are read at a time
SIEVE, SIEVE_MOST = 25, 28  # bits of a hash that the bitmap tells apart, of a small input and of the largest
UNKNOWN = "und"

CHUNKS = "chunk long, lang string, tokens_of long, words_of long, tokens binary, words binary"
COUNTED = "range int, hashes binary, n binary, piece binary, at binary, chunks array<long>"
FREQUENT = "range int, hash long, k int, f long, chunk long, at long"
BITS = "range int, bits binary"
PHRASES = "lang string, phrase string, k int, f long"

# Fixed by the contract: what ends a piece, and white space inside one; all else makes words.
_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b"\t"
_TABLE = bytes.maketrans(_ENDS + _BLANKS, b"." * len(_ENDS) + b" " * len(_BLANKS))
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


class _Places(dict):
    """A number for every distinct word, in the order of their coming; 0 ends a piece, for a full stop is never part of a word."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _pressed(numbers: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpressed(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class _Chunk:
    """Coded texts of one language since the last chunk."""

    def __init__(self) -> None:
        self.places, self.parts, self.size = _Places(), [], 0

    def add(self, words: list[bytes]) -> None:
        ids = np.fromiter(map(self.places.__getitem__, words), dtype=np.uint32, count=len(words))
        # pieces without words say nothing
        self.parts.append(ids[(ids > 0) | np.concatenate([[True], ids[:-1] > 0])])
        self.size += len(words)

    def row(self, number: int, lang: str) -> tuple:
        tokens = np.concatenate(self.parts)
        words = zstandard.ZstdCompressor(level=1).compress(b" ".join(self.places))
        return number, lang, len(tokens), int(np.count_nonzero(tokens)), _pressed(tokens), words


def code(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The texts as written chunks: numbers of words, 0 after every piece, and the chunk's dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, {}
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            for t, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (t or "").encode().lower().translate(_TABLE).replace(b".", b" . ").split()
                words.append(b".")
                at = 0
                while at < len(words):
                    end = len(words) if len(words) - at <= CHUNK_WORDS else words.index(b".", at + CHUNK_WORDS) + 1
                    chunk = held.setdefault(x, _Chunk())
                    chunk.add(words[at:end])
                    at = end
                    if chunk.size >= CHUNK_WORDS:
                        yield _rows([held.pop(x).row(number, x)], CHUNKS)
                        number += 1
            if sum(c.size for c in held.values()) >= 4 * CHUNK_WORDS:  # many languages
                for x, chunk in held.items():
                    yield _rows([chunk.row(number, x)], CHUNKS)
                    number += 1
                held = {}
        for x, chunk in held.items():
            yield _rows([chunk.row(number, x)], CHUNKS)
            number += 1

    return stored(docs.select(F.col(text), F.coalesce(lang, F.lit(UNKNOWN))).mapInArrow(run, CHUNKS), "phrase-chunks")


def _mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ w
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _hashes(row: dict, k: int, sieve: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the phrases of k words in a chunk, those whose parts are in the sieve."""
    words = np.array([xxhash.xxh64_intdigest(w) for w in zstandard.ZstdDecompressor().decompress(row["words"]).split(b" ")], dtype=np.uint64)
    tokens = _unpressed(row["tokens"])
    alive, h = tokens > 0, np.full(len(tokens), np.uint64(xxhash.xxh64_intdigest(row["lang"].encode(), 1)))
    for length in range(1, min(k, len(tokens)) + 1):
        h = _mix(h[: len(tokens) - length + 1], words[tokens[length - 1 :]])
        if length > 1:
            alive = alive[:-1] & alive[1:]
        if length < k:
            at = np.flatnonzero(alive)
            alive[at[~_held(sieve, h[at], bits)]] = False
    at = np.flatnonzero(alive) if k <= len(tokens) else np.zeros(0, np.int64)
    return h[at], at.astype(np.uint32)


def _held(sieve: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    bit = h >> np.uint64(64 - bits)
    return (sieve[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _cuts(keys: np.ndarray, ranges: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of sorted hashes; a range has whole bytes of the bitmap."""
    byte = keys >> np.uint64(67 - bits)
    edges = np.searchsorted(byte, np.array([_first_byte(r, ranges, bits) for r in range(ranges + 1)], dtype=np.uint64))
    for r in np.flatnonzero(np.diff(edges)).tolist():
        yield r, int(edges[r]), int(edges[r + 1])


def _first_byte(r: int, ranges: int, bits: int) -> int:
    return -(-(r << bits - 3) // ranges)


class _Shard:
    """The phrases of a shard's chunks, dealt by the highest bits of their hashes."""

    def __init__(self) -> None:
        self.parts, self.chunks = [[] for _ in range(1 << PARTS)], []

    def add(self, chunk: int, hashes: np.ndarray, at: np.ndarray) -> None:
        part = (hashes >> np.uint64(64 - PARTS)).astype(np.uint8)
        for b, held in enumerate(self.parts):
            mine = np.flatnonzero(part == b)
            held.append((hashes[mine], at[mine]))
        self.chunks.append(chunk)

    def rows(self, ranges: int, bits: int) -> Iterator[pa.RecordBatch]:
        while self.parts:
            held = self.parts.pop()
            starts = np.cumsum([0] + [len(h) for h, _ in held])
            keys, at = (np.concatenate(c) for c in zip(*held, strict=True))
            del held
            order = np.argsort(keys)
            keys = keys[order]
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            n, keys, first = np.diff(np.append(edge, len(keys))), keys[edge], order[edge]
            columns = n, np.searchsorted(starts, first, side="right") - 1, at[first]
            yield _rows([(r, keys[a:z].tobytes(), *(_pressed(c[a:z]) for c in columns), self.chunks) for r, a, z in _cuts(keys, ranges, bits)], COUNTED)


def _tally(batches: Iterator[pa.RecordBatch], k: int, sieve: np.ndarray, ranges: int, bits: int) -> Iterator[pa.RecordBatch]:
    shard, name = _Shard(), None
    for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
        if shard.chunks and name != (row["lang"], row["shard"]):  # the chunks of a shard stand together
            yield from shard.rows(ranges, bits)
            shard = _Shard()
        name = row["lang"], row["shard"]
        shard.add(row["chunk"], *_hashes(row, k, sieve, bits))
    if shard.chunks:
        yield from shard.rows(ranges, bits)


def _sum(t: pa.Table, support: int, k: int) -> pa.Table:
    """The phrases of a range that have the support, each with a place to read it from."""
    keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in t["hashes"]])
    n = np.concatenate([_unpressed(x.as_buffer()) for x in t["n"]])
    starts = np.cumsum([0] + [len(x.as_buffer()) // 8 for x in t["hashes"]])
    order = np.argsort(keys)
    sorted_keys = keys[order]
    edge = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    f = np.add.reduceat(n[order], edge, dtype=np.int64)
    often = f >= support
    first, f = order[edge[often]], f[often]
    turn = np.argsort(first)
    first, f = first[turn], f[turn]
    chunk, at = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
    cuts = np.searchsorted(first, starts)
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        here = slice(cuts[i], cuts[i + 1])
        places = first[here] - starts[i]
        chunk[here] = np.asarray(t["chunks"][i].as_py(), dtype=np.int64)[_unpressed(t["piece"][i].as_buffer())[places]]
        at[here] = _unpressed(t["at"][i].as_buffer())[places]
    columns = [np.full(len(first), t["range"][0].as_py(), np.int32), keys[first].view(np.int64), np.full(len(first), k, np.int32), f, chunk, at]
    return pa.Table.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in FREQUENT.split(", ")])


def _bitmap(t: pa.Table, ranges: int, bits: int) -> pa.Table:
    r = t["range"][0].as_py()
    low, high = (_first_byte(x, ranges, bits) << 3 for x in (r, r + 1))
    held = np.zeros(high - low, dtype=bool)
    held[(t["hash"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) - low] = True
    return pa.Table.from_batches([_rows([(r, np.packbits(held, bitorder="little").tobytes())], BITS)])


def _read(chunk: pa.Table, places: pa.Table) -> pa.Table:
    out = [_rows([], PHRASES)]
    for row in chunk.to_pylist() if len(places) else []:
        words, tokens = zstandard.ZstdDecompressor().decompress(row["words"]).split(b" "), _unpressed(row["tokens"])
        for some in places.to_batches(max_chunksize=READ):
            at, k = some["at"].to_numpy(), some["k"].to_numpy()
            phrases = [b" ".join([words[i] for i in tokens[a:z].tolist()]).decode() for a, z in zip(at.tolist(), (at + k).tolist(), strict=True)]
            out.append(pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(phrases), pa.string()), pa.array(phrases, pa.string()), some["k"], some["f"]], names=out[0].schema.names))
    return pa.Table.from_batches(out)


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def frequent_phrases(docs: DataFrame, support: int = 100, longest: int = 5, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of 1 to `longest` words with f >= support, and (lang, n), the words of each language.

    A-Z is lower-cased; pieces end at . , ; : ! ? and line breaks; words are separated by blanks and tabs; occurrences
    may overlap.  A null text is empty, a null language is `und`.  Repeated rows count as often as they occur.  Empty tables
    give empty tables.  A text longer than a chunk goes on in the next one; a single piece is never cut.
    """
    spark = docs.sparkSession
    chunks = code(docs, text, lang)
    totals = stored(chunks.groupBy("lang").agg(F.sum("words_of").alias("n")).where("n > 0"), "phrase-totals")
    words = totals.agg(F.sum("n")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), words // RANGE_WORDS)
    bits = min(SIEVE_MOST, max(SIEVE, (words // 16).bit_length()))
    # places in the written table, dealt in turn; a small table of languages is broadcast, and Spark sees its size
    turn = F.monotonically_increasing_id() % (1 << 33) + F.spark_partition_id()
    dealt = chunks.withColumn("_turn", turn).join(totals.withColumnRenamed("n", "total"), "lang")
    dealt = dealt.withColumn("shard", F.pmod("_turn", F.ceil(F.col("total") / SHARD_WORDS))).drop("_turn", "total", "tokens_of", "words_of")
    shards = stored(dealt.repartition("lang", "shard").sortWithinPartitions("lang", "shard"), "phrase-shards")

    def level(k: int, sieve: np.ndarray) -> DataFrame:
        counted = shards.mapInArrow(lambda batches: _tally(batches, k, sieve, ranges, bits), COUNTED)
        with _small_batches(spark):
            return stored(counted.groupBy("range").applyInArrow(lambda t: _sum(t, support, k), FREQUENT), "phrase-counts")

    found, sieve = [level(1, np.zeros(0, np.uint8))], np.zeros(1 << bits - 3, np.uint8)
    for k in range(2, longest + 1):
        held = found[-1].groupBy("range").applyInArrow(lambda t: _bitmap(t, ranges, bits), BITS).collect()  # 2^bits in all
        for r, some in held:
            sieve[_first_byte(r, ranges, bits) : _first_byte(r + 1, ranges, bits)] |= np.frombuffer(some, np.uint8)
        if not held:
            break
        found.append(level(k, sieve))
    frequent = functools.reduce(DataFrame.unionByName, found)
    phrases = shards.groupBy("chunk").cogroup(frequent.groupBy("chunk")).applyInArrow(_read, PHRASES)
    return stored(phrases, "phrases"), totals


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def collocations(docs: DataFrame, support: int = 100, longest: int = 5, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 words or more.

    A phrase with a occurrences is cut in two where floor(1000 * a * n / (l * r)) is lowest, ties at the earliest cut; l and r are the
    occurrences of its parts.  A phrase as frequent as a longer one that holds it goes.  Ranked by score, a, then phrase.
    """
    phrases, totals = frequent_phrases(docs, support, longest, text, lang)
    several = phrases.where("k > 1").withColumnRenamed("f", "a")
    parts = F.split(F.col("phrase"), " ")
    # a phrase contained in one as frequent is contained in one of one word more that is as frequent
    shorter = several.where("k > 2").select("lang", "a", F.explode(F.array(
        F.array_join(F.slice(parts, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(parts, F.lit(2), F.col("k") - 1), " "))).alias("phrase")).distinct()
    kept = several.join(shorter, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice(parts, F.lit(1), F.col("cut")), " ").alias("left"),
        F.array_join(F.slice(parts, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"),
    )
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    scored = cuts.withColumns({"_top": (_wide("a") * F.lit(1000).cast("decimal(4,0)")) * _wide("n"), "_low": _wide("l") * _wide("r")}).withColumn("score", F.expr("_top div _low"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "n", "x.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
