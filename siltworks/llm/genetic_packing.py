"""Packing documents whole into as few sequences as possible: a grouping genetic algorithm on islands.

Only documents longer than a sequence are cut.  Whole sequences stay as they are; all other pieces are dealt into groups of
about `GROUP` by a hash of their number, so that no document, source or length can make a group large.  Every group is
packed on `ISLANDS` islands, each with a population of its own:

* the first members are a best fit by falling length and best fits by randomly disturbed lengths;
* crossover injects well-filled bins of one parent whole into the other, removes the bins that hold any of their documents
  a second time, and best-fits the documents displaced by that; mutation empties some of the worst-filled bins and best-fits
  what was in them;
* after each epoch the best member of an island migrates to the next one, through the written state, and groups in which an
  island has come down to the lower bound (the sum of lengths over the limit) are done.

Only lengths go through the islands; the ids of the pieces are written once and joined with their places at the end.
"""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import stored

GROUP = 4096  # pieces
ISLANDS = 3
EPOCHS = 3
MEMBERS = 5
GENERATIONS = 12  # an epoch
MEMO = 300_000  # words a task remembers the ids of

PIECES = "piece_id long, key long, piece int, start long, length long, ids binary, ids_crc32 long, doc_tokens long"
STATE = "group long, island int, pieces binary, lengths binary, members binary, bins int, unfilled double, bound int"
PLACED = "piece_id long, sequence_id long, offset long"


# Fixed by the vocabulary file: how it parts lower-cased words without white space, read for the letters of Latin-1, which its
# normal form leaves as they are; and the signs by which it writes the bytes of a part.
_LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}


class WordEncoder(dict):
    """Ids of a tokenizer that drops white space and never looks across it: each word, and each part of one that the
    tokenizer merges by itself, is encoded once and remembered."""

    def __init__(self, path: str, memo: int = MEMO) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self.normalize, self.split, self.merge = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize
        self.memo, self.parts = memo, {}

    def __missing__(self, word: bytes) -> bytes:
        # a control string in a text is ordinary text: no special token is looked for
        text, known = word.decode(), self.parts
        if _LATIN.fullmatch(text):
            parts = _PARTS.findall(text.lower())
            if not word.isascii():
                parts = [p if p.isascii() else p.encode().decode("latin-1").translate(_SIGNS) for p in parts]
        else:
            parts = [p for p, _ in self.split(self.normalize(text))]
        for p in parts:
            if p not in known:
                known[p] = array("I", [t.id for t in self.merge(p)]).tobytes()
        self[word] = out = known[parts[0]] if len(parts) == 1 else b"".join(map(known.__getitem__, parts))
        return out

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        # words are parted by ASCII white space; any other is dropped by the tokenizer itself
        out = b"".join(map(self.__getitem__, text.encode().lower().split()))
        if len(self) > self.memo:
            self.clear()
            self.parts.clear()
        return out


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokens: int = 2048, path: str | None = None, end_id: int = 0) -> DataFrame:
    """(piece_id, key, piece, start, length, ids, ids_crc32, doc_tokens): the ids of every text and one end id, cut only
    where they are more than `tokens`.  Written; piece_id is a number of each row of its own.  A null text is empty."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    names, kinds = zip(*(x.split() for x in PIECES.split(", ")), strict=True)
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder(path), np.asarray([end_id], dtype="<u4").tobytes()
        number = TaskContext.get().partitionId() << 33
        for batch in (b.slice(k, 128) for b in batches for k in range(0, b.num_rows, 128)):
            rows = []
            for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encoder.ids(t or "") + end
                total = len(ids) // 4
                for p, at in enumerate(range(0, total, tokens)):
                    part = ids[4 * at : 4 * (at + tokens)]
                    rows.append((number, k, p, at, len(part) // 4, part, crc32(part), total))
                    number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return stored(docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, PIECES), "genetic-pieces")


def best_fit(bins: np.ndarray, items: np.ndarray, lengths: np.ndarray, limit: int) -> np.ndarray:
    """`bins` (-1: in none) with `items` placed in the order given, each where the least room is left over, else in a new bin.

    Of bins with equal room the lowest number takes the item."""
    bins = bins.copy()
    placed = bins >= 0
    used = np.bincount(bins[placed], lengths[placed]).astype(np.int64) if placed.any() else np.zeros(0, np.int64)
    room = sorted((int(limit - u), b) for b, u in enumerate(used.tolist()) if 0 < u < limit)
    fresh = len(used)
    for i, n in zip(items.tolist(), lengths[items].tolist(), strict=True):
        k = bisect_left(room, (n, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            left, b, fresh = limit, fresh, fresh + 1
        bins[i] = b
        if left > n:
            insort(room, (left - n, b))
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def _falling(items: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return items[np.argsort(-weight[items], kind="stable")]


def fitness(bins: np.ndarray, lengths: np.ndarray, limit: int) -> tuple[int, float]:
    """(bins, unfilled), lower is better: of packings with equally many bins, the one with fuller full bins."""
    fill = np.bincount(bins, lengths) / limit
    return len(fill), 1.0 - float(np.mean(fill**2))


def crossover(taker: np.ndarray, giver: np.ndarray, lengths: np.ndarray, limit: int, rng: np.random.Generator) -> np.ndarray:
    """Well-filled bins of the giver go whole into the taker."""
    fill = np.bincount(giver, lengths) / limit
    order = np.argsort(-fill + rng.normal(0, 0.02, len(fill)))
    chosen = np.zeros(len(fill), dtype=bool)
    share = rng.uniform(0.2, 0.6)
    best = order[: max(1, int(len(fill) * share))]
    chosen[best[rng.random(len(best)) < 0.7]] = True
    injected = chosen[giver]
    hit = np.zeros(int(taker.max()) + 1, dtype=bool)
    hit[taker[injected]] = True  # these hold a document a second time
    child = np.where(hit[taker], -1, taker)
    child[injected] = giver[injected] + len(hit)
    return _refit(child, lengths, limit)


def _refit(child: np.ndarray, lengths: np.ndarray, limit: int) -> np.ndarray:
    kept = child >= 0
    child[kept] = np.unique(child[kept], return_inverse=True)[1]
    return best_fit(child, _falling(np.flatnonzero(~kept), lengths), lengths, limit)


def mutated(bins: np.ndarray, lengths: np.ndarray, limit: int, rng: np.random.Generator) -> np.ndarray:
    """Some of the worst-filled bins, and a few others, are emptied and what was in them is best-fitted."""
    fill = np.bincount(bins, lengths) / limit
    emptied = rng.random(len(fill)) < 0.02
    emptied[np.argsort(fill)[: int(rng.integers(1, max(2, len(fill) // 20) + 1))]] = True
    return _refit(np.where(emptied[bins], -1, bins), lengths, limit)


def evolve(members: list[np.ndarray], lengths: np.ndarray, limit: int, rng: np.random.Generator, size: int = MEMBERS, generations: int = GENERATIONS) -> list[np.ndarray]:
    """The next population, best first; ends early where a member has come down to the lower bound."""
    everything, bound = np.arange(len(lengths)), -(-int(lengths.sum()) // limit)
    members = list(members)
    if not members:
        members.append(best_fit(np.full(len(lengths), -1), _falling(everything, lengths), lengths, limit))
    graded = [(fitness(m, lengths, limit), m) for m in members]
    while len(graded) < size and min(g[0] for g, _ in graded) > bound:
        disturbed = lengths * rng.uniform(0.7, 1.3, len(lengths))
        m = best_fit(np.full(len(lengths), -1), _falling(everything, disturbed), lengths, limit)
        graded.append((fitness(m, lengths, limit), m))
    graded.sort(key=lambda x: x[0])
    for _ in range(generations):
        if graded[0][0][0] <= bound or len(graded) < 2:
            break
        for _ in range(size):
            a, b = (min(rng.integers(0, len(graded), 2)) for _ in range(2))  # the better of two
            child = crossover(graded[a][1], graded[b][1], lengths, limit, rng)
            if rng.random() < 0.5:
                child = mutated(child, lengths, limit, rng)
            graded.append((fitness(child, lengths, limit), child))
        graded.sort(key=lambda x: x[0])
        distinct = [x for i, x in enumerate(graded) if i == 0 or x[0] != graded[i - 1][0]]
        graded = distinct[:size]
    return [m for _, m in graded[:size]]


def _bound(lengths: np.ndarray, limit: int) -> int:
    return -(-int(lengths.sum()) // limit)


def _row(group: int, island: int, ids: np.ndarray, lengths: np.ndarray, members: list[np.ndarray], limit: int) -> pa.Table:
    flat = (ids.astype("<i8").tobytes(), lengths.astype("<i4").tobytes(), np.concatenate(members).astype("<i4").tobytes())
    row = (group, island, *flat, *fitness(members[0], lengths, limit), _bound(lengths, limit))
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.float64(), pa.int32())
    return pa.table([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in STATE.split(", ")])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every piece of a group in the bins of the group's best member, end to end."""
    for row in (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()):
        ids, lengths = np.frombuffer(row["pieces"], "<i8"), np.frombuffer(row["lengths"], "<i4").astype(np.int64)
        bins = np.frombuffer(row["members"], "<i4")[: len(ids)].astype(np.int64)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.concatenate([[True], np.diff(bins[order]) > 0])
        offset = before - np.maximum.accumulate(np.where(first, before, 0))
        sequence = 2 * ((row["group"] << 24) + bins[order]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(ids[order]), pa.array(sequence), pa.array(offset)], names=["piece_id", "sequence_id", "offset"])


def place(rest: DataFrame, limit: int, group: int = GROUP, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(piece_id, sequence_id, offset) of the pieces (piece_id, length) in sequences of at most `limit`; sequence ids are odd."""
    groups = max(1, round(rest.count() / group))
    tasks = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, much work: not to be put together
    dealt = rest.select(F.pmod(F.xxhash64("piece_id"), F.lit(groups)).alias("group"), "piece_id", "length").repartition(min(tasks, groups), "group")

    def begin(key: tuple, t: pa.Table) -> pa.Table:
        # in a fixed order, so that a task that runs again makes the same bins
        ids, lengths = t.column("piece_id").to_numpy(), t.column("length").to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        ids, lengths = ids[order], lengths[order]
        first = evolve([], lengths, limit, np.random.default_rng(0), size=1, generations=0)
        alone = len(np.unique(first[0])) <= _bound(lengths, limit)
        return pa.concat_tables([_row(key[0].as_py(), i, ids, lengths, first, limit) for i in range(1 if alone else islands)])

    def epoch(number: int):
        def run(key: tuple, t: pa.Table) -> pa.Table:
            rows = sorted(t.to_pylist(), key=lambda r: r["pieces"] is None)  # the island itself, then who comes to it
            lengths = np.frombuffer(rows[0]["lengths"], "<i4").astype(np.int64)
            members = [m for r in rows for m in np.frombuffer(r["members"], "<i4").reshape(-1, len(lengths))]
            g, island = key[0].as_py(), key[1].as_py()
            rng = np.random.default_rng([g, island, number])
            return _row(g, island, np.frombuffer(rows[0]["pieces"], "<i8"), lengths, evolve(members, lengths, limit, rng), limit)

        return run

    state = stored(dealt.groupBy("group").applyInArrow(begin, STATE), "genetic-state")
    ended = []
    for number in range(epochs):
        best = state.groupBy("group").agg(F.min(F.col("bins") - F.col("bound")).alias("_over"))
        ended.append(state.join(best.where("_over <= 0"), "group", "left_semi"))
        going = state.join(best.where("_over > 0"), "group", "left_semi")
        if going.isEmpty():
            state = None
            break
        # the first of the members goes to the next island
        elite = going.withColumns({
            "island": ((F.col("island") + 1) % islands).cast("int"), "members": F.substring("members", F.lit(1), F.octet_length("lengths")),
            "pieces": F.lit(None).cast("binary"), "lengths": F.lit(None).cast("binary"),
        })
        arriving = going if number == 0 or islands == 1 else going.unionByName(elite)
        arriving = arriving.repartition(min(tasks, groups * islands), "group", "island")
        state = stored(arriving.groupBy("group", "island").applyInArrow(epoch(number), STATE), "genetic-state")
    for more in ended:
        state = more if state is None else state.unionByName(more)
    best = state.groupBy("group").agg(F.min_by(F.struct("pieces", "lengths", "members"), F.struct("bins", "unfilled", "island")).alias("x"))
    return best.select("group", "x.*").mapInArrow(_places, PLACED)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokens: int = 2048, path: str | None = None, group: int = GROUP) -> DataFrame:
    """(doc key, piece, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset): one row per piece of a document.

    A document's ids are those of its whole text and one end id; only one with more than `tokens` is cut, into pieces of
    `tokens` and a last one.  A null or empty text has the end id alone.  Repeated and null keys are documents of their own;
    equal lengths are taken in the order of the pieces' numbers.  Other columns are left out.  An empty table gives an empty
    table.  Reruns of a task make the same bins; reruns of the whole may number sequences otherwise.
    """
    every = pieces(docs, key, text, tokens, path)
    whole = every.where(F.col("length") == tokens).withColumns({"sequence_id": 2 * F.col("piece_id"), "offset": F.lit(0).cast("long")})
    rest = every.where(F.col("length") < tokens)
    placed = rest.join(place(rest.select("piece_id", "length"), tokens, group), "piece_id")
    names = ("piece", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return whole.unionByName(placed).select(F.col("key").alias(key), *names)
