"""Blocks of rows that tell each other about keys they share, in proportion to the data.

A block is what a task holds at a time.  It sends each distinct key once, with numbers to be merged, as sorted keys cut into
ranges; a range merges what all blocks sent, and answers each block in the order it asked in.  A block keeps its rows as they
were written, and turns the answers into rows of its own.

Both blocks and ranges grow with the data, so that a block that asked every range would make pieces ever smaller and
their number grow with the square.  Beyond `FAN` ranges the way goes over two levels: pieces are cut by the root of the
number of ranges, as many blocks' pieces of one coarse range are merged into one, and that asks the ranges inside it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import stored

FAN = 128
SENT = 1 << 20  # bytes of pieces that are handed on at a time
ASKED = "span long, block long, keys binary, numbers binary"
ANSWERED = "block long, span long, answers binary"


class Tally(NamedTuple):
    """How numbers of equal keys merge, and how the merged ones are written as answers and read.

    merge: (numbers in the order of keys, where each distinct key starts) to numbers of distinct keys; it must not matter
    in what order and by what steps numbers are merged.  write: merged numbers to bytes.  read: those bytes and how many keys
    to an array with a row a key."""

    merge: Callable[[np.ndarray, np.ndarray], np.ndarray]
    write: Callable[[np.ndarray], bytes]
    read: Callable[[bytes, int], np.ndarray]
    rewrite: Callable[[np.ndarray], bytes]


def press(numbers: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, as many as the largest needs, each compressed by itself or as it is, if that is shorter."""
    raw = np.ascontiguousarray(numbers).view(np.uint64).ravel()
    width = (int(raw.max()).bit_length() + 7) // 8 if len(raw) else 0
    each, compressor = raw.view(np.uint8).reshape(-1, 8), zstandard.ZstdCompressor(level=1)
    planes = [each[:, k].tobytes() for k in range(width)]
    pressed = [compressor.compress(p) for p in planes]
    shorter = [len(z) < len(p) for z, p in zip(pressed, planes, strict=True)]
    flags = sum(s << k for k, s in enumerate(shorter))
    return len(raw).to_bytes(8, "little") + bytes([flags]) + _framed([z if s else p for z, p, s in zip(pressed, planes, shorter, strict=True)])


def unpress(blob: bytes, kind: type = np.int64) -> np.ndarray:
    wide = np.zeros((int.from_bytes(blob[:8], "little"), 8), np.uint8)
    decompressor = zstandard.ZstdDecompressor()
    for k, part in enumerate(_parts(blob[9:])):
        wide[:, k] = np.frombuffer(decompressor.decompress(part) if blob[8] >> k & 1 else part, np.uint8)
    return wide.view(kind).ravel()


def _framed(parts: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(4, "little") + x for x in parts)


def _parts(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 4], "little")
        out.append(blob[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def press_keys(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys by the gaps between them.

    Keys known by fewer bits end in zeros.  Where most do, they are written without them, and the others by themselves: a
    long key among them would give both gaps beside it all its bits."""
    one = np.uint64(1)
    zeros = np.bitwise_count((keys & (~keys + one)) - one)  # that a key ends in
    shift = np.uint64(min(32, int(np.partition(zeros, len(zeros) // 3)[len(zeros) // 3]) if len(zeros) else 0))
    short = zeros >= shift
    both = (keys[short] >> shift, keys[~short])
    return bytes([int(shift)]) + _framed([press(np.diff(k, prepend=np.uint64(0))) for k in both])


def unpress_keys(blob: bytes) -> np.ndarray:
    short, long_ = (np.cumsum(unpress(x, np.uint64), dtype=np.uint64) for x in _parts(blob[1:]))
    short = short << np.uint64(blob[0])
    return np.sort(np.concatenate([short, long_]), kind="stable") if len(long_) else short


def _listed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Large numbers that repeat, such as names, as places in a list of them, which is empty where that is no use."""
    low, high = numbers.min(), numbers.max()
    none = np.zeros(0, np.int64)
    if 0 <= low and high < 1 << 16:
        return none, numbers
    above = numbers == high
    if (above | (numbers == low)).all():
        return np.array([low, high], dtype=np.int64), above.astype(np.int64)
    names, place = np.unique(numbers, return_inverse=True)
    return (none, numbers) if len(names) * 2 > len(numbers) else (names, place.astype(np.int64).ravel())


FEW, JOINT = 12, 3  # numbers under FEW in rows of up to JOINT are one symbol a row


def _press_numbers(numbers: np.ndarray) -> bytes:
    """Rows of small numbers are one symbol each, the most frequent being the smallest; the others go column by column."""
    numbers = numbers.reshape(len(numbers), -1)
    if not numbers.size:
        return b""
    names, places = zip(*[_listed(np.ascontiguousarray(c)) for c in numbers.T], strict=True)
    few = np.zeros(len(numbers), dtype=bool)
    code = np.zeros(len(numbers), dtype=np.int64)
    if 1 < len(places) <= JOINT:
        few = np.logical_and.reduce([(p >= 0) & (p < FEW) for p in places])
        for p in places:
            code = code * FEW + p
        code = np.where(few, code + 1, 0)
    known = np.argsort(-np.bincount(code), kind="stable")
    rank = np.empty(len(known), dtype=np.int64)
    rank[known] = np.arange(len(known))
    symbols = rank[code]
    return _framed([press(known[: symbols.max() + 1]), press(symbols), *map(press, names), *[press(p[~few]) for p in places]])


def _unpress_numbers(blob: bytes, keys: int) -> np.ndarray:
    """A row a key."""
    if not blob:
        return np.zeros((keys, 1), np.int64)
    known, symbols, *rest = map(unpress, _parts(blob))
    code, width = known[symbols] - 1, len(rest) // 2
    few = code >= 0
    out = np.empty((keys, width), dtype=np.int64)
    for k, (names, others) in reversed(list(enumerate(zip(rest[:width], rest[width:], strict=True)))):
        place = np.where(few, code % FEW, 0)
        place[~few] = others
        out[:, k] = names[place] if len(names) else place
        code = code // FEW
    return out


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def merged(keys: np.ndarray, numbers: np.ndarray, tally: Tally) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their merged numbers."""
    if not len(keys):
        return keys, numbers
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], tally.merge(numbers[order], starts)


def _ranges(runs: list[np.ndarray], spans: int) -> Iterator[tuple[int, list[slice]]]:
    """The ranges in which sorted keys lie, and where in each run."""
    least = np.array([-(-(s << 32) // spans) << 32 for s in range(spans)], dtype=np.uint64)
    edges = np.array([np.append(np.searchsorted(keys, least), len(keys)) for keys in runs])
    for s in np.flatnonzero((edges[:, 1:] > edges[:, :-1]).any(axis=0)).tolist():
        yield s, [slice(a, z) for a, z in edges[:, s : s + 2].tolist()]


def _as_runs(block: int, keys, numbers) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    return block, list(zip(keys, numbers, strict=True)) if isinstance(keys, list) else [(keys, numbers)]


def _cut(block: int, runs: list[tuple[np.ndarray, np.ndarray]], spans: int, tally: Tally) -> Iterator[tuple]:
    """The pieces of sorted distinct keys and their numbers; runs are merged range by range, so that they are never held as one."""
    for s, own in _ranges([keys for keys, _ in runs], spans):
        parts = [(keys[i], numbers[i].astype(np.int64, copy=False)) for (keys, numbers), i in zip(runs, own, strict=True) if i.start < i.stop]
        keys, numbers = parts[0] if len(parts) == 1 else merged(*map(np.concatenate, zip(*parts, strict=True)), tally)
        yield s, block, press_keys(keys), _press_numbers(numbers)


def _opened(rows: list[dict]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(keys, _unpress_numbers(r["numbers"], len(keys))) for r in rows for keys in [unpress_keys(r["keys"])]]


def _answer(tally: Tally):
    def run(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        each = [unpress_keys(r["keys"]) for r in rows]
        ends = np.cumsum([len(k) for k in each])
        keys = np.concatenate(each)
        del each
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        at = np.empty(len(keys), dtype=np.int32 if len(keys) < 1 << 31 else np.int64)  # where a key is in their order
        at[order] = np.arange(len(keys), dtype=at.dtype)
        del order, keys
        numbers = None
        for r, mine in zip(rows, np.split(at, ends[:-1]), strict=True):
            own = _unpress_numbers(r["numbers"], len(mine))
            numbers = np.empty((len(at), own.shape[1]), np.int64) if numbers is None else numbers
            numbers[mine] = own
        total = tally.merge(numbers, np.flatnonzero(first))
        del numbers
        place = np.cumsum(first, dtype=at.dtype)
        place -= 1
        out = [(r["block"], r["span"], tally.write(total[place[mine]])) for r, mine in zip(rows, np.split(at, ends[:-1]), strict=True)]
        return pa.Table.from_batches([_batch(out, ANSWERED)])

    return run


def cuts(spans: int, fan: int = FAN) -> int:
    """How many ranges a block's answers come in."""
    return spans if spans <= fan else math.isqrt(spans - 1) + 1


def answers_of(keys: np.ndarray, rows: list[dict], tally: Tally, cuts: int) -> np.ndarray:
    """The answers to a block's sorted distinct keys out of its rows of (span, answers)."""
    sizes = np.bincount((((keys >> np.uint64(32)) * np.uint64(cuts)) >> np.uint64(32)).astype(np.int64), minlength=cuts)
    rows = sorted(rows, key=lambda r: r["span"])
    if [r["span"] for r in rows] != np.flatnonzero(sizes).tolist():
        raise ValueError("a block's answers don't match what it asked")
    return np.concatenate([tally.read(r["answers"], int(sizes[r["span"]])) for r in rows])


def answers_by_range(runs: list[np.ndarray], rows: list[dict], tally: Tally, cuts: int) -> Iterator[tuple[list[slice], list[np.ndarray]]]:
    """Range by range where its keys are in each run of a block's sorted distinct keys, and the answers to them."""
    replies = {r["span"]: r["answers"] for r in rows}
    asked = 0
    for span, own in _ranges(runs, cuts):
        if span not in replies:
            break
        asked += 1
        distinct = np.unique(np.concatenate([keys[i] for keys, i in zip(runs, own, strict=True)]))
        known = tally.read(replies[span], len(distinct))
        yield own, [known[np.searchsorted(distinct, keys[i])] for keys, i in zip(runs, own, strict=True)]
    else:
        if asked == len(rows):
            return
    raise ValueError("a block's answers don't match what it asked")


def exchange(blocks: DataFrame, asks: Callable[[dict], tuple[int, np.ndarray, np.ndarray]], tally: Tally, spans: int, fan: int = FAN) -> DataFrame:
    """(block, span, answers): end to end in the order of spans, the answers to the sorted distinct keys of each block.

    asks: a row of `blocks` to (block, sorted distinct unsigned 64-bit keys, their numbers, a row of int64 a key), or to lists
    of such runs of keys and numbers, whose equal keys are merged; a block then asks for what is in any of them.
    """

    def cut(spans: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()):
                held, size = [], 0
                for piece in _cut(*_as_runs(*asks(row)), spans, tally):  # no name keeps the runs while the next row asks
                    held.append(piece)
                    size += len(piece[2]) + len(piece[3])
                    if size >= SENT:
                        yield _batch(held, ASKED)
                        held, size = [], 0
                if held:
                    yield _batch(held, ASKED)

        return run

    if spans <= fan:
        return blocks.mapInArrow(cut(spans), ASKED).groupBy("span").applyInArrow(_answer(tally), ANSWERED)

    coarse = cuts(spans, fan)
    groups = max(1, -(-blocks.count() // coarse))
    pieces = stored(blocks.mapInArrow(cut(coarse), ASKED).withColumn("team", F.pmod(F.xxhash64("block"), F.lit(groups))), "exchange-pieces")
    # a team's pieces of one coarse range are a block of the second level
    named = pieces.withColumn("second", F.col("span") * groups + F.col("team"))

    def join(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        return pa.Table.from_batches([_batch(list(_cut(rows[0]["second"], _opened(rows), coarse * coarse, tally)), ASKED)])

    answered = named.groupBy("second").applyInArrow(join, ASKED).groupBy("span").applyInArrow(_answer(tally), ANSWERED)

    def back(asked: pa.Table, replies: pa.Table) -> pa.Table:
        rows = asked.select(["block", "span", "keys"]).to_pylist()
        parts = [[] for _ in rows]
        for _, known in answers_by_range([unpress_keys(r["keys"]) for r in rows], replies.to_pylist(), tally, coarse * coarse):
            for mine, x in zip(parts, known, strict=True):
                mine.append(x)
        return pa.Table.from_batches([_batch([(r["block"], r["span"], tally.rewrite(np.concatenate(x))) for r, x in zip(rows, parts, strict=True)], ANSWERED)])

    replies = answered.withColumnRenamed("block", "second")
    return named.groupBy("second").cogroup(replies.groupBy("second")).applyInArrow(back, ANSWERED)


def _same(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    low, high = np.minimum.reduceat(numbers, starts), np.maximum.reduceat(numbers, starts)
    return np.where(low == high, low, -1)


def _bits(numbers: np.ndarray) -> bytes:
    return np.packbits(numbers.ravel() == -1).tobytes()


# One number a key, the name of its owner, -1 for several; the answer is a bit: it has several owners.
SEVERAL = Tally(_same, _bits, lambda blob, n: np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool), lambda known: np.packbits(known).tobytes())
# Any numbers a key; the answer are their sums over all blocks.
SUMS = Tally(lambda numbers, starts: np.add.reduceat(numbers, starts, axis=0), _press_numbers, _unpress_numbers, _press_numbers)
