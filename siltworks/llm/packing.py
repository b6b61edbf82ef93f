"""Packing examples into training sequences: vector bin packing by the dot-product heuristic.

Every piece is a vector of tokens, segments (one) and loss-bearing tokens, and a sequence has a limit for each.  An open
sequence takes, of the pieces that still fit, the one whose vector has the largest dot product with what is left of
the limits, weighed by how scarce each limit is over the group.  When nothing fits any more, the gap is filled with the
head of the longest waiting piece; its tail waits on.

Whole sequences are cut from long examples first and never move.  The remainders are dealt into groups of about
`GROUP` pieces by their place in a written table, so no key can make a group large, and each group is packed by itself.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import stored

GROUP = 1024
ENCODED = "key long, doc_tokens long, ids binary, mask binary"
PIECES = "key long, doc_tokens long, start long, length long, loss long, ids binary, mask binary, whole boolean"
PACKED = "key long, doc_tokens long, start long, length long, loss long, ids binary, mask binary, sequence_id long, offset long"

# Both libraries cut such texts alike; a text with any other character goes to the slower one.
_PLAIN = re.compile("[\x20-\x7e\t\n\rÀ-ɏ‐-‧€]*")


class Encoder:
    """Ids of a byte-level BPE file.  Plain texts take the faster library's copy of the same vocabulary."""

    def __init__(self, path: str, ranks: str | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self._slow, self.fast = path, None, None
        if ranks is not None:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @property
    def slow(self):
        """Loaded by the first text that needs it."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.encode_special_tokens = True  # a control string in a text is ordinary text
        return self._slow

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and _PLAIN.fullmatch(text):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def encode_texts(docs: DataFrame, key: str, text: str, path: str | None = None, ranks: str | None = None, end_id: int = 0) -> DataFrame:
    """(key, doc_tokens, ids, mask): the ids of every whole text and one end id, as little-endian 32-bit numbers.

    A null text is empty and has the end id alone.  mask is null: every token bears loss.
    """
    ranks = ranks or (public_tokenizers.path("byte_bpe_50k.tiktoken") if path is None else None)
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, ranks)
        end = np.asarray([end_id], dtype="<u4")
        for batch in batches:
            for k in range(0, batch.num_rows, 128):  # what is held at a time
                part = batch.slice(k, 128)
                ids = [np.concatenate([encoder.ids(t or ""), end]) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.nulls(len(ids), pa.binary())],
                    names=["key", "doc_tokens", "ids", "mask"],
                )

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, ENCODED)


def _loss(mask: bytes | None, start: int, length: int) -> int:
    return length if mask is None else int(np.count_nonzero(np.frombuffer(mask, np.uint8)[start : start + length]))


def _head(mask: bytes | None, length: int, tokens: int, loss: int) -> int:
    """How many of the first tokens fit under both limits."""
    n = min(length, tokens)
    if mask is None:
        return min(n, loss)
    return int(np.searchsorted(np.cumsum(np.frombuffer(mask, np.uint8)[:n] != 0), loss, side="right"))


def _cut(batches, limits: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    tokens, _, loss = limits
    for batch in (b.slice(k, 128) for b in batches for k in range(0, b.num_rows, 128)):
        rows: list[tuple] = []
        for key, total, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_tokens", "ids", "mask")), strict=True):
            at, n = 0, len(ids) // 4
            while at < n:
                rest = None if mask is None else mask[at:]
                take = _head(rest, n - at, tokens, loss)
                if take == 0:
                    raise ValueError("a single token is over the loss limit")
                part = None if rest is None else rest[:take]
                rows.append((key, total, at, take, _loss(part, 0, take), ids[4 * at : 4 * (at + take)], part, take == tokens))
                at += take
        yield _batch(rows, PIECES)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def pack_group(pieces: list[list], limits: tuple[int, int, int], least_cut: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset) for pieces [length, mask]."""
    most = np.asarray(limits, dtype=float)
    begun = np.zeros(len(pieces), dtype=np.int64)
    length = np.asarray([p[0] for p in pieces], dtype=np.int64)
    loss = np.asarray([_loss(m, 0, n) for n, m in pieces], dtype=np.int64)
    vectors = np.stack([length, np.ones_like(length), loss], axis=1) / most
    scarce = vectors.sum(axis=0) / max(vectors.sum(), 1e-9)
    waiting = length > 0
    placed, sequence = [], 0
    while waiting.any():
        left = np.asarray(limits, dtype=np.int64)
        offset = 0

        def put(i: int, n: int) -> None:
            nonlocal offset, left
            part = _loss(pieces[i][1], int(begun[i]), n)
            placed.append((i, int(begun[i]), n, sequence, offset))
            offset += n
            left = left - (n, 1, part)
            begun[i] += n
            length[i] -= n
            loss[i] -= part
            vectors[i] = (length[i] / most[0], 1 / most[1], loss[i] / most[2])
            waiting[i] = length[i] > 0

        while left[1] > 0:
            fits = waiting & (length <= left[0]) & (loss <= left[2])
            if not fits.any():
                break
            score = vectors @ (scarce * (left / most))
            i = int(np.argmax(np.where(fits, score, -1.0)))
            put(i, int(length[i]))
        if waiting.any() and left[1] > 0 and left[0] >= least_cut:
            i = int(np.argmax(np.where(waiting, length, -1)))
            mask = pieces[i][1]
            n = _head(None if mask is None else mask[int(begun[i]) :], int(length[i]), int(left[0]), int(left[2]))
            if n >= least_cut or offset == 0:
                put(i, n)
        sequence += 1
    return placed


def pack(encoded: DataFrame, tokens: int = 1024, segments: int = 256, loss: int | None = None, least_cut: int = 8, group: int = GROUP) -> DataFrame:
    """(key, doc_tokens, start, length, loss, ids, mask, sequence_id, offset): one row per piece.

    encoded: key, doc_tokens, ids and mask (a byte per token, non-zero where it bears loss; null: all do), as
    `encode_texts` gives them; an example without ids has no piece.  A sequence holds at most `tokens` tokens,
    `segments` pieces and `loss` loss-bearing tokens (default: as many as tokens).  Repeated and null keys are examples
    of their own.  An empty table gives an empty table.
    """
    limits = (tokens, segments, tokens if loss is None else loss)
    pieces = stored(encoded.mapInArrow(lambda it: _cut(it, limits), PIECES), "pieces")
    whole = pieces.where("whole").withColumns({"sequence_id": 2 * F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}).drop("whole")
    rest = pieces.where("not whole").drop("whole")
    groups = -(-rest.count() // group) | 1  # odd: places of all partitions spread over all groups

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        out = []
        for i, at, n, sequence, offset in pack_group([[r["length"], r["mask"]] for r in rows], limits, least_cut):
            r = rows[i]
            mask = None if r["mask"] is None else r["mask"][at : at + n]
            out.append((r["key"], r["doc_tokens"], r["start"] + at, n, _loss(mask, 0, n), r["ids"][4 * at : 4 * (at + n)], mask, 2 * ((r["_group"] << 24) + sequence) + 1, offset))
        return pa.Table.from_batches([_batch(out, PACKED)])

    dealt = rest.withColumn("_group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    return whole.unionByName(dealt.groupBy("_group").applyInArrow(run, PACKED))
