"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the tokens under the loss are found by a
binary search of the sorted turn spans in the sorted token spans.

Template: each turn is ROLE role TEXT text END.  The three marks are control strings: the tokenizer gets them as
special tokens, so no token reaches over the edge of a text, and inside roles and texts they are escaped by one more
backslash after the `<` of every `<`, backslashes, `|`.  The escape is undone exactly.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed: the marks of the template.
ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
ENCODED_AT_ONCE = 32  # conversations whose encodings are held at a time

FORMATTED = (
    "conv_id long, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, "
    "loss_mask array<boolean>"
)
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_tokens long, n_loss_tokens long"
)


def escape(s: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", s)


def unescape(s: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", s)


def render(turns) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation and the sorted spans of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        head = ROLE + escape(role) + TEXT
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    turns = []
    for piece in formatted.split(END)[:-1]:
        role, text = piece.removeprefix(ROLE).split(TEXT, 1)
        turns.append((unescape(role), unescape(text)))
    return turns


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(path)
    # offsets that keep a token's leading space
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    t.encode_special_tokens = False
    t.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (ROLE, TEXT, END)])
    return t


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans) -> np.ndarray:
    """Tokens that lie in a span.  Token and span edges are sorted, so two binary searches a span are enough."""
    mask = np.zeros(len(starts), dtype=bool)
    if spans and len(starts):
        edges = np.asarray(spans, dtype=np.int64)
        first = np.searchsorted(starts, edges[:, 0], side="left")
        last = np.searchsorted(ends, edges[:, 1], side="right")
        for a, b in zip(first, last, strict=True):
            mask[a:b] = True
    return mask


def format_conversations(rows: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row per conv_id: the formatted text, its token ids with character offsets, and the loss mask.

    rows: conv_id, turn, role, text; other columns are ignored.  Turns go by turn (null first), then role, then text.
    A null role or text is empty.  Rows that share a null conv_id form one conversation; repeated rows are repeated
    turns.  A conversation is a single training example and is held whole by the task that renders it.
    """
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            ids, turns = batch.column("conv_id").to_pylist(), batch.column("turns")
            for k in range(0, len(ids), ENCODED_AT_ONCE):
                done = [render([(x["role"], x["text"]) for x in one]) for one in turns.slice(k, ENCODED_AT_ONCE).to_pylist()]
                out: list[list] = [[], [], [], []]
                for (_, spans), e in zip(done, t.encode_batch([text for text, _ in done], add_special_tokens=False), strict=True):
                    offsets = np.asarray(e.offsets, dtype=np.int32).reshape(-1, 2)
                    for column, x in zip(out, (e.ids, offsets[:, 0], offsets[:, 1], loss_mask(offsets[:, 0], offsets[:, 1], spans)), strict=True):
                        column.append(x)
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[k : k + ENCODED_AT_ONCE], pa.int64()), pa.array([text for text, _ in done], pa.string())]
                    + [pa.array(x, pa.list_(kind)) for x, kind in zip(out, kinds, strict=True)],
                    names=["conv_id", "formatted", "token_ids", "token_starts", "token_ends", "loss_mask"],
                )

    return grouped.mapInArrow(encode, FORMATTED)


def masked_text(formatted: str, starts, ends, mask) -> str:
    """All text under the mask; each run of masked tokens is a stretch of the formatted text, unescaped."""
    m = np.concatenate([[False], np.asarray(mask, dtype=bool), [False]])
    edges = np.flatnonzero(m[1:] != m[:-1]).reshape(-1, 2)
    return "".join(unescape(formatted[starts[a] : ends[b - 1]]) for a, b in edges)


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss of formatted conversations, taken from the formatted text, the offsets and the mask alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = [batch.column(c) for c in ("conv_id", "formatted", "token_starts", "token_ends", "loss_mask")]
            for i in range(batch.num_rows):
                conv, text = columns[0][i].as_py(), columns[1][i].as_py()
                starts, ends, mask = (c[i].values.to_numpy(zero_copy_only=False) for c in columns[2:])
                turns, loss = parse(text), masked_text(text, starts, ends, mask)
                digest = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
                rows.append((conv, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), len(starts), int(mask.sum())))
            names = [x.split()[0] for x in DIGEST.split(", ")]
            yield pa.RecordBatch.from_pydict(
                {n: pa.array(list(v), pa.string() if n.endswith("sha256") else pa.int64()) for n, v in zip(names, zip(*rows, strict=True), strict=True)}
            ) if rows else pa.RecordBatch.from_pydict({n: pa.array([], pa.string() if n.endswith("sha256") else pa.int64()) for n in names})

    return formatted.mapInArrow(read, DIGEST)
