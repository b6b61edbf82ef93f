"""Language-model scores by deleted interpolation of word n-grams.

A token is a lower-cased word or the end of a text; what stands before a text is read as ends.  Its probability mixes
the maximum-likelihood estimates of the n-grams up to `order` with a uniform one; each bucket of context frequency (that of
the longest context seen in training) has weights of its own, found by expectation-maximisation on the counts of a held-out
part of the training texts.  With the weights found, the counts of all training texts are used.  What is unknown is one more
member of the vocabulary.

How it runs: documents are coded once into chunks, each with a dictionary of its own words, and written.  A chunk sends
each of its distinct n-grams once, as sorted hashes, to the key ranges of `exchange`, which add up what all chunks sent and
answer each chunk in the order it asked in; with its answers a chunk writes the counts of its tokens, which the weights and
the scores are then read from without another shuffle.  So a frequent word costs one entry per chunk, not one per token, no
table of the corpus has to fit anywhere, and what is exchanged grows with the data.  Chunks are written in buckets by name
and so meet their answers without being shuffled.  Words are known by 64-bit hashes, longer n-grams by as many bits as number
them all and SPARE more: at every size one in 2^SPARE shares its hash with another.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import crc32_mod, stored
from siltworks.llm.exchange import SUMS, answers_by_range, cuts, exchange, press, unpress
from siltworks.plans.scratch import scratch_path

ORDER, TOP_ORDER = 3, 5
CHUNK_DOCS, CHUNK_TOKENS = 4096, 1_500_000
SHEET = 1 << 18  # tokens of a chunk that are counted and scored at a time
SPARE = 20
FAN = 1024  # ranges a chunk asks at once: some thousands of n-grams each
BUCKETS = 40  # powers of two of a context's count, for each length of context
STEP = 0.4  # of natural logarithms, in the table of held-out tokens
STEPS = 1000  # more than there can be between the least and the greatest estimate
EM_ROUNDS = 40

CHUNKS = "chunk long, doc_ids array<long>, held_out array<boolean>, lengths array<int>, tokens binary, words binary, roles binary"
COUNTED = "doc_ids array<long>, held_out array<boolean>, lengths array<int>, roles binary, known binary, words binary, longer binary, part binary, n long, v long, n_part long, v_part long"
CELLS = "cell long, n long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _kinds(schema: str) -> tuple[list[str], list[pa.DataType]]:
    of = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<int>": pa.list_(pa.int32())}
    fields = [x.split() for x in schema.split(", ")]
    return [n for n, _ in fields], [of[t] for _, t in fields]


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = _kinds(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def _press(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(raw)


def _unpress(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _chunk(docs: list[tuple], place: dict[bytes, int], salt: int) -> tuple:
    """docs: (doc_id, held_out, part of the training texts that sets the weights, the places of its words)."""
    lengths = [len(x) for *_, x in docs]
    tokens = np.concatenate([x for *_, x in docs])
    roles = np.array([0 if held else 2 if part else 1 for _, held, part, _ in docs], dtype=np.uint8)
    n = len(place)
    order = np.argsort(-np.bincount(tokens, minlength=n), kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    words = list(place)
    coded = press(rank[tokens])
    name = xxhash.xxh64_intdigest(coded, salt) >> 1
    return (name, [d[0] for d in docs], [d[1] for d in docs], lengths, coded, _press(b"\n".join(words[i] for i in order)), roles.tobytes())


def code(docs: DataFrame, held_out, part, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """The documents as chunks of dictionary-coded tokens, written to the shared folder as a table in buckets, and its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        place: dict[bytes, int] = {}
        size = made = task = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True):
                    words = (row[3] or "").encode().lower().split()
                    words.append(b"")  # the end
                    ids = np.fromiter((place.setdefault(w, len(place)) for w in words), dtype=np.int32, count=len(words))
                    held.append((*row[:3], ids))
                    task, size = row[4], size + len(words)
                    if len(held) >= CHUNK_DOCS or size >= CHUNK_TOKENS:
                        yield _rows([_chunk(held, place, task << 32 | made)], CHUNKS)
                        held, place, size, made = [], {}, 0, made + 1
        if held:
            yield _rows([_chunk(held, place, task << 32 | made)], CHUNKS)

    spark = docs.sparkSession
    # chunks of equal rows are told apart by task and by number
    rows = docs.select(F.col(key).cast("long"), held_out.alias("_held"), part.alias("_part"), text, F.spark_partition_id().alias("_task"))
    name = f"lm_chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    written = rows.mapInArrow(run, CHUNKS).write.bucketBy(buckets, "chunk").format("parquet").option("path", scratch_path(spark, "lm-chunks"))
    written.saveAsTable(name)
    return spark.table(name), name


def _add_up(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Counts are added; the third number is the least chunk that has the word."""
    return np.column_stack([np.add.reduceat(numbers[:, :2], starts, axis=0), np.minimum.reduceat(numbers[:, 2], starts)])


COUNTS = SUMS._replace(merge=_add_up)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values, and each one's place among them."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    distinct = ordered[first]
    del ordered
    number = np.cumsum(first, dtype=np.int32)
    number -= 1
    place = np.empty(len(values), dtype=np.int32)
    place[order] = number
    return distinct, place


def _grams(row: dict, order: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A chunk's n-grams: for each order the sorted distinct hashes, and each token's place among them."""
    low = np.uint64(64 - bits)
    words = _unpress(row["words"]).split(b"\n")
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    end = ends = hashes[words.index(b"")]
    del words
    tokens = unpress(row["tokens"]).astype(np.int32)
    lengths = np.asarray(row["lengths"], dtype=np.int64)
    starts = lengths.cumsum() - lengths
    distinct, place = _distinct(hashes)
    word = gram = hashes[tokens]
    tokens = place[tokens]
    yield distinct, tokens
    del distinct, place, tokens, hashes
    for _ in range(1, order):
        context = np.empty_like(gram)
        context[1:] = gram[:-1]
        context[starts] = ends
        gram, ends = _mixed(context, word), _mixed(np.array([ends]), np.array([end]))[0]
        yield _distinct(gram >> low << low)


def _asks(row: dict, order: int, bits: int) -> tuple[int, list[np.ndarray], list[np.ndarray]]:
    """For each order the sorted distinct hashes with what the chunk's training texts count, and the chunk's name beside words."""
    role = np.repeat(np.frombuffer(row["roles"], np.uint8), row["lengths"])
    keys, numbers = [], []
    for grams, place in _grams(row, order, bits):
        own = np.zeros((len(grams), 3), dtype=np.int32 if keys else np.int64)  # a chunk's counts are small, its name isn't
        own[:, 0], own[:, 1] = (np.bincount(place[keep], minlength=len(grams)) for keep in (role > 0, role == 2))
        own[:, 2] = 0 if keys else row["chunk"]
        keys.append(grams)
        numbers.append(own)
    return row["chunk"], keys, numbers


def _mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of each word after its context, in the place of the context's."""
    with np.errstate(over="ignore"):
        context *= np.uint64(0x9E3779B97F4A7C15)
        context += word
        context ^= context >> np.uint64(29)
        context *= np.uint64(0xBF58476D1CE4E5B9)
    context ^= context >> np.uint64(32)
    return context


def _sheets(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Runs of whole documents, from and to, that end in the same SHEET tokens."""
    edges = np.flatnonzero(np.diff((lengths.cumsum() - 1) // SHEET)) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(lengths)], strict=True))


def _press_counts(counts: list[np.ndarray]) -> tuple[bytes, bytes, bytes]:
    """Tokens' counts: those of words, few of which differ, as places in a list with the most frequent first, where that is
    shorter, else with no list and as they are; and those of longer n-grams."""
    names, which = np.unique(counts[0], return_inverse=True)
    often = np.argsort(-np.bincount(which), kind="stable")
    rank = np.empty(len(names), dtype=np.int64)
    rank[often] = np.arange(len(names))
    plain, known, words = press(counts[0]), press(names[often]), press(rank[which])
    longer = press(np.concatenate([np.zeros(0, np.int64), *counts[1:]]))
    return (known, words, longer) if len(known) + len(words) < len(plain) else (b"", plain, longer)


def _unpress_counts(row: dict, order: int) -> np.ndarray:
    """Order x token."""
    words = unpress(row["words"])
    words = unpress(row["known"])[words] if row["known"] else words
    return np.concatenate([words, unpress(row["longer"])]).reshape(order, -1)


def count(chunks: DataFrame, order: int, spans: int | None = None, fan: int = FAN) -> DataFrame:
    """The chunks with the training counts of each token's n-grams, in sheets of some documents, written to the shared folder.

    `known`, `words` and `longer` hold the counts order by order, as `_press_counts` writes them; `part`, for the tokens of the part that sets the weights, what that part
    counts of them.  n, v: the sheet's training tokens, and those of its chunk's training words that the chunk owns (on its first
    sheet, so that they add up to the corpus' vocabulary); n_part the tokens of the part, v_part the owned words without it."""
    size = chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("tokens")).first()
    spans = max(1, 2 * size["n"]) if spans is None else spans
    bits = min(64, (order * size["tokens"]).bit_length() + SPARE)
    asked = chunks.select("chunk", "lengths", "tokens", "words", "roles")

    answers = exchange(asked, lambda row: _asks(row, order, bits), COUNTS, spans, fan)
    ranges = cuts(spans, fan)

    def join(chunk: pa.Table, answered: pa.Table) -> pa.Table:
        out = []
        replies = answered.to_pylist()
        for row in chunk.to_pylist():
            grams, places = map(list, zip(*_grams(row, order, bits), strict=True))
            counts = [np.empty((len(g), 2), dtype=np.int64) for g in grams]  # in training, in the part
            v = v_part = 0
            for own, known in answers_by_range(grams, replies, COUNTS, ranges):
                for into, at, x in zip(counts, own, known, strict=True):
                    into[at] = x[:, :2]
                words = known[0][known[0][:, 2] == row["chunk"]]
                v += int((words[:, 0] > 0).sum())
                v_part += int((words[:, 0] > words[:, 1]).sum())
            del grams
            lengths, roles = np.asarray(row["lengths"], dtype=np.int64), np.frombuffer(row["roles"], np.uint8)
            ends = lengths.cumsum()
            for a, z in _sheets(lengths):
                role = np.repeat(roles[a:z], lengths[a:z])
                part_only = role == 2
                mine = [place[ends[a] - lengths[a] : ends[z - 1]] for place in places]
                train = [x[:, 0][place] for x, place in zip(counts, mine, strict=True)]
                part = np.concatenate([x[:, 1][place[part_only]] for x, place in zip(counts, mine, strict=True)])
                totals = (int((role > 0).sum()), 0 if a else v, int(part_only.sum()), 0 if a else v_part)
                out.append((*(row[c][a:z] for c in ("doc_ids", "held_out", "lengths", "roles")), *_press_counts(train), press(part), *totals))
        return pa.Table.from_batches([_rows(out, COUNTED)])

    return stored(chunks.groupBy("chunk").cogroup(answers.groupBy("block")).applyInArrow(join, COUNTED), "lm-counts")


def _estimates(counts: np.ndarray, lengths: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Per token the estimates (uniform, word, bigram, ...) and the bucket of its context.

    counts: order x token.  The vocabulary has one member for all unknown words.  After a context that was never seen, an
    n-gram's estimate is that of the shorter one, and the bucket that of the shorter context."""
    lasts = lengths.cumsum() - 1
    starts = lasts - lengths + 1
    out = [np.full(counts.shape[1], 1.0 / (v + 1)), counts[0] / max(n, 1)]
    bucket = np.zeros(counts.shape[1], dtype=np.int64)
    for k in range(1, len(counts)):
        context = np.concatenate([[0], counts[k - 1][:-1]])
        context[starts] = counts[0][lasts]  # as many texts begin as end
        seen = context > 0
        out.append(np.where(seen, counts[k] / np.maximum(context, 1), out[-1]))
        bucket = np.where(seen, (k - 1) * BUCKETS + np.minimum(np.ceil(np.log2(context + 1)), BUCKETS - 1).astype(np.int64), bucket)
    return np.stack(out, axis=1), bucket


def mixture_weights(bucket: np.ndarray, p: np.ndarray, n: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Weights (bucket x estimate) that make n held-out tokens of each kind likeliest; a bucket without any takes the
    weights of all tokens together."""

    def learn(b: np.ndarray, size: int) -> np.ndarray:
        w = np.full((size, p.shape[1]), 1.0 / p.shape[1])
        for _ in range(EM_ROUNDS):
            share = w[b] * p
            share *= (n / share.sum(axis=1))[:, None]
            total = np.stack([np.bincount(b, share[:, k], size) for k in range(p.shape[1])], axis=1)
            mass = total.sum(axis=1, keepdims=True)
            w = np.where(mass > 0, total / np.maximum(mass, 1e-300), w)
        return w

    if not len(n):
        return np.full((buckets, p.shape[1]), 1.0 / p.shape[1])
    together, each = learn(np.zeros_like(bucket), 1), learn(bucket, buckets)
    seen = np.bincount(bucket, n, buckets) > 0
    # a weight that no held-out token supports must not forbid a text
    mixed = np.where(seen[:, None], each, together) * (1 - 1e-4) + together * 0.5e-4 + 0.5e-4 / p.shape[1]
    return mixed / mixed.sum(axis=1, keepdims=True)


def _batches(df: DataFrame, of, schema: str) -> DataFrame:
    """`of` each row, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()):
            yield from of(row).to_batches()

    return df.mapInArrow(run, schema)


def _held_out_cells(counted: DataFrame, order: int, n: int, v: int) -> DataFrame:
    """(cell, n): tokens of the held-out part by bucket and by their estimates from the other training texts."""

    def cells(row: dict) -> pa.Table:
        held = np.frombuffer(row["roles"], np.uint8) == 2
        lengths = np.asarray(row["lengths"], dtype=np.int64)
        own = np.repeat(held, lengths)
        found, number = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if own.any():
            counts = _unpress_counts(row, order)[:, own] - unpress(row["part"]).reshape(order, -1)
            p, bucket = _estimates(counts, lengths[held], n, v)
            with np.errstate(divide="ignore"):
                steps = np.rint(np.log(p[:, 1:] * (v + 1)) / STEP)
            code = bucket
            for k in range(order):
                code = code * STEPS + np.where(np.isfinite(steps[:, k]), steps[:, k] + STEPS // 2, 0).astype(np.int64)
            found, number = np.unique(code, return_counts=True)
        return pa.table({"cell": pa.array(found, pa.int64()), "n": pa.array(number, pa.int64())})

    return _batches(counted.select("lengths", "roles", "known", "words", "longer", "part"), cells, CELLS).groupBy("cell").agg(F.sum("n").alias("n"))


def fit(counted: DataFrame, order: int, n: int, v: int) -> np.ndarray:
    """The mixture weights.  The table of held-out tokens has at most buckets x steps^order rows, whatever the corpus is: a
    step of STEP logarithms each for what lies between one in all tokens and one."""
    got = _held_out_cells(counted, order, n, v).toPandas()
    cell, p = got["cell"].to_numpy(dtype=np.int64), []
    for _ in range(order):
        step, cell = cell % STEPS, cell // STEPS
        p.append(np.where(step == 0, 0.0, np.exp((step - STEPS // 2) * STEP)))  # relative to the uniform estimate
    p = np.stack([np.ones(len(got)), *reversed(p)], axis=1)
    return mixture_weights(cell, p, got["n"].to_numpy(dtype=float), BUCKETS * max(1, order - 1))


def score(docs: DataFrame, held_out, part=None, key: str = "doc_id", text: str = "text", order: int = ORDER, spans: int | None = None, fan: int = FAN) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    held_out: a boolean column; rows where it is true are scored but teach nothing.  part: training rows whose counts set
    the weights (default: one in eight by crc32 of the key).  order: the longest n-gram, 1 to 5.  spans: key ranges of the
    exchange (default: two a chunk), beyond `fan` asked over two levels.  base_score adds one to every word's count.  A null text is empty and has the end
    alone; a text of any length is one document of its chunk; repeated rows count as often as they occur; other columns are
    not read; without training rows every base score is 0, and a table without rows gives none.
    """
    if not 1 <= order <= TOP_ORDER:
        raise ValueError(f"order must be 1 to {TOP_ORDER}")
    part = crc32_mod(key, 8) == 5 if part is None else part
    chunks, name = code(docs, held_out, part, key, text)
    counted = count(chunks, order, spans, fan)
    docs.sparkSession.sql(f"drop table {name}")  # the catalog's entry: the counts no longer read it
    sums = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n_part", "v_part")]).first()
    n, v = sums["n"], sums["v"]
    weights = fit(counted, order, n - sums["n_part"], sums["v_part"])

    def finish(row: dict) -> pa.Table:
        lengths = np.asarray(row["lengths"], dtype=np.int64)
        counts = _unpress_counts(row, order)
        p, bucket = _estimates(counts, lengths, n, v)
        both = np.log10((weights[bucket] * p).sum(axis=1))
        base = np.log10((counts[0] + 1) / (n + v + 1))
        starts = lengths.cumsum() - lengths
        add = lambda x: np.add.reduceat(x, starts)
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held_out"], pa.bool_()), "n_tokens": pa.array(lengths),
            "n_known": pa.array(add((counts[0] > 0).astype(np.int64))), "base_score": pa.array(add(base)), "score": pa.array(add(both)),
        })

    scored = _batches(counted.select("doc_ids", "held_out", "lengths", "known", "words", "longer"), finish, SCORED)
    return scored.select(F.col("doc_id").alias(key), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
