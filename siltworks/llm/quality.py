"""A quality classifier: histogram gradient-boosted trees over statistics of whole documents.

Statistics are computed once, in Arrow batches, and written.  The trees are fitted on the driver from a bounded sample of
labelled rows (`SAMPLE` rows, those of the smallest seeded hash), on values cut into at most `BINS` quantile bins.  They are
flattened into plain arrays, and scoring walks all documents of a batch down all trees at once in numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import stored

SAMPLE = 20_000
BINS = 64
FEATURES = (
    "log_bytes", "log_words", "lower_share", "upper_share", "digit_share", "space_share", "high_byte_share", "symbol_share", "mark_share", "bar_share",
    "stop_share", "byte_entropy", "word_length", "short_word_share", "capital_word_share", "distinct_word_share", "top_word_share", "top_three_share",
    "same_neighbour_share", "distinct_triple_share", "signed_word_share", "log_lines", "words_per_line", "dup_line_share",
)
_HALF = 0.5


def _members(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8))


_UPPER, _LOWER, _DIGIT = (_members(bytes(range(a, b))) for a, b in ((65, 91), (97, 123), (48, 58)))
_SPACE, _SYMBOL, _MARK, _BAR, _STOP = (_members(x) for x in (b" \t\n\v\f\r", b"#*$%&|<>@^~=_", b"!?", b"|", b".,;:"))


def document_features(text: str | None) -> np.ndarray:
    """The statistics of one text in the order of FEATURES; all 0 for a null or empty text."""
    out = np.zeros(len(FEATURES), dtype=np.float32)
    raw = (text or "").encode()
    if not raw:
        return out
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = counts[counts > 0] / n
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[0], out[1] = np.log1p(n), np.log1p(len(words))
    for k, member in ((2, _LOWER), (3, _UPPER), (4, _DIGIT), (5, _SPACE), (7, _SYMBOL), (8, _MARK), (9, _BAR), (10, _STOP)):
        out[k] = counts[member].sum() / n
    out[6] = counts[128:].sum() / n
    out[11] = -(p * np.log2(p)).sum()
    if words:
        w = len(words)
        tally = Counter(words)
        top = [c for _, c in tally.most_common(3)]
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=w)
        ends = Counter(x[-1] for x in words)
        out[12], out[13] = lengths.mean(), (lengths <= 3).mean()
        out[14] = sum(c for x, c in Counter(x[0] for x in words).items() if _UPPER[x]) / w
        out[15], out[16], out[17] = len(tally) / w, top[0] / w, sum(top) / w
        out[18] = sum(map(bytes.__eq__, words, words[1:])) / w
        out[19] = len(set(zip(words, words[1:], words[2:], strict=False))) / (w - 2) if w > 2 else 1.0
        out[20] = sum(c for x, c in ends.items() if _SYMBOL[x] or _MARK[x]) / w
    if lines:
        out[21], out[22], out[23] = np.log1p(len(lines)), len(words) / len(lines), 1 - len(set(lines)) / len(lines)
    return out


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, features array<float>): one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                x = np.concatenate([document_features(t) for t in part.column(1).to_pylist()])
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(x))], names=[key, "features"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, features array<float>")


@dataclass(frozen=True)
class Trees:
    """Flat trees: node i tests value[feature[i]] <= threshold[i] and goes to left[i] or right[i]; a leaf is its own child."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    fitted: bool = True

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, shrink: float = 1.0, least: float = 2.0) -> Trees:
    """Boosted trees for P(y = 1) under log loss, grown level by level from histograms of gradients.

    Without rows the score is 1/2; with one class only it is the smoothed share of that class."""
    x = np.asarray(x, dtype=np.float32).reshape(-1, len(FEATURES))
    y = np.asarray(y, dtype=float)
    empty = np.zeros(0, dtype=np.int64)
    rate0 = (y.sum() + _HALF) / (len(y) + 1.0)
    base = float(np.log(rate0 / (1 - rate0)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, empty, empty, empty.astype(np.float32), empty, empty, empty.astype(float), 0, len(y) > 0)
    m = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS, method="lower")) for f in range(m)]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # bin b: x <= edges[b]
    width = BINS + 1
    cells = bins + np.arange(m) * width
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for column, v in ((feature, 0), (threshold, np.inf), (left, len(left)), (right, len(right)), (value, 0.0)):
            column.append(v)
        return len(feature) - 1

    margin = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        root = node()
        roots.append(root)
        at, level = np.full(len(y), root), [root]
        for d in range(depth + 1):
            place = {k: i for i, k in enumerate(level)}
            local = np.array([place.get(k, -1) for k in range(len(feature))])[at]
            live = local >= 0
            k = len(level)
            index = (local[live, None] * (m * width) + cells[live]).ravel()
            hist_g = np.bincount(index, np.repeat(g[live], m), k * m * width).reshape(k, m, width)
            hist_h = np.bincount(index, np.repeat(h[live], m), k * m * width).reshape(k, m, width)
            total_g, total_h = hist_g[:, 0].sum(axis=1), hist_h[:, 0].sum(axis=1)
            for i, nd in enumerate(level):
                value[nd] = float(-rate * total_g[i] / (total_h[i] + shrink))
            if d == depth:
                break
            below_g, below_h = hist_g.cumsum(axis=2), hist_h.cumsum(axis=2)
            above_g, above_h = total_g[:, None, None] - below_g, total_h[:, None, None] - below_h
            worth = below_g**2 / (below_h + shrink) + above_g**2 / (above_h + shrink) - (total_g**2 / (total_h + shrink))[:, None, None]
            worth[(below_h < least) | (above_h < least)] = -np.inf
            following = []
            for i, nd in enumerate(level):
                f, b = np.unravel_index(int(np.argmax(worth[i])), worth[i].shape)
                if not worth[i, f, b] > 1e-6 or b >= len(edges[f]):
                    continue
                feature[nd], threshold[nd] = int(f), float(edges[f][b])
                left[nd], right[nd] = node(), node()
                own = at == nd
                at = np.where(own, np.where(bins[:, f] <= b, left[nd], right[nd]), at)
                following += [left[nd], right[nd]]
            level = following
            if not level:
                break
        margin += np.asarray(value)[at]
    integer = lambda v: np.asarray(v, dtype=np.int64)
    return Trees(base, integer(roots), integer(feature), np.asarray(threshold, np.float32), integer(left), integer(right), np.asarray(value), depth)


def fit_on(table: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE, seed: int = 17) -> Trees:
    """Trees fitted on at most `sample` labelled rows, those of the smallest seeded hash of the key.

    Labels other than 0 and 1 and null keys are left out; of several labels of a key the smallest counts."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).cast("double").alias("_y"))
    rows = table.join(known, key).withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    # a cut of the hash leaves somewhat more than the sample, so that no task sends a whole sample of its own
    part = min(1.0, 1.2 * sample / max(1, known.join(table.select(key), key, "left_semi").count()))
    rows = rows.where(F.pmod("_h", F.lit(1 << 30)) <= int(part * (1 << 30))).orderBy(F.pmod("_h", F.lit(1 << 30)), key).limit(sample).select("features", "_y").toPandas()
    return fit(np.stack(rows["features"].to_list()) if len(rows) else np.zeros((0, len(FEATURES))), rows["_y"].to_numpy())


def score(table: DataFrame, model: Trees, key: str = "doc_id") -> DataFrame:
    """(key, score): the model's probability of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.probability(x))], names=[key, "score"])

    return table.select(key, "features").mapInArrow(run, f"{key} long, score double")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> tuple[DataFrame, Trees]:
    """(key, score) of every document, and the trees; the features are written once and read for fitting and scoring.

    Every row of `docs` gets a row, repeated and null keys too; nothing but the text enters the score."""
    table = stored(features(docs, key, text), "features")
    model = fit_on(table, labels, key, label, sample)
    return score(table, model, key), model
