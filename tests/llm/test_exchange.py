"""Blocks that tell each other what they share, and the n-gram join and the pipeline's stage built on them."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltworks.llm import exchange, ngram_join


def _table(spark, rng, blocks, size, space):
    """Blocks of keys that lie all over the ranges, and what they are."""
    rows = [(b, sorted({rng.randrange(space) * (2**64 // space) for _ in range(size)})) for b in range(blocks)]
    return rows, spark.createDataFrame([(b, [k - 2**63 for k in keys]) for b, keys in rows], "block long, shifted array<long>").repartition(4)


def _keys(row):
    return (np.asarray(row["shifted"], dtype=np.int64).view(np.uint64) + np.uint64(2**63)).astype(np.uint64)


@pytest.mark.parametrize(("spans", "fan"), [(1, 128), (40, 128), (40, 4), (200, 3)])
def test_sums_come_back_in_the_order_asked(spark, spans, fan):
    rng = random.Random(spans)
    rows, table = _table(spark, rng, 30, 60, 500)

    def asks(row):
        keys = _keys(row)
        return row["block"], keys, np.stack([np.full(len(keys), row["block"]), np.ones(len(keys))], axis=1).astype(np.int64)

    total, n = Counter(), Counter()
    for b, keys in rows:
        total.update(dict.fromkeys(keys, b))
        n.update(keys)
    answers = defaultdict(list)
    for r in exchange.exchange(table, asks, exchange.SUMS, spans, fan).collect():
        answers[r["block"]].append(r.asDict())
    for b, keys in rows:
        got = exchange.answers_of(np.array(keys, dtype=np.uint64), answers[b], exchange.SUMS, exchange.cuts(spans, fan))
        assert got.tolist() == [[total[k], n[k]] for k in keys]


@pytest.mark.parametrize(("spans", "fan"), [(9, 128), (60, 5)])
def test_a_key_has_several_owners_or_one(spark, spans, fan):
    rows, table = _table(spark, random.Random(7), 24, 50, 400)
    owner = lambda b: b // 3  # three blocks have one owner
    owners = defaultdict(set)
    for b, keys in rows:
        for k in keys:
            owners[k].add(owner(b))
    answers = defaultdict(list)
    asks = lambda r: (r["block"], _keys(r), np.full((len(r["shifted"]), 1), r["block"] // 3))
    for r in exchange.exchange(table, asks, exchange.SEVERAL, spans, fan).collect():
        answers[r["block"]].append(r.asDict())
    for b, keys in rows:
        got = exchange.answers_of(np.array(keys, dtype=np.uint64), answers[b], exchange.SEVERAL, exchange.cuts(spans, fan))
        assert got.tolist() == [len(owners[k]) > 1 for k in keys]


def test_rows_of_the_exchange_grow_with_the_data(spark):
    """Five times the blocks and ranges make at most about five to the power of one and a half times the pieces, not 25."""
    def pieces(blocks):
        _, table = _table(spark, random.Random(1), blocks, 400, 2**40)
        asks = lambda r: (r["block"], _keys(r), np.ones((len(r["shifted"]), 1), np.int64))
        return exchange.exchange(table, asks, exchange.SUMS, blocks, 4).count()

    assert pieces(100) < 13 * pieces(20)


def _jaccard_links(texts):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    return {(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}


def _components(n, links):
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def _family(rng, members, apart, length=220):
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(members):
        own = list(base)
        for at in rng.sample(range(length - 60), apart):
            own[at] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("block", "span", "fan", "list_"), [(700_000, 1_000_000, 128, 256), (300, 100, 4, 3)])
def test_small_blocks_and_two_levels_give_the_same_components(spark, monkeypatch, block, span, fan, list_):
    for name, value in (("BLOCK", block), ("SPAN", span), ("FAN", fan), ("LIST", list_)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(5)
    texts = _family(rng, 12, 5) + _family(rng, 12, 3) + _family(rng, 10, 1) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(80)) for _ in range(25)]
    texts += texts[:4]
    order = list(range(len(texts)))
    docs = spark.createDataFrame([(i, texts[i]) for i in rng.sample(order, len(order))], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_copies(docs).collect()}
    links = _jaccard_links(texts)
    assert len(links) > 30
    assert got == dict(enumerate(_components(len(texts), links)))


def test_texts_under_one_id_leave_by_themselves(spark):
    rng = random.Random(3)
    a, near = _family(rng, 2, 1)
    other = " ".join(f"v{i}" for i in range(90))
    docs = spark.createDataFrame([(3, a, "en", "s", 1), (5, near, "en", "s", 1), (5, other, "en", "s", 1), (5, other, "en", "s", 1), (6, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_copy_stage(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == sorted([(3, a), (5, other), (6, "")])


def test_text_hash_is_that_of_spark(spark):
    docs = spark.createDataFrame([(1, "Ünï cödé TEXT of words"), (2, ""), (3, "a b c d e f g")], "doc_id long, text string")
    want = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("text")).collect()}
    assert {r["doc_id"]: r["text_hash"] for r in ngram_join.near_copies(docs).collect()} == want


def test_short_keys_cost_little_beside_long_ones():
    rng = np.random.default_rng(3)
    short = (rng.integers(0, 1 << 49, 5000, dtype=np.uint64) // np.uint64(320)) << np.uint64(15)  # of one range
    keys = np.unique(np.concatenate([short, rng.integers(0, 1 << 63, 500, dtype=np.uint64) // np.uint64(160)]))
    blob = exchange.press_keys(keys)
    assert (exchange.unpress_keys(blob) == keys).all()
    assert len(blob) < 4.1 * len(keys)
