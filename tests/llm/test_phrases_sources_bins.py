"""Collocations, source divergence and genetic packing against brute force, on small tables of awkward rows."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltworks.llm import collocations, divergence, genetic_packing

DOCS = "doc_id long, text string, lang string, source string, hash long, k int, n long, p0 string, shard string, f string, piece string, pieces string"


def _docs(spark, rows):
    extra = (7, 8, 9, "p0", "shard", "f", "piece", "pieces")  # names that the operators use themselves
    return spark.createDataFrame([(*r, *extra) for r in rows], DOCS).repartition(3)


def _prose(seed, n, langs=("en", "de", None), sources=("a", "b", None, "ü", "")):
    rng = random.Random(seed)
    words = ["the", "The", "big", "cat", "sat", "été", "Über", "x1", "on", "mat", "\x00z", "日本"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b", " - "]) for _ in range(rng.choice([0, 1, 5, 40, 150])))
        rows.append((rng.choice([None, i, i, 5]), rng.choice([text, text, text, None]), rng.choice(langs), rng.choice(sources)))
    return rows + rows[:3] + [(9, "the big cat " * 3000, "en", "a"), (10, "word " * 50 + "." * 2000, "en", "a")]


def _lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def _brute_collocations(rows, support, longest=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", _lower(text)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = set()
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= support and len(p) > 1}
        held = set()
        for long_, c in often.items():
            for size in range(2, len(long_)):
                for i in range(len(long_) - size + 1):
                    part = long_[i : i + size]
                    if c >= often[part]:
                        held.add(part)
        best = []
        for p, a in often.items():
            if p in held:
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


@pytest.mark.parametrize(("shard", "chunk", "top"), [(4_000_000, 400_000, 2000), (900, 200, 2000), (50, 20, 7)])
def test_collocations_are_those_of_brute_force(spark, monkeypatch, shard, chunk, top):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    monkeypatch.setattr(collocations, "CHUNK_WORDS", chunk)
    rows = _prose(3, 60)
    got = collocations.collocations(_docs(spark, rows), support=6, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    want = _brute_collocations(rows, 6, top=top)
    assert len(want) >= 20
    assert {tuple(r) for r in got.collect()} == want


def test_a_phrase_below_its_share_in_all_shards_but_one_is_found(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_WORDS", 500)
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 100)
    rows = [(i, f"a{i} b{i} c{i} rare pair d{i}", "en", "s") for i in range(10)] + [(99, " ".join(f"w{i}" for i in range(5000)), "en", "s")]
    got = collocations.collocations(_docs(spark, rows), support=10).collect()
    assert [(r["phrase"], r["a"], r["l"], r["r"]) for r in got] == [("rare pair", 10, 10, 10)]


def test_a_shard_counts_only_what_may_be_frequent_and_holds_little():
    """However many shards a language has, a phrase is looked at only where both its parts are frequent."""
    rng = np.random.default_rng(5)
    numbers = rng.integers(0, 40_000, 500_000)  # of 40,000 words half are frequent, none of the pairs of others is looked at
    chunks = []
    for i, some in enumerate(np.split(numbers, 5)):
        chunk = collocations._Chunk()
        chunk.add([b"w%d" % x for x in some.tolist()] + [b"."])
        number, lang, _, _, tokens, words = chunk.row(i, "en")
        chunks.append((number, lang, 0, tokens, words))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*chunks, strict=True)], names=["chunk", "lang", "shard", "tokens", "words"])
    bits, ranges = 25, 3
    sieve = np.zeros(1 << bits - 3, np.uint8)
    often = np.array([xxhash.xxh64_intdigest(b"w%d" % x) for x in range(20_000)], dtype=np.uint64)
    often = collocations._mix(np.full(20_000, np.uint64(xxhash.xxh64_intdigest(b"en", 1))), often)
    for bit in (often >> np.uint64(64 - bits)).tolist():
        sieve[bit >> 3] |= 1 << (bit & 7)
    tracemalloc.start()
    n, rows = 0, 0
    for found in collocations._tally(iter([batch]), 2, sieve, ranges, bits):
        for row in found.to_pylist():
            counts = collocations._unpressed(row["n"])
            n, rows = n + int(counts.sum()), rows + len(counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pairs = [p for some in np.split(numbers, 5) for p in zip(some[:-1].tolist(), some[1:].tolist(), strict=True) if max(p) < 20_000]
    assert len(pairs) <= n < 1.02 * len(pairs) and len(set(pairs)) <= rows < 1.02 * len(set(pairs))  # a few more by chance
    assert peak < 60 * len(numbers)


def test_products_beyond_64_bits(spark):
    """Scores of counts that are far too large to multiply in 64 bits."""
    row = spark.createDataFrame([(10**12, 10**14, 10**12, 10**13)], "a long, n long, l long, r long")
    top = (collocations._wide("a") * F.lit(1000).cast("decimal(4,0)")) * collocations._wide("n")
    got = row.withColumns({"_top": top, "_low": collocations._wide("l") * collocations._wide("r")}).select(F.expr("_top div _low")).first()[0]
    assert got == 1000 * 10**12 * 10**14 // (10**12 * 10**13)


def test_no_texts_no_phrases(spark):
    for rows in ([], [(1, None, None, None), (2, "", "en", "a"), (3, " .,\n", "en", "a")]):
        assert collocations.collocations(_docs(spark, rows), support=1).collect() == []


def _brute_divergence(rows, least, top=10):
    docs, total, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", _lower(text))
        docs[lang].update(set(terms))
        total[lang].update(terms)
        counts[lang, source].update(terms)
    share = lambda n, size, v: 1 + 10**9 * (n + 2) // (size + 2 * v)
    apart = lambda p, q: (p - q) * (p - q) // (p + q)
    out = set()
    for lang, source in groups:
        kept = [t for t, d in docs[lang].items() if d >= least]
        p = {}
        for x, s in groups:
            if x == lang:
                size = sum(counts[x, s][t] for t in kept)
                p[s] = {t: share(counts[x, s][t], size, len(kept)) for t in kept}
        every = sum(total[lang][t] for t in kept)
        q = {t: share(total[lang][t], every, len(kept)) for t in kept}
        pairs = sorted((-sum(apart(p[source][t], p[s][t]) for t in kept), s.encode()) for s in p if s != source)
        terms = sorted((-apart(p[source][t], q[t]), t.encode()) for t in kept if counts[lang, source][t] and p[source][t] > q[t])[:top]
        out |= {(lang, source, "pair", i.decode(), -v, r) for r, (v, i) in enumerate(pairs, 1)}
        out |= {(lang, source, "term", i.decode(), -v, r) for r, (v, i) in enumerate(terms, 1)}
    return out


@pytest.mark.parametrize(("block", "page", "pairs", "buffer", "least"), [(1_500_000, 50_000, 2_000_000, 200_000, 3), (30, 4, 5, 9, 3), (1, 1, 1, 1, 1), (100, 10, 10, 10, 10_000)])
def test_divergence_is_that_of_brute_force(spark, monkeypatch, block, page, pairs, buffer, least):
    rows = _prose(4, 40) + [(77, None, "fr", "empty"), (78, "", "fr", "b")]
    index, merge, corrections = divergence._index, divergence._merge, divergence._corrections

    def small(fn):
        def run(*args):
            from siltworks.llm import divergence as d

            d.BLOCK_POSTINGS, d.PAGE, d.PAIRS, d.BUFFER = block, page, pairs, buffer
            return fn(*args)

        return run

    for name, fn in (("_index", index), ("_merge", merge), ("_corrections", corrections)):
        monkeypatch.setattr(divergence, name, small(fn))
    got = divergence.divergence(_docs(spark, rows), least_docs=least).select("lang", "source", "part", "item", "value", "rank")
    assert {tuple(r) for r in got.collect()} == _brute_divergence(rows, least)
    # workers are used again: leave them as they were
    monkeypatch.undo()
    spark.range(16, numPartitions=16).mapInArrow(_restore, "id long").count()


def _restore(batches):
    import importlib

    from siltworks.llm import divergence as d

    importlib.reload(d)
    yield from batches


def test_no_documents_no_divergence(spark):
    assert divergence.divergence(_docs(spark, [])).collect() == []


def test_pages_are_opened_only_when_their_terms_come():
    """Runs of a shard stream through the merge: of 50 pages that don't overlap one is open at a time."""
    block = divergence._Block()
    for i in range(500):
        block.add("en", "s", [b"t%05d" % i, b"t%05d" % (i + 1)])
    divergence_page, divergence.PAGE = divergence.PAGE, 10
    try:
        rows = [r for b in block.runs(1) for r in b.to_pylist()]
    finally:
        divergence.PAGE = divergence_page
    taken = 0

    def counted():
        nonlocal taken
        for r in rows:
            taken += 1
            yield r

    ahead = 0
    for k, ((_, _, term), docs, counts) in enumerate(divergence.merged(counted())):
        assert term == b"t%05d" % k and docs == counts["s"] == (1 if k in (0, 500) else 2)
        ahead = max(ahead, taken - k // 10)
    assert len(rows) > 40 and ahead <= 3


def _packed(spark, rows, **options):
    got = [r.asDict() for r in genetic_packing.pack(_docs(spark, rows), **options).collect()]
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
    for members in by.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
    return got, by


def test_packing_places_every_id_once(spark):
    rows = _prose(5, 50)
    got, by = _packed(spark, rows, tokens=64, group=20)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    want = Counter()
    for doc, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 64)):
            part = np.asarray(ids[at : at + 64], "<u4").tobytes()
            want[doc, p, at, len(part) // 4, part, len(ids)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]) for r in got) == want
    assert all(sum(r["length"] for r in m) <= 64 for m in by.values())
    assert len(by) <= -(-sum(r["length"] for r in got) // 64) + 4


def test_empty_tables_pack_to_nothing(spark):
    assert _packed(spark, [])[0] == []
    got, _ = _packed(spark, [(None, None, None, None), (1, "", "x", "y")])
    assert [r["length"] for r in got] == [1, 1] and len({r["sequence_id"] for r in got}) == 1


def _fewest(lengths, limit):
    best = len(lengths)
    for bins in product(range(len(lengths)), repeat=len(lengths)):
        used = Counter()
        for b, n in zip(bins, lengths, strict=True):
            used[b] += n
        if max(used.values()) <= limit:
            best = min(best, len(used))
    return best


def test_small_groups_are_packed_as_well_as_can_be():
    rng = random.Random(6)
    for case in range(25):
        lengths = np.array([rng.randint(1, 50) for _ in range(6)])
        members = genetic_packing.evolve([], lengths, 60, np.random.default_rng(case))
        assert genetic_packing.fitness(members[0], lengths, 60)[0] == _fewest(lengths.tolist(), 60)


def _triplets(n, rng, limit=1000):
    out = []
    for _ in range(n):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(190, (limit - a) // 2))
        out += [a, b, limit - a - b]
    return np.array(out)


def test_evolution_beats_best_fit_where_best_fit_fails():
    rng = np.random.default_rng(8)
    lengths = _triplets(40, rng)
    greedy = genetic_packing.best_fit(np.full(len(lengths), -1), genetic_packing._falling(np.arange(len(lengths)), lengths), lengths, 1000)
    members = genetic_packing.evolve([], lengths, 1000, rng, size=8, generations=60)
    assert genetic_packing.fitness(members[0], lengths, 1000)[0] < len(np.unique(greedy))
    assert np.bincount(members[0], lengths).max() <= 1000


def test_crossover_keeps_injected_bins_whole():
    rng = np.random.default_rng(9)
    lengths = rng.integers(1, 400, 200)
    a, b = (genetic_packing.best_fit(np.full(200, -1), rng.permutation(200), lengths, 1000) for _ in range(2))
    child = genetic_packing.crossover(a, b, lengths, 1000, rng)
    assert np.bincount(child, lengths).max() <= 1000 and (np.bincount(child) > 0).all()
    groups = {frozenset(np.flatnonzero(child == x)) for x in range(child.max() + 1)}
    whole = sum(any(frozenset(np.flatnonzero(b == x)) <= g for g in groups) for x in range(b.max() + 1))
    assert whole >= 5


def test_islands_exchange_their_best(spark):
    """Groups that best fit can't bring to the bound go through all epochs, and every piece is still placed once."""
    lengths = _triplets(60, np.random.default_rng(10)).tolist()
    rest = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "piece_id long, length long")
    got = genetic_packing.place(rest, 1000, group=90).collect()
    assert sorted(r["piece_id"] for r in got) == list(range(len(lengths)))
    used = Counter()
    for r in got:
        used[r["sequence_id"]] += lengths[r["piece_id"]]
    assert max(used.values()) <= 1000 and len(used) <= 64


def test_words_are_encoded_as_whole_texts_are():
    encoder = genetic_packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), memo=50)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    rng = random.Random(2)
    signs = list(" \t\n\x0b\x1c\x85  　abXYZΣσςÉ́'s'll12٣<|endoftext|>.,!?中文한‍ͅİß😀\x00")
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 20)))
        assert encoder.ids(text) == np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
