"""Mixing, packing, near copies and the pipeline against brute force."""

import collections
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from siltworks.llm import mixing, ngram_join, nn_descent, packing
from siltworks.llm.common import components, stored
from siltworks.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


def closure(ids, links):
    """Smallest reachable id of each."""
    near = collections.defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    low = {}
    for start in sorted(ids):
        stack = [start]
        while stack:
            x = stack.pop()
            if x not in low:
                low[x] = start
                stack += near[x]
    return low


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert got == closure({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_copies(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    low = closure([i for i, _ in rows], links)
    return sorted((i, len(s), low[i]) for i, s in sets)


def test_near_copies_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One\ttwo"), (5, "one two three four five"), (6, "a b c d e f g h"), (7, "x a b c d e f g h")]
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 8, 25])):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 25) + 1)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if g % 3 == 0:
                at = rng.randrange(len(w))
                w[at:at] = passage
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, t) for k, (_, t) in enumerate(rows[20:40])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit("x"), "n": F.lit(0)}).repartition(6)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_copies(df).collect())
    assert got == brute_copies(rows)


def test_a_large_group_and_common_passages_make_few_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base, passage = [rng.choice(words) for _ in range(150)], [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(400):
        w = list(base) if i < 200 else [rng.choice(words) for _ in range(100)] + passage
        for _ in range(3 if i < 200 else 0):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    made = []
    real = ngram_join._pairs

    def counted(*a):
        df = stored(real(*a), "counted")
        made.append(df.count())
        return df

    ngram_join._pairs = counted
    try:
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    finally:
        ngram_join._pairs = real
    assert got == brute_copies(rows)
    assert sum(made) < 39_800 / 5  # pairs in the group and pairs that share the passage: 19,900 each


def test_near_copies_edge_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "q"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_copies(df).collect()), key=str)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 1, None), (None, 0, None)], key=str)
    assert ngram_join.near_copies(df.limit(0)).count() == 0


def brute_vectors(rows):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        return np.asarray(v, dtype=float) / np.linalg.norm(v)

    units = [(i, unit(v)) for i, v in rows]
    count, links = [0] * len(rows), []
    for a, (i, x) in enumerate(units):
        for b, (j, y) in enumerate(units):
            if a != b and x is not None and y is not None and len(x) == len(y) and x @ y >= 0.95:
                count[a] += 1
                links.append((i, j))
    low = closure([i for i, _ in rows], links)
    return sorted((i, n, low[i], i == low[i]) for (i, _), n in zip(rows, count, strict=True))


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(0, None), (1, []), (2, [0.0] * 8), (3, [1.0] * 7 + [None]), (4, [1.0] * 7 + [float("nan")]), (5, [1.0] * 7 + [float("inf")]), (6, [1.0, 2.0]), (7, [2.0, 4.0])]
    rows += [(len(rows) + k, v.astype(np.float32).tolist()) for k, v in enumerate(rng.standard_normal((900, 8)))]
    for size, noise in ((90, 0.03), (700, 0.02), (3, 0.01)):  # more than any list holds, more than a block holds
        center = rng.standard_normal(8)
        rows += [(len(rows) + k, (center + noise * rng.standard_normal(8)).astype(np.float32).tolist()) for k in range(size)]
    rows += [(len(rows) + k, rows[20][1]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"node": F.lit(1), "v": F.lit("x")}).repartition(6)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in nn_descent.near_vectors(df).collect())
    want = brute_vectors(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.99 * len(rows)
    assert nn_descent.near_vectors(df.limit(0)).count() == 0


def test_audit_sees_small_groups_beside_a_dense_one(spark, monkeypatch):
    """Seeds that only see the dense group: the pairs are a small part of all links, and only a full comparison finds them."""
    rng = np.random.default_rng(12)
    center = rng.standard_normal(16)
    rows = [(i, (center + 0.02 * rng.standard_normal(16)).tolist()) for i in range(600)]
    for _ in range(200):
        pair = rng.standard_normal(16)
        rows += [(len(rows) + k, (pair + 0.03 * rng.standard_normal(16)).tolist()) for k in range(2)]
    whole = nn_descent._partitioned
    monkeypatch.setattr(nn_descent, "_partitioned", lambda nodes, *rest: whole(nodes.where("first_key < 600"), *rest))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in nn_descent.near_vectors(df).collect())
    assert got == brute_vectors(rows)


def test_vectors_with_too_few_links_to_audit_are_compared_in_full(spark, monkeypatch):
    rng = np.random.default_rng(13)
    rows = [(i, rng.standard_normal(24).tolist()) for i in range(800)]
    rows += [(800 + i, [*rows[i][1][:-1], rows[i][1][-1] + 0.01]) for i in range(2)]
    whole = nn_descent._partitioned
    monkeypatch.setattr(nn_descent, "_partitioned", lambda nodes, *rest: whole(nodes.limit(0), *rest))
    monkeypatch.setattr(nn_descent, "MOST_AUDITED", nn_descent.AUDITED, raising=False)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in nn_descent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == brute_vectors(rows)


def test_partitions_grow_with_their_bits():
    for bits in (0, 4, 12, 20):
        meets = (1 - np.arccos(0.95) / np.pi) ** bits
        assert 1 - (1 - meets) ** nn_descent._trees(bits, 0.95) >= nn_descent.RECALL


def test_targets_share_the_excess():
    got = mixing.capped_targets({"a": 10, "b": 100, "c": 0}, {"a": 5, "b": 1, "c": 2}, 110, 3)
    assert got == {"a": 30.0, "b": 80.0, "c": 0.0}


def test_flow_fills_quotas_at_least_repetition():
    capacity = {"x": 100, "xy": 100, "y": 100}
    members = {"x": ["x"], "xy": ["x", "y"], "y": ["y"]}
    given = mixing.route(capacity, members, {"x": 200, "y": 100}, 3)
    assert {p: sum(v.values()) for p, v in given.items()} == {"x": 100, "xy": 100, "y": 100}
    assert given["xy"] == {"x": 100, "y": 0}
    given = mixing.route(capacity, members, {"x": 300, "y": 0}, 3)
    assert {p: sum(v.values()) for p, v in given.items()} == {"x": 150, "xy": 150, "y": 0} or sum(given["x"].values()) + sum(given["xy"].values()) == 300


def test_mix_takes_near_the_targets(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", "é", None]), rng.choice([0, 1, 5, 30])) for i in range(3000)] + [(None, "b", 4), (7, "a", 9), (8, "tiny", 2), (9, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumns({"copies": F.lit("x"), "_size": F.lit(0), "s": F.array("source")})
    once = mixing.mix(df, "size", "s")
    assert set(once.columns) == {"doc_id", "source", "size", "_size", "s", *mixing.RESULTS}
    got = sorted(((r.doc_id, r.source, r["size"], r.copies, r.taken, r.source_size, r.target) for r in once.collect()), key=str)
    again = mixing.mix(df.repartition(5), "size", "s").collect()
    assert got == sorted(((r.doc_id, r.source, r["size"], r.copies, r.taken, r.source_size, r.target) for r in again), key=str)
    assert len(got) == len(rows)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for _, s, n, copies, t, _, goal in got:
        size[s] += n or 0
        taken[s] += t
        target[s] = goal
        assert t == copies * (n or 0) and 0 <= copies <= 3
    want = mixing.capped_targets(size, dict(zip(mixing.by_code_point(size), [5, 2, 1, 5, 2], strict=False)), sum(size.values()), 3)
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 30
    assert mixing.mix(df.limit(0), "size", "s").count() == 0


def test_packing_holds_every_id_once_under_all_limits(spark):
    rng = random.Random(6)
    texts = [None, "", "é" * 3000, "<|endoftext|> x", "日本 \u0085 z", "a" * 9000] + [" ".join(rng.choice(["the", "thio", "é!", "42"]) for _ in range(rng.randrange(900))) for _ in range(120)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(6, texts[6], 1), (None, "q", 1)], "doc_id long, text string, length int")
    encoded = stored(packing.encode_texts(df, "doc_id", "text"), "encoded")
    slow = packing.Encoder(packing.public_tokenizers.path("byte_bpe_50k.json"), None)
    sources = collections.Counter((r.key, bytes(r.ids)) for r in encoded.collect())
    assert all(ids == np.append(slow.ids(texts[k] or ""), 0).astype("<u4").tobytes() for k, ids in sources if k is not None)
    half = F.transform(F.sequence(F.lit(1), F.col("doc_tokens").cast("int")), lambda i: F.pmod(i, F.lit(2)).cast("string"))
    masked = encoded.withColumn("mask", F.to_binary(F.regexp_replace(F.regexp_replace(F.array_join(half, ""), "0", "00"), "1", "01"), F.lit("hex")))
    for table, limits in ((encoded, dict(tokens=256, segments=4)), (masked, dict(tokens=256, segments=4, loss=100))):
        pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
        for r in packing.pack(table, **limits, group=40).collect():
            pieces[r.key].append(r)
            sequences[r.sequence_id].append(r)
            assert len(r.ids) == 4 * r.length
        for key, rs in pieces.items():
            copies = sum(n for (k, _), n in sources.items() if k == key)
            ids = next(i for k, i in sources if k == key)
            assert sum(r.length for r in rs) == copies * len(ids) // 4
            assert all(bytes(r.ids) == ids[4 * r.start : 4 * (r.start + r.length)] for r in rs)
        for rs in sequences.values():
            at = 0
            for r in sorted(rs, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 256 and len(rs) <= 4 and sum(r.loss for r in rs) <= limits.get("loss", 256)
    assert packing.pack(encoded.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "src0", 0), (None, "loose words here", None, None, 5)], docs.schema)
    rows = stored(docs.unionByName(odd).withColumns({"score": F.lit(1), "copies": F.lit(2), "secrets": F.lit("x")}), "pipeline")
    seen = None
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stored(stage(spark, rows, SF), "stage")
        if name != "packing":
            assert tuple(rows.columns) == corpus_pipeline.COLUMNS, name
        if name == "n-gram Jaccard join":
            texts = [(r.doc_id, r.text) for r in before.where("doc_id is not null").collect()]
            want = sorted(i for i, _, low in brute_copies(texts) if i == low)
            assert sorted(r.doc_id for r in rows.where("doc_id is not null").collect()) == want
        if name == "secret scans":
            assert rows.count() == before.count() and rows.where("text rlike 'AKIA[A-Z0-9]{14,}'").count() == 0
        if name == "mixing sources to target weights":
            seen = rows.select(F.sum(F.size(F.split("text", r"\s+")))).first()[0]
    assert seen and rows.count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_queries_against_their_sql(spark):
    con = connect(SF)
    for name in ORACLES:
        assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF) is None, name


def test_other_queries_return_a_row_per_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op2_quality", "op3_secrets", "op7_mixing", "op8_rules", "op9_lm"):
        assert QUERIES[name](spark, SF).count() == n, name


def test_a_long_list_is_dealt_by_the_members_outside(spark):
    members = spark.range(5000).selectExpr("1L as gram", "id as node", "10L as n", "0L as own", "0L as before", "case when id < 3 then id else 3 end as label", "5000L as _all", "3L as _out", "3L as _top")
    left, right = ngram_join._dealt(members)
    # all members once, and each of the three outside to all blocks
    assert right.count() == 5000 and left.count() == 3 * 20
    met = left.join(right, ["gram", "_a", "_b"]).select("node", "other")
    assert met.count() == met.distinct().count() == 3 * 5000
