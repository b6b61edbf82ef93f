"""Skew, plans and brute force: what must hold whatever the size of the data."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from siltworks.functions import labels as L
from siltworks.functions.rules import Rule
from siltworks.operators import classify, dq, keyed, lineage
from siltworks.operators.upsert import upsert
from siltworks.plans.registry import table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hot(spark):
    """A third of the rows under one key, a third null, the rest in pairs and singles; spread over many tasks."""
    k = "case when id % 3 = 0 then null when id % 3 = 1 then 'hot' when id % 2 = 0 then 's' || id else 'p' || id div 12 end as k"
    return spark.range(0, 30000, 1, 16).selectExpr("id", k)


def test_marks_of_hot_keys_match_brute_force(spark):
    rows = [(r["id"], r["k"]) for r in hot(spark).collect()]
    n = {}
    for _, k in rows:
        n[k] = n.get(k, 0) + 1
    for threshold in ("10485760", "-1"):  # with and without broadcast joins
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = {r["id"]: r["x"] for r in keyed.mark_repeated(hot(spark), F.col("k"), "x").collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert got == {i: n[k] > 1 for i, k in rows}


def test_hot_rows_spread_over_the_shuffle(spark):
    """Rows of hot keys carry a salt, so no shuffle partition holds the third of the table that shares a key."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = keyed.mark_repeated(hot(spark), F.col("k"), "x").withColumn("part", F.spark_partition_id())
        largest = out.groupBy("part").count().agg(F.max("count")).first()[0]
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert largest < 30000 / 3


def test_orphans_match_brute_force(spark):
    parents = spark.createDataFrame([("hot",), ("s2",), (None,)], "pk string")
    got = {r["id"] for r in keyed.mark_orphans(hot(spark), F.col("k"), parents, "pk", "x").where("x").collect()}
    assert got == {r["id"] for r in hot(spark).collect() if r["k"] is not None and r["k"] not in ("hot", "s2")}


def test_long_texts_are_compared_whole(spark):
    long = "x" * 5000
    df = spark.createDataFrame([(1, long + "a"), (2, long + "b"), (3, long + "a"), (4, "short")], "i int, t string")
    assert {r["i"] for r in keyed.mark_repeated(df, F.col("t"), "m", True).where("m").collect()} == {1, 3}


def test_row_rules_need_no_shuffle(spark):
    rules = [Rule("l_quantity", "FLOAT", "RANGE", "ERROR", "1:9"), Rule("l_returnflag", "STRING", "REGEX", "WARN", "A")]
    p = plan(dq.valid_rows(dq.flag(table(spark, SF, "lineitem").select("l_quantity", "l_returnflag"), rules)))
    assert "Exchange" not in p and "WholeStageCodegen" in p or "*(1)" in p
    assert "l_shipdate" not in p


def test_upsert_cuts_groups_before_the_shuffle(spark):
    li = table(spark, SF, "lineitem")
    p = plan(upsert(li, li, ["l_orderkey"], "l_shipdate", ["l_linenumber"]))
    before = p[p.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before and "Partial" in before


@pytest.mark.parametrize("name", ["catalog_path_match", "dq_referential", "silver_upsert", "flow_destinations", "catalog_merge"])
def test_no_nested_loop_joins(spark, name):
    from siltworks.plans.registry import QUERIES, load_all

    load_all()
    p = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_required_words_are_in_every_match():
    """Texts built around each pattern's words: whenever the pattern matches, its required word is there."""
    rng = random.Random(7)
    catalogs = (L.FRAMEWORKS, L.SOURCES, L.INGESTION, L.SQL_CHECKS, L.CHECK_TOOLS, tuple((p, (p,)) for p in L.SUITE_PATTERNS))
    patterns = [p.lower() for _, ps in itertools.chain(*catalogs) for p in ps]
    words = sorted({w for p in patterns for w in re.findall(r"[a-z0-9_/:]+", p)} | set(" ()*<>=.'\"@?-+") | {"1", "5", "is", "null", "and"})
    matched = set()
    for _ in range(30000):
        text = "".join(rng.choice(words) + rng.choice(["", " ", "", "_"]) for _ in range(rng.randint(1, 9)))
        for p in patterns:
            if classify.required_text(p) not in text:
                assert not re.search(p, text), (p, text)
            else:
                matched.add(p)
    assert len(matched) > 100


def graph(spark, edges, nodes=None):
    names = nodes or sorted({x for e in edges for x in e})
    n = spark.createDataFrame([("g", x, i) for i, x in enumerate(names)], "g string, name string, ord int")
    return n, spark.createDataFrame([("g", a, b) for a, b in edges], "g string, source string, target string")


def test_cycles_keep_their_input_order(spark):
    n, e = graph(spark, [("b", "a"), ("a", "b")], ["b", "a"])
    out = lineage.dependency_order(n, e, "g", "ord").orderBy("level", "sort_key").collect()
    assert [r["name"] for r in out] == ["b", "a"] and all(r["cyclic"] and r["level"] is None for r in out)


def test_order_is_first_in_first_out(spark):
    """Against the queue algorithm it stands for, on random graphs without cycles."""
    rng = random.Random(3)
    names = [f"n{i}" for i in range(12)]
    rng.shuffle(names)
    edges = sorted({(names[a], names[b]) for a, b in (sorted(rng.sample(range(12), 2)) for _ in range(18))})
    listed = names[:]
    rng.shuffle(listed)
    indegree = {x: sum(1 for e in edges if e[1] == x) for x in listed}
    queue, want = sorted(x for x in listed if not indegree[x]), []
    while queue:
        cur = queue.pop(0)
        want.append(cur)
        for child in listed:
            if (cur, child) in edges:
                indegree[child] -= 1
                if not indegree[child]:
                    queue.append(child)
    n, e = graph(spark, edges, listed)
    out = lineage.dependency_order(n, e, "g", "ord").orderBy("level", "sort_key").collect()
    assert [r["name"] for r in out] == want


def test_paths_avoid_revisits(spark):
    n, e = graph(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("a", "fail_x"), ("c", "d")])
    got = {(tuple(r["path"]), r["fails"]) for r in lineage.execution_paths(n, e, "g").collect()}
    assert got == {(("a", "b", "c", "d"), False), (("a", "fail_x"), True)}


def test_deeply_nested_activities(spark):
    import json

    node = {"name": "leaf", "type": "Copy"}
    for i in range(60):
        node = {"name": f"n{i}", "type": "ForEach", "typeProperties": {"activities": [node, {"type": "Wait"}]}}
    df = spark.createDataFrame([(1, json.dumps([node, {"type": "End"}]))], "k int, a string")
    rows = lineage.activity_rows(df, "k", "a").orderBy("pos").collect()
    assert len(rows) == 122 and max(r["depth"] for r in rows) == 60 and rows[-1]["name"] == "End" and rows[-1]["depth"] == 0


def test_score_rounding(spark):
    from siltworks.operators.catalog import two_places

    values = [a / 40 for a in range(4, 41)] + [(1.0 + 0.5 + 0.9 + 0.7) / 4, (0.6 + 0.0 + 0.4 + 0.4) / 4]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", two_places(F.col("x")).alias("t")).collect():
        assert r["t"] == f"{r['x']:.2f}"


def test_keyed_rules_count_on_the_input(spark):
    """k keyed rules plan one scan of the table, two of its counted keys each, and one of each parent table."""
    li = table(spark, SF, "lineitem")
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    for k in range(1, 5):
        p = plan(dq.flag(li, [Rule(c, "INTEGER", "UNIQUE", "ERROR") for c in keys[:k]]))
        assert p.split("== Initial Plan ==")[-1].count("FileScan parquet") <= 2 * k + 1


def test_profiles_are_one_lazy_pass(spark):
    from siltworks.operators.profile import profile

    p = plan(profile(table(spark, SF, "lineitem"), "lineitem"))
    assert p.split("== Initial Plan ==")[-1].count("FileScan parquet") == 1


def test_no_word_is_required_of_uncertain_patterns():
    assert classify.required_text("ab{0,2}c") == classify.required_text("x(a(bc)?)?y") == ""
    assert classify.required_text("abc") == "abc"
    assert classify._lowered(r"A\S+B\D") == r"a\S+b\D"
