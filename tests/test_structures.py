"""Keys deep in JSON texts, SQL statements, and the order and structure of flows, on hand-written and random cases."""

import json
import random

from siltworks.functions import text as tx
from siltworks.operators import lineage


def _all_values(node, key):
    if isinstance(node, dict):
        for k, v in node.items():
            if k.lower() == key.lower():
                yield json.dumps(v, separators=(",", ":"), ensure_ascii=False)
            yield from _all_values(v, key)
    elif isinstance(node, list):
        for v in node:
            yield from _all_values(v, key)


def test_values_of_a_key_are_those_of_a_walk(spark):
    rng = random.Random(11)
    words = ["k", "K", "a", "x,", ":", '"k":', '{"k":1}', "\\", "k\\", "", "é", "\n", "null", "[", "}", "\\\"k\\\":2"]

    def node(depth):
        kind = rng.random()
        if depth < 5 and kind < 0.45:
            return {rng.choice(words): node(depth + 1) for _ in range(rng.randint(0, 4))}
        if depth < 5 and kind < 0.65:
            return [node(depth + 1) for _ in range(rng.randint(0, 4))]
        return rng.choice([1, -2.5, True, None, *words])

    texts = [json.dumps(node(0), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(400)]
    texts += ['{"k":{"k":{"K":[{"k":null},"}"]}}}', '{"k":1,"a":{"k":1}}', "", "no json", "{", '"k"', "null", "3", '["k",":"]', None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for key in ["k", ":", "x,", '"k":', "\\", "É"]:
        want = []
        for t in texts:
            try:
                want.append(list(_all_values(json.loads(t), key)))
            except (TypeError, ValueError):
                want.append(None)
        got = [r["v"] for r in df.select("i", tx.key_values(df["t"], key).alias("v")).orderBy("i").collect()]
        for t, g, w in zip(texts, got, want):
            assert g == w, (key, t)
    assert "Python" not in df.select(tx.key_values(df["t"], "k"))._jdf.queryExecution().toString()


def test_key_values_of_long_and_deep_texts(spark):
    long = json.dumps([{"a": "x" * 200, "k": i} for i in range(20000)])
    deep = '{"a":[' * 200 + '{"k":7}' + "]}" * 200
    got = spark.createDataFrame([(0, long), (1, deep)], "i int, t string")
    got = [r["v"] for r in got.select("i", tx.key_values(got["t"], "k").alias("v")).orderBy("i").collect()]
    assert got[0] == [str(i) for i in range(20000)] and got[1] == ["7"]


def test_a_long_chain_keeps_short_places_and_drops_what_is_settled(spark):
    names = [f"n{i}" for i in range(20)]
    nodes = spark.createDataFrame([("g", x, i) for i, x in enumerate(reversed(names))] + [("h", "b", 0), ("h", "a", 1), ("h", "free", 2)], "g string, name string, o int")
    edges = spark.createDataFrame(
        [("g", a, b) for a, b in zip(names, names[1:])] + [("g", "n0", "n15"), ("g", "gone", "n3"), ("h", "a", "b"), ("h", "b", "a")],
        "g string, source string, target string",
    )
    rows = lineage.dependency_order(nodes, edges, "g", "o").orderBy("g", "level", "sort_key").collect()
    assert [r["name"] for r in rows if r["g"] == "g"] == names and [r["level"] for r in rows if r["g"] == "g"] == list(range(20))
    assert [(r["name"], r["level"], r["sort_key"], r["cyclic"]) for r in rows if r["g"] == "h"] == [("b", None, 0, True), ("a", None, 1, True), ("free", None, 2, True)]


def test_order_of_no_nodes_is_empty(spark):
    nodes = spark.createDataFrame([], "g string, name string, o int")
    assert lineage.dependency_order(nodes, spark.createDataFrame([], "g string, source string, target string"), "g", "o").count() == 0


def _structures(spark, graphs):
    """The groups of graphs told to be equal; a graph is (nodes, edges), nodes being (name, type)."""
    nodes = spark.createDataFrame([(g, n, t) for g, (ns, _) in graphs.items() for n, t in ns], "g string, name string, type string")
    edges = spark.createDataFrame([(g, a, b) for g, (_, es) in graphs.items() for a, b in es], "g string, source string, target string")
    flow = nodes.select("g").distinct().selectExpr("g", "'' as flow")
    groups = {}
    for r in lineage.graph_signature(nodes, edges, "g", flow).collect():
        groups.setdefault(r["signature"], set()).add(r["g"])
    return {frozenset(v) for v in groups.values()}


def test_structures_are_told_apart_by_wiring(spark):
    def numbered(numbers, pairs):
        return [(f"Step_{n}", "Copy") for n in numbers], [(f"Step_{a}", f"Step_{b}") for a, b in pairs]

    path, star = [(1, 2), (2, 3), (3, 4)], [(1, 2), (1, 3), (1, 4)]
    graphs = {
        "path": numbered(range(1, 5), path), "renamed": numbered(range(11, 15), [(a + 10, b + 10) for a, b in reversed(path)]),
        "turned": numbered(range(1, 5), [(3, 1), (1, 4), (4, 2)]), "star": numbered(range(1, 5), star),
        "star in": numbered(range(1, 5), [(b, a) for a, b in star]), "loose": numbered(range(1, 5), []),
        "late fork": numbered(range(1, 7), [(1, 2), (2, 3), (3, 4), (3, 5), (5, 6)]), "early fork": numbered(range(1, 7), [(1, 2), (2, 3), (2, 4), (4, 5), (5, 6)]),
        "typed": ([("Step_1", "Copy"), ("Step_2", "Copy"), ("Step_3", "Wait"), ("Step_4", "Copy")], [(f"Step_{a}", f"Step_{b}") for a, b in path]),
        "outside": numbered(range(1, 4), path),
    }
    assert _structures(spark, graphs) == {frozenset({"path", "renamed", "turned"})} | {frozenset({g}) for g in graphs if g not in ("path", "renamed", "turned")}


def test_structures_of_a_thousand_equal_and_unequal_trees(spark):
    rng = random.Random(6)

    def tree(shape):
        numbers = rng.sample(range(100), len(shape) + 1)
        return [(f"n{i}", "Copy") for i in numbers], [(f"n{numbers[p]}", f"n{numbers[i + 1]}") for i, p in enumerate(shape)]

    def canonical(shape, node=0):
        return "(" + "".join(sorted(canonical(shape, i + 1) for i, p in enumerate(shape) if p == node)) + ")"

    shapes = {f"t{i}": [rng.randrange(k + 1) for k in range(rng.randint(1, 5))] for i in range(300)}
    want = {}
    for g, shape in shapes.items():
        want.setdefault(canonical(shape), set()).add(g)
    assert _structures(spark, {g: tree(s) for g, s in shapes.items()}) == {frozenset(v) for v in want.values()}


STATEMENTS = [
    ("select * from a", ["a"], ""),
    ("SELECT x FROM dbo.[My Table] WHERE x = 1 ORDER BY x", ["dbo.[My Table]"], "x = 1"),
    ("select 1 -- from hidden\nfrom shown", ["shown"], ""),
    ("select /* from hidden join other */ 1 from shown", ["shown"], ""),
    ("select 'from hidden' as t from shown where t <> 'it''s from hidden'", ["shown"], "t <> 'it''s from hidden'"),
    ('select "from" from "odd name"."t" join `b c` on 1 = 1', ['"odd name"."t"', "`b c`"], ""),
    ("select * from a, b as x, c y where a.i = b.i", ["a", "b", "c"], "a.i = b.i"),
    ("with c as (select * from base) select * from c join d using (i)", ["base", "d"], ""),
    ("with recursive c(n) as (select 1 union all select n + 1 from c), e as (select * from f) select * from e, c", ["f"], ""),
    ("select * from (select * from inner_t where y = 2) s where s.x > 3 group by 1", ["inner_t"], "s.x > 3"),
    ("select * from a where i in (select j from b where k = 1 order by j) and z = 2 limit 5", ["a", "b"], "i in (select j from b where k = 1 order by j) and z = 2"),
    ("select extract(year from d), trim(both ' ' from s), substring(s from 2) from t", ["t"], ""),
    ("select * from a where x is distinct from y", ["a"], "x is distinct from y"),
    ("select * from generate_series(1, 3) g, real_t", ["real_t"], ""),
    ("select * from (a join b on a.i = b.i) left join c on true", ["a", "b", "c"], ""),
    ("select * from a union all select * from b where q having z", ["a", "b"], "q"),
    ("delete from a where i < 5", ["a"], "i < 5"),
    ("select * from a cross join lateral (select * from b where b.i = a.i) l", ["a", "b"], ""),
    ("select f(a, b), c from t1, t2 where c in (1, 2, 3)", ["t1", "t2"], "c in (1, 2, 3)"),
    ("select * from a; select * from b where 1 = 2; select 3", ["a", "b"], "1 = 2"),
    ("select * from a with (nolock) join b with (nolock) on a.i = b.i where x", ["a", "b"], "x"),
    ("select where_clause, from_date from orders_from where from_date > 1", ["orders_from"], "from_date > 1"),
    ("select *\nfrom\n  a -- the first\nwhere x = 1 -- y = 2\n  and z = 3", ["a"], "x = 1 and z = 3"),
    ("select (select max(i) from b) m from a", ["b", "a"], ""),
    ("select * from only a tablesample (10 percent)", ["a"], ""),
    ("insert into t select * from s where k", ["s"], "k"),
    ("select * from a join b on a.x = b.x join c on b.y = c.y and c.z = '-- no comment' where w", ["a", "b", "c"], "w"),
    ("select 1", [], ""),
    ("select * from 's3://x/from y'", [], ""),
    ("select case when exists (select 1 from e where e.i = a.i) then 1 end from a where (((x)))", ["e", "a"], "(((x)))"),
    ("with a as (select * from src.a) select * from a where 'unfinished", ["src.a"], "'unfinished"),
    ("", [], ""),
    (")) from )( x", [], ""),
]


def test_statements_are_read_by_their_tokens(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(STATEMENTS)] + [(len(STATEMENTS), None)], "i int, s string")
    out = df.select("i", tx.sql_scan(df["s"]).alias("r"))
    got = {r["i"]: r["r"] for r in out.collect()}
    for i, (s, tables, condition) in enumerate(STATEMENTS):
        assert (got[i]["tables"], got[i]["filter"]) == (tables, condition), s
    assert got[len(STATEMENTS)] is None
    assert "Python" not in out._jdf.queryExecution().toString()


def test_a_long_statement_is_read_in_time(spark):
    s = "select * from a where i in (" + ", ".join(map(str, range(20000))) + ") and j = 'x'"
    df = spark.createDataFrame([(s,)], "s string")
    r = df.select(tx.sql_scan(df["s"]).alias("r")).first()["r"]
    assert r["tables"] == ["a"] and r["filter"].endswith("and j = 'x'")


def test_no_colour_is_broadcast(spark):
    # Spark takes the rows that an explode makes for no more bytes than the file below has
    steps = spark.range(100).selectExpr("id as k", "explode(sequence(1, 4)) as i")
    e = steps.selectExpr("k", "concat('s', i) as source", "concat('s', i + 1) as target")
    n = e.selectExpr("k", "source as name").union(e.selectExpr("k", "target")).distinct().selectExpr("k", "name", "'Copy' as type")
    signed = lineage.graph_signature(n, e, "k", spark.range(100).selectExpr("id as k", "'copies' as flow"))
    assert "Broadcast" not in signed._jdf.queryExecution().executedPlan().toString()
    assert signed.select("signature").distinct().count() == 1 and signed.count() == 100


def test_long_flows_are_told_apart_in_a_few_jobs(spark):
    # a path of 40 steps takes 20 rounds until all of its steps are told apart
    paths = {f"p{i}": ([(f"n{k}", "Copy") for k in range(n)], [(f"n{k}", f"n{k + 1}") for k in range(n - 1)]) for i, n in enumerate([40, 40, 41])}
    spark.sparkContext.setJobGroup("long flows", "")
    try:
        assert _structures(spark, paths) == {frozenset({"p0", "p1"}), frozenset({"p2"})}
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("long flows")) <= 12
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_graphs_taken_whole_are_equal_where_tables_of_them_are(spark, monkeypatch):
    """Names and types with nulls, capitals, blanks and line breaks, nodes and edges that come twice, ends that are no nodes, keys that are null."""
    rng = random.Random(4)
    names, kinds = ["a_1", "a_2", "A", " a1", "b\n", "B7\r\n", "é٣", None], ["x", "X ", None, ""]
    nodes, edges, flows = [], [], []
    for g in [None, *range(250)]:
        some = rng.sample(names, rng.randint(0, 3))
        nodes += [(g, n, rng.choice(kinds)) for n in [*some, *some[: rng.randint(0, 1)]]]
        edges += [(g, rng.choice(names), rng.choice(names)) for _ in range(rng.choice([0, 1, 1, 2, 3]))]
        flows += [(g, rng.choice(["f", "F "]))] if rng.random() < 0.9 else []
    frames = [spark.createDataFrame(nodes, "g long, name string, type string"), spark.createDataFrame(edges, "g long, source string, target string")]
    flows = spark.createDataFrame(flows + flows[:2], "g long, flow string")

    def groups():
        out = {}
        for r in lineage.graph_signature(*frames, "g", flows).collect():
            out.setdefault(r["signature"], []).append(str(r["g"]))
        return sorted(sorted(x) for x in out.values())

    taken = {}
    for large in (lineage.LARGE, 0, 5):
        monkeypatch.setattr(lineage, "LARGE", large)
        taken[large] = groups()
    assert taken[0] == taken[5] == taken[100_000] and 20 < len(taken[0]) < 240
    monkeypatch.setattr(lineage, "BUCKET_ROWS", 10)
    assert groups() == taken[0]


def test_activities_leave_in_small_batches(spark, monkeypatch):
    def definition(i):
        inner = [{"name": f"c{i}_{k}", "type": "Copy", "dependsOn": [{"activity": "prep"}]} for k in range(i % 4)]
        return json.dumps([{"name": f"a{i}", "type": "ForEach", "typeProperties": {"activities": inner}}, {"name": f"z{i}"}])

    rows = [(i, definition(i)) for i in range(300)] + [(300, None), (301, "[{"), (None, definition(2))]
    df = spark.createDataFrame(rows, "k long, text string")
    whole = sorted(lineage.activity_rows(df, "k", "text").collect(), key=str)
    monkeypatch.setattr(lineage, "OUT_CHARS", 500)
    cut = lineage.activity_rows(df, "k", "text")
    assert sorted(cut.collect(), key=str) == whole and len(whole) == 600 + 75 * 6 + 4
    one = cut.where("k = 3").orderBy("pos").collect()
    assert [(r.pos, r.name, r.parent, r.branch) for r in one] == [(0, "a3", None, None), *[(i + 1, f"c3_{i}", "a3", "ForEach") for i in range(3)], (4, "z3", None, None)]
    assert one[1].depends_on[0].activity == "prep" and one[1].depends_on[0].dependencyConditions == ["Succeeded"]


def test_a_statement_is_cut_into_tokens_once(spark):
    df = spark.range(1).selectExpr("concat('select * from t', id) as s")
    assert tx.sql_reading(df, "s")._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
