"""Numbers of ways against lists of them, and announcements of objects through a stream that restarts."""

import datetime
import random
from collections import Counter

from siltworks.operators import lineage
from siltworks.operators.literals import literal_table
from siltworks.plans.scratch import scratch_path
from siltworks.streaming.arrivals import ANNOUNCED, NEWEST, ingest_new_versions, new_versions

NODES, EDGES = "g string, name string", "g string, source string, target string"


def _counts(spark, nodes, edges):
    got = lineage.path_counts(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), "g").collect()
    return {(r["g"], r["root"], r["end"], r["fails"]): int(r["paths"]) for r in got}


def test_counts_are_those_of_the_listed_ways(spark):
    rng = random.Random(4)
    nodes, edges = [], []
    for g in range(6):
        names = [f"{rng.choice(['a', 'fail_', 'B'])}{i}" for i in range(8)]
        nodes += [(str(g), n) for n in names]
        edges += [(str(g), names[a], names[b]) for a in range(8) for b in range(a + 1, 8) if rng.random() < 0.4]
    edges += edges[:5]
    listed = lineage.execution_paths(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), "g").collect()
    want = Counter((r["g"], r["path"][0], r["path"][-1], r["fails"]) for r in listed)
    assert _counts(spark, nodes, edges) == want


def test_a_cycle_is_one_node_under_its_least_name(spark):
    edges = [("x", s, t) for s, t in ("ra", "ab", "bc", "ca", "ad", "cd", "de", "rd")] + [("y", "p", "p"), ("y", "p", "q")] + [("z", "fail1", "m"), ("z", "m", "fail1")]
    nodes = [(g, n) for g, names in (("x", "rabcde"), ("y", "pq")) for n in names] + [("z", "m"), ("z", "fail1"), ("z", "alone")]
    want = {("x", "r", "e", False): 2, ("y", "p", "q", False): 1, ("z", "fail1", "fail1", True): 1, ("z", "alone", "alone", False): 1}
    assert _counts(spark, nodes, edges) == want


def test_a_ladder_of_many_ways_is_counted(spark):
    steps = 20
    edges = [("l", f"n{i}", f"{side}{i}") for i in range(steps) for side in ("u", "fail")] + [("l", f"{side}{i}", f"n{i + 1}") for i in range(steps) for side in ("u", "fail")]
    nodes = [("l", n) for n in sorted({x for e in edges for x in e[1:]})]
    assert _counts(spark, nodes, edges) == {("l", "n0", f"n{steps}", False): 1, ("l", "n0", f"n{steps}", True): 2**steps - 1}


def test_no_graph_no_ways(spark):
    assert _counts(spark, [], []) == {}


def _at(hour):
    return datetime.datetime(2024, 1, 2, hour)


def test_versions_are_ingested_once_across_a_restart(spark):
    root = scratch_path(spark, "announced")
    runs = [
        [("a", "1", _at(5), 1), ("a", "1", _at(5), 1), ("b", "1", _at(5), 2), (None, None, None, 3), ("c", "1", _at(9), 4)],
        [("a", "1", _at(6), 1), ("a", "2", _at(7), 5), ("b", "0", _at(4), 2), ("c", "2", _at(8), 6), (None, None, None, 3), ("d", "x", _at(1), 7), ("a", "2", _at(7), 5)],
        [],
        [("a", "1", _at(8), 8)],
    ]
    got = []
    for rows in runs:
        if rows:
            spark.createDataFrame(rows, ANNOUNCED).write.mode("append").parquet(f"{root}/in")
        ingest_new_versions(spark.readStream.schema(ANNOUNCED).parquet(f"{root}/in"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
        got.append(sorted(((r["path"] or ""), r["etag"], r["size"]) for r in spark.read.parquet(f"{root}/out").collect()))
    first = [("", "", 3), ("a", "1", 1), ("b", "1", 2), ("c", "1", 4)]
    second = sorted([*first, ("a", "2", 5), ("d", "x", 7)])
    assert got == [first, second, second, sorted([*second, ("a", "1", 8)])]


def test_versions_of_many_objects_are_those_of_a_walk(spark):
    rng = random.Random(5)
    newest, known, want, got = literal_table(spark, [], NEWEST), {}, [], []
    for now in (0, 10, 20, 25):
        rows = [(rng.choice(["a", "b", "c", "d", None]), rng.choice(["1", "2", None]), rng.choice([_at(h) for h in range(6)] + [None]), rng.choice([1, 2, None])) for _ in range(9)]
        best = {}
        for path, etag, modified, size in rows:
            at = (path, modified is not None, modified or _at(0))
            best[at] = max(best.get(at, ("", False, 0)), (etag or "", size is not None, size or 0))
        for (path, *at), (etag, has, size) in sorted(best.items(), key=lambda x: x[0][1:]):
            last = known.get(path)
            if last is None or (at > last[0] and etag != last[1]):
                want.append((now, path, etag, at[1] if at[0] else None, size if has else None))
            if last is None or at > last[0]:
                known[path] = (at, etag, now)
            known[path] = (*known[path][:2], now)
        known = {p: x for p, x in known.items() if x[2] + 10 >= now}
        passed, after = new_versions(spark.createDataFrame(rows, ANNOUNCED), newest, now, 10)
        got += [(now, *r) for r in passed.collect()]
        newest = after.localCheckpoint()
        assert sorted((str(r.path), r.etag, r.arrived) for r in newest.collect()) == sorted((str(p), x[1], x[2]) for p, x in known.items())
        assert "Python" not in passed._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(got, key=str) == sorted(want, key=str)
