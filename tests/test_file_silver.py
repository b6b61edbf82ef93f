"""Merges by files against merges of the whole table."""

import json
import random

import pytest
from pyspark.sql import functions as F

from siltworks.operators.upsert import upsert
from siltworks.plans.file_silver import FileSilver
from siltworks.plans.scratch import scratch_path

SCHEMA = "k string, part int, at long, v long"


def _rows(df):
    return sorted((tuple(r) for r in df.select("k", "part", "at", "v").collect()), key=str)


def _batch(spark, rng, n, keys):
    rows = [(rng.choice([None, *keys]), rng.randrange(3), rng.choice([None, rng.randrange(9)]), rng.randrange(10**6)) for _ in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_batches_merge_as_into_the_whole_table(spark):
    rng = random.Random(1)
    silver = FileSilver(spark, scratch_path(spark, "fs"), ["k", "part"], "at", ("v",), rows_a_file=20)
    want = None
    for n, keys in ((300, [f"a{i:03d}" for i in range(200)]), (30, [f"a{i:03d}" for i in range(10)]), (20, ["zz", "a150", "0"]), (1, ["new"])):
        batch = _batch(spark, rng, n, keys)
        want = spark.createDataFrame(upsert(want, batch, ["k", "part"], "at", ("v",)).collect(), SCHEMA)
        done = silver.merge(batch, f"b{n}")
        assert _rows(silver.read()) == _rows(want)
        assert done["rows"] == want.count()


def test_a_small_batch_rewrites_few_files_and_old_snapshots_stay(spark):
    silver = FileSilver(spark, scratch_path(spark, "fs"), ["id"], rows_a_file=100)
    silver.merge(spark.range(20_000).selectExpr("id", "0 as v"), "all")
    first = {r["file"] for r in silver.manifest().collect()}
    done = silver.merge(spark.range(7_000, 7_020).selectExpr("id", "1 as v"), "few")
    second = {r["file"] for r in silver.manifest().collect()}
    assert done["replaced"] <= 2 and done["written"] * 20 < done["files"] and len(first & second) == len(first) - done["replaced"]
    assert silver.read(1).where("v = 1").count() == 0 and silver.read(2).where("v = 1").count() == 20 and silver.read(2).count() == 20_000


def test_keys_no_file_holds_rewrite_nothing(spark):
    silver = FileSilver(spark, scratch_path(spark, "fs"), ["id"], rows_a_file=500)
    silver.merge(spark.range(0, 20_000, 2).selectExpr("id", "0 as v"), "even")
    done = silver.merge(spark.createDataFrame([(5_001, 1), (50_000, 1), (-3, 1)], "id long, v int"), "between")
    assert done["replaced"] <= 1 and done["rows"] == 10_003  # a filter may be wrong once in a few hundred keys
    assert silver.read().where("v = 1").count() == 3


def test_a_lost_attempt_leaves_the_version_before(spark, monkeypatch):
    silver = FileSilver(spark, scratch_path(spark, "fs"), ["id"], rows_a_file=100)
    silver.merge(spark.range(1_000).selectExpr("id", "0 as v"), "all")
    monkeypatch.setattr(FileSilver, "_filters", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        silver.merge(spark.range(1_000).selectExpr("id", "1 as v"), "lost")
    monkeypatch.undo()
    assert silver.version()["version"] == 1 and silver.read().where("v = 0").count() == 1_000
    silver.merge(spark.range(500).selectExpr("id", "1 as v"), "again")
    assert silver.read().groupBy("v").count().orderBy("v").collect() == [(0, 500), (1, 500)]


def test_an_empty_first_load(spark):
    silver = FileSilver(spark, scratch_path(spark, "fs"), ["id"])
    assert silver.read() is None
    silver.merge(spark.range(0).selectExpr("id", "0 as v"), "none")
    silver.merge(spark.range(5).selectExpr("id", "0 as v"), "some")
    assert silver.read().count() == 5


def test_a_batch_that_runs_again_replaces_its_own_and_stays_below_later_ones(spark):
    silver = FileSilver(spark, scratch_path(spark, "fs"), ["id"], rows_a_file=50)

    def merge(batch, value, *spans):
        rows = [(i, value) for a, b in spans for i in range(a, b)]
        silver.merge(spark.createDataFrame(rows, "id long, v string"), batch)
        return {r["v"]: r["count"] for r in silver.read().groupBy("v").count().collect()}

    assert merge("one", "a", (0, 1000)) == {"a": 1000}
    assert merge("two", "b", (0, 100), (2000, 2100)) == {"a": 900, "b": 200}
    assert merge("two", "b2", (0, 50)) == {"a": 950, "b2": 50}  # what the first attempt added is gone
    assert merge("three", "c", (40, 60)) == {"a": 940, "b2": 40, "c": 20}
    assert merge("two", "b3", (30, 70), (3000, 3001)) == {"a": 940, "b2": 40, "c": 20, "b3": 1}  # rows of a later version win
    assert silver.read(2).count() == 1100
    assert merge("one", "a", (0, 10)) == {"a": 940, "b2": 40, "c": 20, "b3": 1}


def test_the_layered_run_keeps_silver_by_files(spark):
    from siltworks.functions.rules import Rule
    from siltworks.plans.layers import Dataset, LayerStore, run_dataset

    store = LayerStore(spark, scratch_path(spark, "lake"))
    d = Dataset("d", "c", "sales", "INCREMENTAL", "k", "at", rows_a_file=100)
    rules = [Rule("v", "INTEGER", "RANGE", "ERROR", "0:")]
    assert store.silver(d) is None
    all_ = spark.range(10_000).selectExpr("id as k", "id as v", "1 as at")
    run = run_dataset(store, d, [all_], rules, "b1", "2024-01-01T00:00:00", gold_from="silver")
    assert run["silver_rows"] == run["gold_rows"] == 10_000
    few = spark.createDataFrame([(5, -1, 2), (6, 60, 2), (6, 61, 3), (20_000, 1, 2)], "k long, v long, at int").withColumn("note", F.lit("n"))
    run = run_dataset(store, d, [few], rules, "b2", "2024-01-02T00:00:00", gold_from="silver")
    assert run["silver_rows"] == run["gold_rows"] == 10_001 and run["silver_path"] == store.file_silver(d).path
    got = {r["k"]: (r["v"], r["note"]) for r in store.silver(d).where("k in (5, 6, 7, 20000)").collect()}
    assert got == {5: (5, None), 6: (61, "n"), 7: (7, None), 20_000: (1, "n")}
    top = store.file_silver(d).version()
    assert top["written"] * 20 <= top["files"] and store.silver(d, before_batch="b2").count() == 10_000


def test_filters_are_built_of_numbers_and_hold_every_key(spark):
    silver = FileSilver(spark, scratch_path(spark, "filters"), ["a", "b"], rows_a_file=3000)
    rows = spark.range(20_000).selectExpr("id * 3 as a", "cast(id % 7 as string) as b")
    silver.merge(rows, "first")
    listed = silver.manifest().cache()
    data = listed.first()["file"].split("/_slot=")[0]
    built = silver._filters(data, rows.schema, listed)
    plan = built._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if " Sort [" in line]
    assert sorts and not any("[file" in line for line in sorts)  # no row of a sort has a file's name
    assert built.count() == listed.agg(F.sum("pages")).first()[0]
    keys = rows.withColumn("_slot", silver._slot(json.loads(silver.version()["bounds"])))
    held = silver._touched(keys, listed, list(silver.version()["filters"]))
    assert held.count() == listed.count() > 3
    absent = keys.where("a < 300").withColumn("a", F.col("a") + 1)
    assert silver._touched(absent, listed, list(silver.version()["filters"])).count() <= 1
