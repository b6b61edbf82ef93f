"""Layer runs and streams in temporary folders."""

import pytest
from pyspark.sql import functions as F

from siltworks.functions.rules import Rule
from siltworks.operators import runs
from siltworks.operators.upsert import upsert
from siltworks.plans.layers import Dataset, LayerStore, run_batch, run_dataset
from siltworks.plans.scratch import scratch_path
from siltworks.streaming.arrivals import file_stream, ingest_arrivals, with_retries

RULES = [Rule("v", "INTEGER", "NOT_NULL", "ERROR"), Rule("k", "STRING", "NOT_NULL", "WARN")]
SALES = Dataset("sales", "acme", "sales", "INCREMENTAL", "k", "wm", "p")


@pytest.fixture
def store(spark):
    return LayerStore(spark, scratch_path(spark, "test-lake"))


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v string, wm int, p string")


def silver(store):
    return {r["k"]: (r["v"], r["p"]) for r in store.silver(SALES).collect()}


def test_two_runs_merge_by_key(spark, store):
    first = frame(spark, [("a", "1", 1, "01"), ("b", "2", 1, None), ("c", "bad", 1, "02")])
    m = run_dataset(store, SALES, [first], RULES, "b1", "t1")
    assert (m["raw_rows"], m["silver_rows"], m["gold_rows"], m["dq_violations"]) == (3, 2, 2, 2)  # cast failure and null
    assert silver(store) == {"a": (1, "01"), "b": (2, None)}
    second = frame(spark, [("a", "9", 2, "01"), ("d", "4", 2, "x/y")])
    m = run_dataset(store, SALES, [second], RULES, "b2", "t2")
    assert m["silver_rows"] == 3 and m["gold_rows"] == 2
    assert silver(store) == {"a": (9, "01"), "b": (2, None), "d": (4, "x/y")}
    assert spark.read.parquet(f"{store.root}/Rejected/acme/sales/batch=b1").select("k", "_dq_failed").collect() == [("c", ["CAST_FAIL", "NOT_NULL"])]


def test_a_repeated_run_changes_nothing(spark, store):
    run_dataset(store, SALES, [frame(spark, [("a", "1", 1, "x")])], RULES, "b1", "t1")
    for _ in range(2):
        run_dataset(store, SALES, [frame(spark, [("a", "2", 2, "x"), ("b", "3", 2, "y")])], RULES, "b2", "t2")
        assert silver(store) == {"a": (2, "x"), "b": (3, "y")}
    assert store.run_history().count() == 2 and store.versions().count() == 2


def test_an_older_batch_run_again_loses_against_later_ones(spark, store):
    for batch, value in (("b1", "1"), ("b2", "2"), ("b1", "5")):
        run_dataset(store, SALES, [frame(spark, [("a", value, int(value), "x"), (batch, value, 1, "x")])], RULES, batch, "t")
    assert silver(store) == {"a": (2, "x"), "b1": (5, "x"), "b2": (2, "x")} or silver(store)["a"] == (2, "x")


def test_a_reader_keeps_its_snapshot_during_a_rerun(spark, store):
    run_dataset(store, SALES, [frame(spark, [("a", "1", 1, "x")])], RULES, "b1", "t1")
    reading = store.silver(SALES)
    run_dataset(store, SALES, [frame(spark, [("a", "2", 2, "x")])], RULES, "b1", "t1")
    assert [r["v"] for r in reading.collect()] == [1] and silver(store) == {"a": (2, "x")}


def test_no_clean_rows_skips_gold(spark, store):
    m = run_dataset(store, SALES, [frame(spark, [("a", None, 1, "x")])], RULES, "b1", "t1")
    assert m["gold_status"] == "SKIPPED" and m["silver_rows"] == 0 and store.silver(SALES) is None


def test_newer_only_uses_the_stored_watermark(spark, store):
    ds = Dataset("s", "acme", "s", "FULL", None, "wm")
    rows = [("a", "1", 1, "x"), ("b", "2", 2, "x")]
    assert run_dataset(store, ds, [frame(spark, rows)], RULES, "b1", "t1", newer_only=True)["raw_rows"] == 2
    for batch, wm in (("b2", 9), ("b3", 10), ("b4", 11), ("b4", 11)):  # the last run is repeated
        rows.append((batch, "3", wm, "x"))
        rows = sorted(set(rows))
        assert run_dataset(store, ds, [frame(spark, rows)], RULES, batch, "t2", newer_only=True)["raw_rows"] == 2  # the stored watermark comes again


def test_a_failing_dataset_does_not_stop_the_batch(spark, store):
    bad = Dataset("bad", "acme", "bad")
    jobs = [
        {"dataset": bad, "frames": [], "rules": []},
        {"dataset": SALES, "frames": [frame(spark, [("a", "1", 1, "x")])], "rules": RULES},
    ]
    assert [r["status"] for r in run_batch(store, jobs, "b1", "t1")] == ["FAILURE", "SUCCESS"]
    report = runs.batch_rollup(store.run_history()).first()
    assert (report["status"], report["total"], report["rows_written"]) == ("PARTIAL", 2, 1)
    path = f"{store.root}/report"
    runs.write_report(store.run_history(), path)
    rows = spark.read.csv(path, header=True).orderBy("status").collect()
    assert len(rows[0]) == 15 and [r["status"] for r in rows] == ["FAILURE", "SUCCESS"] and rows[1]["gold_rows"] == "1"


def test_upsert_null_watermark_and_first_load(spark):
    old = spark.createDataFrame([(1, 0), (3, 0)], "k int, wm int")
    new = spark.createDataFrame([(1, 5), (1, None), (2, 3), (2, 1)], "k int, wm int")
    wins = {r["k"]: r["wm"] for r in upsert(old, new, ["k"], "wm").collect()}
    assert wins == {1: None, 2: 3, 3: 0}
    loses = {r["k"]: r["wm"] for r in upsert(None, new, ["k"], "wm", null_watermark="loses").collect()}
    assert loses == {1: 5, 2: 3}
    once = upsert(old, new, ["k"], "wm")
    assert {r["k"]: r["wm"] for r in upsert(once, new, ["k"], "wm").collect()} == wins


def test_stream_picks_up_later_files_once(spark, store):
    src, ckpt = scratch_path(spark, "src"), scratch_path(spark, "ckpt")
    frame(spark, [("a", "1", 1, "x")]).coalesce(1).write.parquet(src)

    def drain():
        stream = file_stream(spark, src, "k string, v string, wm int, p string", files_per_batch=1)
        ingest_arrivals(stream, store, SALES, RULES, "b", "t", ckpt, delay=0.0).awaitTermination()

    drain()
    frame(spark, [("a", "5", 2, "x"), ("b", "2", 2, "x")]).coalesce(1).write.mode("append").parquet(src)
    drain()
    drain()
    assert silver(store) == {"a": (5, "x"), "b": (2, "x")}
    assert store.run_history().agg(F.sum("raw_rows")).first()[0] == 3


def test_retries_then_gives_up():
    calls = []

    def fails(batch, epoch):
        calls.append(epoch)
        if len(calls) < 3:
            raise RuntimeError("no")

    with_retries(fails, delay=0.0)(None, 7)
    assert calls == [7, 7, 7]
    with pytest.raises(RuntimeError):
        with_retries(lambda b, e: fails(calls.clear(), e), retries=2, delay=0.0)(None, 1)
