"""Profiles kept per batch, merged, against profiles of the whole table."""

import random

from pyspark.sql import functions as F

from siltworks.operators import profile as prof
from siltworks.plans.scratch import scratch_path

SHOWN = ["column_name", "data_type", "nullable", "ordinal", "row_count", "null_count"]


def _rows(df):
    return sorted(tuple(r) for r in df.select(*SHOWN).collect())


def test_merged_batches_are_the_profile_of_the_whole(spark):
    n = 30000
    whole = spark.range(n).select(
        F.col("id").alias("row_id"), (F.col("id") % 29000).alias("near_key"), F.when(F.col("id") != 7, F.col("id")).alias("gap_id"),
        F.concat(F.lit("x" * 80), F.col("id")).alias("text_code"), F.col("id").alias("amount"), F.lit(None).cast("string").alias("no_key"),
    )
    path = scratch_path(spark, "sketches")
    for b in range(5):
        prof.keep_sketches(whole.where(F.pmod(F.hash("row_id"), F.lit(5)) == b), "d", f"b{b}", path)
    prof.keep_sketches(whole.where(F.pmod(F.hash("row_id"), F.lit(5)) == 2), "d", "b2", path)  # the same batch again
    prof.keep_sketches(whole.limit(0), "d", "none", path)
    merged = prof.merged_profile(prof.kept_sketches(spark, path)).cache()
    assert _rows(merged) == _rows(prof.profile(whole, "d"))
    open_ = sorted(r["column_name"] for r in merged.where("key_candidate").collect())
    assert open_ == ["row_id", "text_code"]
    want = sorted(r["column_name"] for r in prof.profile(whole, "d").where("key_candidate").collect())
    assert sorted(r["column_name"] for r in prof.exact_keys(whole, open_).collect()) == want
    for r in merged.where("distinct_estimate is not null").collect():
        true = {"row_id": n, "near_key": 29000, "gap_id": n - 1, "text_code": n, "no_key": 0}[r["column_name"]]
        assert abs(r["distinct_estimate"] - true) <= prof.SKETCH_ERROR * true
    assert max(len(r[0]) for r in prof.kept_sketches(spark, path).select("sketch").where("sketch is not null").collect()) < 70000


def test_a_near_key_is_left_to_the_exact_check(spark):
    rng = random.Random(1)
    ids = [*range(5000), rng.randrange(5000)]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "k_id int, other_id string")
    merged = prof.merged_profile(prof.batch_sketches(df, "d", "b"))
    assert {r["column_name"] for r in merged.where("key_candidate").collect()} == {"k_id", "other_id"}
    assert prof.exact_keys(df, ["k_id", "other_id"]).count() == 0 and prof.exact_keys(df.distinct(), ["k_id"]).count() == 1
    assert prof.exact_keys(df, []).count() == 0 and prof.exact_keys(df.limit(0), ["k_id"]).count() == 0


def test_columns_that_come_go_and_change(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a_id int, old string")
    b = spark.createDataFrame([("3", 1.5)], "a_id string, new double")
    merged = prof.merged_profile(prof.batch_sketches(a, "d", "1").unionByName(prof.batch_sketches(b, "d", "2")))
    assert _rows(merged) == [("a_id", "STRING", False, 1, 3, 0), ("new", "FLOAT", True, 2, 3, 2), ("old", "STRING", True, 2, 3, 1)]
