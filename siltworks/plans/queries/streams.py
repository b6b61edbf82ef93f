"""File streams over the given tables, run until everything that has arrived is done."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.functions.rules import Rule
from siltworks.plans.layers import Dataset, LayerStore, run_dataset
from siltworks.plans.registry import query, table
from siltworks.plans.scratch import scratch_path
from siltworks.streaming.arrivals import ANNOUNCED, file_stream, ingest_arrivals, ingest_new_versions, log_arrivals, with_retries

EVENT_RULES = [
    Rule("event_id", "INTEGER", "UNIQUE", "BLOCK"),
    Rule("value", "FLOAT", "RANGE", "ERROR", ":100"),
    Rule("event_type", "STRING", "CUSTOM", "WARN", "ALLOWED_VALUES=click,view,purchase"),
]
EVENTS = Dataset("events", "web", "events", "INCREMENTAL", "user_id", "ts", "event_type", ("event_id",))


@query(
    "stream_ingest",
    sql="""
    select user_id, event_id, event_type from (
      select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events where value <= 100) where rn = 1""",
)
def stream_ingest(spark, sf):
    """The events arrive as files; silver keeps each user's last good one."""
    root = scratch_path(spark, "stream")
    store = LayerStore(spark, f"{root}/lake")
    stream = file_stream(spark, sf, table(spark, sf, "events").schema, glob="events.parquet")
    done = ingest_arrivals(stream, store, EVENTS, EVENT_RULES, "B", "2024-01-02T03:04:05", f"{root}/checkpoint", delay=0.0)
    done.awaitTermination()
    return store.silver(EVENTS).select("user_id", "event_id", "event_type")


@query(
    "stream_arrival_log",
    sql="""
    select source, 'PASS' as validation_status, 'B000000' as batch_id, count(distinct doc_id // 10000) as files from documents group by source""",
)
def stream_arrival_log(spark, sf):
    """Landing checks of files as they arrive, one file for each source and block of the documents."""
    from siltworks.plans.queries.sources import source_files

    root = scratch_path(spark, "arrivals")
    log_arrivals(spark, source_files(spark, sf), f"{root}/log", "web", "B", "2024-01-02T03:04:05", f"{root}/checkpoint", "*.csv").awaitTermination()
    log = spark.read.parquet(f"{root}/log").withColumn("source", F.regexp_extract("source_path", "/source=([^/]*)/", 1))
    return log.groupBy("source", "validation_status", "batch_id").agg(F.count(F.lit(1)).alias("files"))


@query(
    "layer_run",
    sql="""
    with ok as (select * from orders where o_totalprice between 1000 and 400000)
    select 'first' as run, count(*) as raw_rows, count(*) filter (where not o_totalprice between 1000 and 400000) as dq_violations,
      count(*) filter (where o_orderpriority not in ('1-URGENT', '2-HIGH')) as dq_warnings,
      (select count(distinct o_custkey) from ok where o_orderstatus <> 'P') as silver_rows,
      count(*) filter (where o_totalprice between 1000 and 400000) as gold_rows, 'PASSED' as gold_status from orders where o_orderstatus <> 'P'
    union all select 'second', count(*), count(*) filter (where not o_totalprice between 1000 and 400000),
      count(*) filter (where o_orderpriority not in ('1-URGENT', '2-HIGH')), (select count(distinct o_custkey) from ok),
      count(*) filter (where o_totalprice between 1000 and 400000), 'PASSED' from orders where o_orderstatus = 'P'""",
)
def layer_run(spark, sf):
    """Two written runs of the orders: the settled ones, then the pending ones merged into the first run's silver."""
    from siltworks.plans.queries.layers import ORDER_RULES, ORDERS

    store = LayerStore(spark, scratch_path(spark, "lake"))
    orders = table(spark, sf, "orders")
    run_dataset(store, ORDERS, [orders.where("o_orderstatus <> 'P'")], ORDER_RULES, "first", "2024-01-02T03:04:05")
    run_dataset(store, ORDERS, [orders.where("o_orderstatus = 'P'")], ORDER_RULES, "second", "2024-01-03T03:04:05")
    return store.run_history().select(
        F.col("batch_id").alias("run"), "raw_rows", "dq_violations", "dq_warnings", "silver_rows", "gold_rows", "gold_status"
    )


@query(
    "stream_object_versions",
    sql="""
    select 'obj/' || event_id as path, event_type as etag, ts as modified, user_id as size, 0 as run from events
    union all select 'obj/' || event_id, 'r-' || event_type, ts + interval 1 hour, user_id, 1 from events where event_type = 'purchase'
    union all select 'late/' || event_id, event_type, ts - interval 300 day, user_id, 1 from events where event_type = 'view'""",
)
def stream_object_versions(spark, sf):
    """Announcements of objects in two runs of one stream.  The second, after a restart, brings all objects again, replaces
    some, announces old versions of others late, and first announces some that are far older than anything before."""
    root = scratch_path(spark, "versions")
    seen = table(spark, sf, "events").selectExpr("'obj/' || event_id as path", "event_type as etag", "cast(ts as timestamp) as modified", "user_id as size")
    announced = lambda df: df.select("path", "etag", "modified", "size").write.mode("append").parquet(f"{root}/in")
    run = lambda: ingest_new_versions(spark.readStream.schema(ANNOUNCED).parquet(f"{root}/in"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    announced(seen.unionByName(seen.where("etag = 'click'")))
    run()
    replaced = seen.where("etag = 'purchase'").selectExpr("path", "'r-' || etag as etag", "modified + interval 1 hour as modified", "size")
    stale = seen.where("etag = 'click'").selectExpr("path", "'old' as etag", "modified - interval 1 hour as modified", "size")
    far = seen.where("etag = 'view'").selectExpr("replace(path, 'obj/', 'late/') as path", "etag", "modified - interval 300 day as modified", "size")
    for df in (seen, replaced, replaced, stale, far):
        announced(df)
    run()
    # a run of the stream is one epoch or more
    out = spark.read.parquet(f"{root}/out")
    first = spark.read.parquet(f"{root}/out").where("path like 'obj/%' and etag not like 'r-%'").agg(F.max("epoch")).first()[0]
    return out.select("path", "etag", F.col("modified").cast("timestamp_ntz").alias("modified"), "size", (F.col("epoch") > first).cast("int").alias("run"))


@query(
    "stream_retried_batches",
    sql="select event_type, count(*) as rows, round(sum(value), 3) as total from events group by event_type",
)
def stream_retried_batches(spark, sf):
    """Every micro-batch of the events fails after it has written and is tried again: each event is in the output once."""
    root = scratch_path(spark, "retries")
    table(spark, sf, "events").repartition(4, "event_id").write.parquet(f"{root}/in")
    failed = set()

    def land(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")
        if epoch not in failed:
            failed.add(epoch)
            raise OSError("the store is away")

    stream = file_stream(spark, f"{root}/in", table(spark, sf, "events").schema, files_per_batch=2)
    run = stream.writeStream.foreachBatch(with_retries(land, delay=0.0)).option("checkpointLocation", f"{root}/checkpoint")
    run.trigger(availableNow=True).start().awaitTermination()
    if not failed:
        raise RuntimeError("no batch has failed, so none was tried again")
    out = spark.read.parquet(f"{root}/out")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 3).alias("total"))
