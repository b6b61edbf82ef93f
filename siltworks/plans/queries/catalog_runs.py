"""Runs from the catalog over files written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.operators.literals import literal_table
from siltworks.plans.catalog_run import catalog_after, run_all
from siltworks.plans.layers import LayerStore
from siltworks.plans.registry import query, table
from siltworks.plans.schemas import CATALOG, CATALOG_COLUMNS, DQ_RULES
from siltworks.plans.scratch import scratch_path
from siltworks.sources import checks, inventory

BATCH, TS = "20240102030405", "2024-01-02T03:04:05"


def _entry(dataset_id, folder, fmt, load="FULL", key=None, watermark=None, active=True):
    row = {
        "dataset_id": dataset_id, "pipeline_id": f"p_{dataset_id}", "client_name": "shop", "source_type": "S3", "source_folder": folder, "source_object": "",
        "file_format": fmt, "target_layer_bronze": "b", "target_layer_silver": "s", "is_active": active, "load_type": load, "upsert_key": key,
        "watermark_column": watermark,
    }
    return tuple(row.get(c) for c in CATALOG_COLUMNS)


CATALOGUED = [
    _entry("d_orders", "orders", "CSV", "INCREMENTAL", "o_custkey", "o_orderkey"), _entry("d_customers", "customers", "JSON"),
    _entry("d_events", "events", "PARQUET"), _entry("d_idle", "customers", "JSON", active=False),
]


def _rule(i, dataset, column, kind, rule, value, severity, active=True):
    return (str(i), dataset, column, kind, rule, value, severity, active, None, None)


RULES = [
    _rule(1, "d_orders", "o_orderkey", "INTEGER", "UNIQUE", None, "BLOCK"), _rule(2, "d_orders", "o_totalprice", "FLOAT", "RANGE", "1000:400000", "ERROR"),
    _rule(3, "d_orders", "o_orderstatus", "STRING", "CUSTOM", "ALLOWED_VALUES=O", "ERROR", False),
    _rule(4, "d_customers", "c_acctbal", "FLOAT", "CUSTOM", "NEGATIVE_CHECK=true", "WARN"), _rule(5, "d_events", "event_type", "STRING", "NOT_NULL", None, "ERROR"),
]


@query(
    "run_from_catalog",
    sql=f"""
    with o as (select *, o_totalprice between 1000 and 400000 as ok from orders),
      c as (select * from customer where c_custkey % 5 <> 0)
    select 'd_orders' as dataset_id, 'SUCCESS' as status, count(*) as raw_rows, count(distinct o_custkey) filter (where ok) as silver_rows,
      count(*) filter (where not ok) as dq_violations, cast(0 as bigint) as dq_warnings, '{BATCH}' as last_seen_batch from o
    union all select 'd_customers', 'SUCCESS', count(*), count(*), 0, count(*) filter (where c_acctbal < 0), '{BATCH}' from c
    union all select 'd_events', 'SUCCESS', count(*), count(*), 0, 0, '{BATCH}' from events
    union all select 'd_idle', 'FAILURE', null, null, null, null, null""",
)
def run_from_catalog(spark, sf):
    """Three datasets of three formats from their ids; a fifth of the customers landed in a file that the gate refuses, and
    an inactive dataset is recorded as a failure."""
    root = scratch_path(spark, "catalogued")
    raw = f"{root}/Raw/shop/{BATCH}"
    table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").write.csv(f"{raw}/orders", header=True)
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    customers.where("c_custkey % 5 <> 0").write.json(f"{raw}/customers")
    customers.where("c_custkey % 5 = 0").write.csv(f"{raw}/customers/late.tsv", sep="\t", header=True)
    table(spark, sf, "events").select("event_id", "event_type", "user_id").write.parquet(f"{raw}/events")
    files = inventory.describe(inventory.data_files(inventory.list_files(spark, raw)), F.lit("shop"), F.lit("S3"))
    # what Spark writes below late.tsv is a .csv part; its landing name is the folder's
    name = F.when(F.col("file_path").contains("late.tsv"), "late.tsv").otherwise(F.col("file_name"))
    log = checks.ingestion_log(files, BATCH, TS, checks.failed_rules(F.col("file_size"), name))
    catalog, rules = literal_table(spark, CATALOGUED, CATALOG), literal_table(spark, RULES, DQ_RULES)
    store = LayerStore(spark, f"{root}/lake")
    results = run_all(store, catalog, rules, [r[0] for r in CATALOGUED], BATCH, TS, files, log=log)
    after = catalog_after(catalog, results, BATCH, TS)
    history = store.run_history().where(F.col("batch_id") == BATCH)
    return after.select("dataset_id", "last_seen_batch").join(history, "dataset_id").select(
        "dataset_id", "status", "raw_rows", "silver_rows", "dq_violations", "dq_warnings", "last_seen_batch"
    )
