"""Bronze, silver and gold over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.functions.casts import finite_or_null
from siltworks.functions.rules import Rule
from siltworks.operators import dq
from siltworks.operators.standardize import conform, known_first, preview, standardize, union_all
from siltworks.operators.upsert import newer_than, upsert
from siltworks.plans.file_silver import FileSilver
from siltworks.plans.layers import Dataset, LayerStore, plan_layers, run_dataset
from siltworks.plans.registry import query, table
from siltworks.plans.scratch import scratch_path

BATCH, TS = "20240102030405", "2024-01-02T03:04:05"

# The late batch: returned lines arrive again with one more unit, some of them without a ship date.
_LATE_SQL = """
    late as (select l_orderkey, l_linenumber, l_partkey, l_quantity + 1 as l_quantity,
      case when l_linenumber = 3 then null else l_shipdate end as l_shipdate
      from lineitem where l_returnflag = 'R')"""


def line_columns(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate", "l_returnflag")


def late_lines(spark, sf):
    return line_columns(spark, sf).where("l_returnflag = 'R'").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity + 1 as l_quantity",
        "case when l_linenumber = 3 then null else l_shipdate end as l_shipdate",
    )


def _upsert_sql(keys: str, nulls: str) -> str:
    return f"""
    with {_LATE_SQL}, a as (
      select l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate, 0 as n from lineitem
      union all select *, 1 from late),
    r as (select *, row_number() over (partition by {keys} order by n desc, l_shipdate desc nulls {nulls},
      l_linenumber desc, l_partkey desc, l_quantity desc) as rn from a)
    select l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate from r where rn = 1"""


def _upsert(spark, sf, keys, null_watermark):
    old = line_columns(spark, sf).drop("l_returnflag")
    ties = ("l_linenumber", "l_partkey", "l_quantity")
    return upsert(old, late_lines(spark, sf), keys, "l_shipdate", ties, null_watermark)


@query("silver_upsert", sql=_upsert_sql("l_orderkey", "first"))
def silver_upsert(spark, sf):
    return _upsert(spark, sf, ["l_orderkey"], "wins")


@query("silver_upsert_composite", sql=_upsert_sql("l_orderkey, l_linenumber", "last"))
def silver_upsert_composite(spark, sf):
    return _upsert(spark, sf, ["l_orderkey", "l_linenumber"], "loses")


@query(
    "silver_incremental",
    sql="""
    select o_orderstatus, count(*) as n, cast(max(o_orderkey) as bigint) as last_key from orders
    where o_orderdate >= timestamp '1998-01-01 00:00:00' group by o_orderstatus""",
)
def silver_incremental(spark, sf):
    new = newer_than(table(spark, sf, "orders"), "o_orderdate", "1998-01-01 00:00:00")
    return new.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key"))


@query(
    "bronze_standardised",
    sql=f"""
    select 'customer' as kind, c_custkey as key, c_name as name, c_nationkey as nationkey, c_mktsegment as segment,
      '{TS}' as _ingest_ts, '{BATCH}' as _batch_id from customer
    union all select 'supplier', s_suppkey, s_name, s_nationkey, null, '{TS}', '{BATCH}' from supplier""",
)
def bronze_standardised(spark, sf):
    c = table(spark, sf, "customer").selectExpr(
        "'customer' as kind", "c_custkey as key", "c_name as ` name `", "c_nationkey as nationkey", "c_mktsegment as segment"
    )
    s = table(spark, sf, "supplier").selectExpr(
        "s_name as name", "'supplier' as `kind `", "s_suppkey as key", "s_nationkey as nationkey"
    )
    return standardize([c, s], BATCH, TS)


@query(
    "union_columns",
    sql="""
    select count(*) as n, count(c_acctbal) as balances, count(o_totalprice) as prices, count(custkey) as keys
    from (select c_custkey as custkey, c_acctbal, cast(null as double) as o_totalprice from customer
          union all select o_custkey, null, o_totalprice from orders)""",
)
def union_columns(spark, sf):
    both = union_all([
        table(spark, sf, "customer").selectExpr("c_custkey as `custkey `", "c_acctbal"),
        table(spark, sf, "orders").selectExpr("o_totalprice", "o_custkey as custkey"),
    ])
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count("c_acctbal").alias("balances"),
        F.count("o_totalprice").alias("prices"), F.count("custkey").alias("keys"),
    )


@query(
    "conform_columns",
    sql="select p_partkey, p_brand, cast(null as varchar) as owner, cast(null as double) as weight from part",
)
def conform_columns(spark, sf):
    ordered = known_first(table(spark, sf, "part"), ["p_brand", "p_partkey"])
    return conform(ordered, ["p_partkey", "p_brand", "owner", "weight"], {"weight": "double"})


@query(
    "finite_values",
    sql="""
    select p_partkey, case when p_size = 1 then null when p_size = 2 then null else p_retailprice / p_size end as unit_price
    from part""",
)
def finite_values(spark, sf):
    raw = F.expr(
        "case when p_size = 1 then double('NaN') when p_size = 2 then -double('Infinity') else p_retailprice / p_size end"
    )
    return table(spark, sf, "part").select("p_partkey", finite_or_null(raw).alias("unit_price"))


ORDER_RULES = [
    Rule("o_orderkey", "INTEGER", "UNIQUE", "BLOCK"),
    Rule("o_totalprice", "FLOAT", "RANGE", "ERROR", "1000:400000"),
    Rule("o_orderpriority", "STRING", "CUSTOM", "WARN", "ALLOWED_VALUES=1-URGENT,2-HIGH"),
]
ORDERS = Dataset("orders", "shop", "orders", "INCREMENTAL", "o_custkey", "o_orderdate", None, ("o_orderkey",))


@query(
    "layer_counts",
    sql="""
    with ok as (select * from orders where o_totalprice between 1000 and 400000)
    select (select count(*) from orders) as raw_rows, (select count(*) from orders) as bronze_rows,
      (select count(*) from orders) - (select count(*) from ok) as failed_rows,
      (select count(distinct o_custkey) from ok) as silver_rows, (select count(*) from ok) as gold_rows,
      (select count(*) from orders where o_orderpriority not in ('1-URGENT', '2-HIGH')) as warnings""",
)
def layer_counts(spark, sf):
    layers = plan_layers([table(spark, sf, "orders")], ORDERS, ORDER_RULES, BATCH, TS)
    counts = dq.split_counts(layers.flagged)
    silver = layers.silver.agg(F.count(F.lit(1)).alias("silver_rows"))
    return counts.join(F.broadcast(silver)).select(  # one row each
        F.col("rows_read").alias("raw_rows"), F.col("rows_read").alias("bronze_rows"), "failed_rows", "silver_rows",
        F.col("valid_rows").alias("gold_rows"), "warnings",
    )


@query(
    "gold_publish",
    sql="""
    select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders
    where o_totalprice between 1000 and 400000 group by o_orderstatus""",
)
def gold_publish(spark, sf):
    gold = plan_layers([table(spark, sf, "orders")], ORDERS, ORDER_RULES, BATCH, TS).gold
    return gold.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "gold_from_silver",
    sql="""
    with ok as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn
      from orders where o_totalprice between 1000 and 400000)
    select o_custkey, o_orderkey, o_orderdate from ok where rn = 1""",
)
def gold_from_silver(spark, sf):
    layers = plan_layers([table(spark, sf, "orders")], ORDERS, ORDER_RULES, BATCH, TS, gold_from="silver")
    return layers.gold.select("o_custkey", "o_orderkey", "o_orderdate")


@query(
    "silver_partition_counts",
    sql="select coalesce(lang, 'none') as lang, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by 1",
)
def silver_partition_counts(spark, sf):
    """Rows per partition after a partitioned write and read-back."""
    from siltworks.plans.layers import write_counted
    from siltworks.plans.scratch import scratch_path

    path = scratch_path(spark, "silver_by_lang")
    write_counted(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), path, partition_by=["lang"])
    back = spark.read.parquet(path)
    return back.groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )


@query(
    "silver_incremental_null_watermark",
    sql="""
    select o_orderstatus, count(*) as n from orders
    where o_orderkey % 5 = 0 or o_orderdate >= (select max(o_orderdate) from orders where o_orderkey % 5 <> 0) group by o_orderstatus""",
)
def silver_incremental_null_watermark(spark, sf):
    """Every fifth order has no watermark; the stored one is the highest of the others, whose rows come again."""
    o = table(spark, sf, "orders").withColumn("wm", F.expr("case when o_orderkey % 5 <> 0 then o_orderdate end"))
    last = o.agg(F.max("wm")).first()[0]
    return newer_than(o, "wm", last).where("o_orderkey % 5 = 0 or wm is not null").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "preview_rows",
    sql="""
    select coalesce(cast(o_orderkey as varchar), '') as o_orderkey, coalesce(cast(o_custkey as varchar), '') as o_custkey,
      coalesce(o_orderstatus, '') as o_orderstatus, coalesce(o_orderpriority, '') as o_orderpriority
    from orders order by orders.o_orderkey limit 100""",
)
def preview_rows(spark, sf):
    """The hundred smallest order keys: the preview's own limit, under a fixed order."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return preview(o.orderBy("o_orderkey"), 100)


# A batch of the newest thousandth of the keys: half of its rows replace orders, half have keys that are new.
_NEWEST_SQL = """
    newest as (select o_orderkey + n.shift as o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 as o_totalprice
      from orders, (values (0), (1000000000)) n(shift) where o_orderkey > (select max(o_orderkey) - max(o_orderkey) // 1000 from orders))"""


def _silver_by_files(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    # about a hundred files at any size
    silver = FileSilver(spark, scratch_path(spark, "file_silver"), ["o_orderkey"], rows_a_file=max(1, orders.count() // 100))
    silver.merge(orders, "first")
    top = orders.agg((F.max("o_orderkey") - F.expr("max(o_orderkey) div 1000")).alias("_from"))
    newest = orders.join(F.broadcast(top), F.col("o_orderkey") > F.col("_from")).drop("_from")  # one row
    newest = newest.withColumn("o_totalprice", F.col("o_totalprice") + 1)
    silver.merge(newest.unionByName(newest.withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000)), "second")
    return silver


@query(
    "silver_file_merge",
    sql=f"""
    with {_NEWEST_SQL}
    select * from newest union all select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where o_orderkey not in (select o_orderkey from newest)""",
)
def silver_file_merge(spark, sf):
    """All orders, and a batch of the newest merged into the files that hold its keys."""
    return _silver_by_files(spark, sf).read()


@query(
    "silver_file_snapshots",
    sql=f"""
    with {_NEWEST_SQL}
    select 'first' as batch_id, count(*) as n_rows, cast(round(sum(o_totalprice)) as bigint) as worth, true as shares from orders
    union all select 'second', (select count(*) from orders) + count(*) filter (where o_orderkey > 1000000000),
      cast(round((select sum(o_totalprice) from orders) + count(*) filter (where o_orderkey < 1000000000) + sum(case when o_orderkey > 1000000000 then o_totalprice else 0 end)) as bigint), true from newest""",
)
def silver_file_snapshots(spark, sf):
    """Both snapshots as they can still be read; `shares`: no more than 5 per cent of the second one's files are its own."""
    silver = _silver_by_files(spark, sf)
    kept = silver.versions().select("version", "batch_id", ((F.col("version") == 1) | (F.col("written") * 20 <= F.col("files"))).alias("shares"))
    both = silver.read(1).withColumn("version", F.lit(1).cast("bigint")).unionByName(silver.read(2).withColumn("version", F.lit(2).cast("bigint")))
    sums = both.groupBy("version").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("o_totalprice")).cast("bigint").alias("worth"))
    return sums.join(kept, "version").select("batch_id", "n_rows", "worth", "shares")


@query(
    "layer_run_by_files",
    sql=f"""
    with {_NEWEST_SQL}, ok as (select * from newest where o_totalprice between 1000 and 400000),
    silver as (select * from ok union all select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders
      where o_totalprice between 1000 and 400000 and o_orderkey not in (select o_orderkey from ok))
    select o_orderstatus, count(*) as n_rows, cast(round(sum(o_totalprice)) as bigint) as worth, true as shares from silver group by o_orderstatus""",
)
def layer_run_by_files(spark, sf):
    """Two runs of the orders through all layers, the second of the newest keys and run twice, as after a failure: silver as it
    stands, and whether the last run wrote no more than 5 per cent of its files."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    top = orders.agg((F.max("o_orderkey") - F.expr("max(o_orderkey) div 1000")).alias("_from"))
    newest = orders.join(F.broadcast(top), F.col("o_orderkey") > F.col("_from")).drop("_from")  # one row
    newest = newest.withColumn("o_totalprice", F.col("o_totalprice") + 1)
    newest = newest.unionByName(newest.withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000))
    d = Dataset("orders", "shop", "orders", "INCREMENTAL", "o_orderkey", rows_a_file=max(1, orders.count() // 100))  # about a hundred files at any size
    rules = [Rule("o_totalprice", "FLOAT", "RANGE", "ERROR", "1000:400000")]
    store = LayerStore(spark, scratch_path(spark, "lake"))
    run_dataset(store, d, [orders], rules, "first", "2024-01-02T03:04:05")
    for _ in range(2):
        run_dataset(store, d, [newest], rules, "second", "2024-01-03T03:04:05")
    top = store.file_silver(d).version()
    shares = F.lit(top["written"] * 20 <= top["files"])
    return store.silver(d).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("o_totalprice")).cast("bigint").alias("worth"), F.first(shares).alias("shares")
    )
