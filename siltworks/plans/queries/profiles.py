"""Profiles of the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from siltworks.operators import profile as prof
from siltworks.operators.literals import literal_table
from siltworks.plans.queries.rules import DIRTY_EVENTS_SQL, dirty_events
from siltworks.plans.registry import query, table
from siltworks.plans.scratch import scratch_path

_DIRTY_COLUMNS = [
    ("event_id", "INTEGER"), ("event_type", "STRING"), ("user_text", "STRING"), ("props", "STRING"), ("flag_text", "STRING"), ("value", "FLOAT"),
]


def _column_rows(columns) -> str:
    return " union all ".join(
        f"select '{c}' as column_name, '{t}' as data_type, count({c}) < count(*) as nullable, cast({i + 1} as bigint) as ordinal, count(*) as row_count, "
        f"count(*) - count({c}) as null_count from dirty"
        for i, (c, t) in enumerate(columns)
    )


@query("profile_schema", sql=f"with {DIRTY_EVENTS_SQL} {_column_rows(_DIRTY_COLUMNS)}")
def profile_schema(spark, sf):
    p = prof.profile(dirty_events(spark, sf), "events", keys=False)
    return p.withColumn("ordinal", F.col("ordinal").cast("bigint")).drop("dataset_id", "key_candidate")


TABLES = ("customer", "orders", "lineitem", "part", "supplier", "events", "documents", "conversations", "labels")
_KEYED = (
    ("customer", ("c_custkey", "c_nationkey")), ("orders", ("o_orderkey", "o_custkey", "o_orderpriority")),
    ("lineitem", ("l_orderkey", "l_partkey", "l_suppkey")), ("part", ("p_partkey",)), ("supplier", ("s_suppkey", "s_nationkey")),
    ("events", ("event_id", "user_id")), ("documents", ("doc_id",)), ("conversations", ("conv_id",)), ("labels", ("doc_id",)),
)


def _profiles(spark, sf, keys=True):
    return reduce(lambda a, b: a.unionByName(b), [prof.profile(table(spark, sf, t), t, keys) for t in TABLES])


_KEYS_SQL = " union all ".join(
    f"select '{t}' as dataset_id, '{c}' as column_name from {t} having count(distinct {c}) = count(*)" for t, cs in _KEYED for c in cs
)


@query("key_candidates", sql=_KEYS_SQL)
def key_candidates(spark, sf):
    return _profiles(spark, sf).where("key_candidate").select("dataset_id", "column_name")


_BATCHED = ("orders", "lineitem", "events")


def _batched_sql() -> str:
    types = {"orders": (("o_orderkey", True), ("o_custkey", True), ("o_totalprice", False)), "lineitem": (("l_orderkey", True), ("l_partkey", True), ("l_suppkey", True)), "events": (("event_id", True), ("user_id", True))}
    return " union all ".join(
        f"select '{t}' as dataset_id, '{c}' as column_name, count(*) as row_count, count(*) - count({c}) as null_count, "
        f"{f'count(distinct {c}) = count(*)' if keyed else 'false'} as is_key from {t}"
        for t, cs in types.items() for c, keyed in cs
    )


@query("profile_from_batches", sql=_batched_sql())
def profile_from_batches(spark, sf):
    """Three tables profiled batch by batch; the merged profile names the key candidates, and only these are checked on the rows."""
    path = scratch_path(spark, "profiles")
    for t in _BATCHED:
        rows = table(spark, sf, t)
        for b in range(4):
            prof.keep_sketches(rows.where(F.pmod(F.xxhash64(rows.columns[0]), F.lit(4)) == b), t, f"batch {b}", path)
    merged = prof.merged_profile(prof.kept_sketches(spark, path)).checkpoint()
    found = merged.where("key_candidate").groupBy("dataset_id").agg(F.collect_list("column_name").alias("c")).collect()  # columns of the named tables
    keys = [prof.exact_keys(table(spark, sf, r["dataset_id"]), r["c"]).withColumn("dataset_id", F.lit(r["dataset_id"])) for r in found]
    known = reduce(lambda a, b: a.unionByName(b), keys, literal_table(spark, [], "column_name string, dataset_id string")).withColumn("is_key", F.lit(True))
    shown = "o_orderkey o_custkey o_totalprice l_orderkey l_partkey l_suppkey event_id user_id".split()
    out = merged.where(F.col("column_name").isin(shown)).join(F.broadcast(known), ["dataset_id", "column_name"], "left")  # a row per column
    return out.select("dataset_id", "column_name", "row_count", "null_count", F.coalesce("is_key", F.lit(False)).alias("is_key"))


@query(
    "timestamp_columns",
    sql="""
    select 'orders' as dataset_id, 'o_orderdate' as column_name, count(*) as row_count from orders
    union all select 'lineitem', 'l_shipdate', count(*) from lineitem union all select 'events', 'ts', count(*) from events""",
)
def timestamp_columns(spark, sf):
    return prof.timestamp_columns(_profiles(spark, sf, keys=False)).select("dataset_id", "column_name", "row_count")


@query(
    "value_types",
    sql=f"""
    with {DIRTY_EVENTS_SQL}, f as (
      select 'event_type' as column_name, arg_min(event_type, event_id) filter (where event_type <> '') as v, count(event_type) < count(*) as nullable from dirty
      union all select 'user_text', arg_min(user_text, event_id) filter (where user_text <> ''), count(user_text) < count(*) from dirty
      union all select 'props', arg_min(props, event_id) filter (where event_id > 0), count(props) < count(*) or true from dirty
      union all select 'stamp', arg_min(cast(date_trunc('second', ts) as varchar), event_id), false from events
      union all select 'amount', arg_min(printf('%.2f', value), event_id), false from events
      union all select 'nothing', null, true)
    select column_name, case column_name when 'event_type' then 'STRING' when 'props' then 'JSON' when 'stamp' then 'TIMESTAMP'
      when 'amount' then 'DOUBLE' when 'nothing' then 'STRING'
      else case when regexp_full_match(v, '-?[0-9]+') then 'INTEGER' else 'STRING' end end as data_type, nullable, v as sample_value from f""",
)
def value_types(spark, sf):
    stamps = table(spark, sf, "events").selectExpr(
        "event_id as e2", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as stamp", "format_string('%.2f', value) as amount"
    )
    d = dirty_events(spark, sf).join(stamps, F.col("event_id") == F.col("e2"))
    d = d.withColumn("props", F.expr("case when event_id > 0 then props else '' end")).withColumn("nothing", F.lit(""))
    return prof.value_types(d, ["event_type", "user_text", "props", "stamp", "amount", "nothing"], "event_id")


@query(
    "schema_guesses",
    sql="""
    select 'orders' as dataset_id, 'uuid_order' as key_guess, 'o_orderdate' as watermark_guess, false as has_personal_data, count(*) as n from orders
    union all select 'customer', 'id', null, true, count(*) from customer""",
)
def schema_guesses(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_custkey", "o_orderkey as uuid_order", "o_orderdate")
    c = table(spark, sf, "customer").selectExpr("c_custkey as id", "c_name as Email_Address")
    p = prof.profile(o, "orders").unionByName(prof.profile(c, "customer"))
    n = p.groupBy("dataset_id").agg(F.max("row_count").alias("n"))
    return prof.guesses(p).join(F.broadcast(n), "dataset_id")  # one row per profiled table


@query(
    "rules_seeded_from_profile",
    sql="""
    select 'orders' as dataset_id, c as column_name, t as expected_data_type, 'NOT_NULL' as dq_rule, 'WARN' as severity, n from
      (select unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) as c,
        unnest(['INTEGER', 'INTEGER', 'STRING', 'FLOAT', 'DATE', 'STRING']) as t), (select count(*) as n from orders)
    where c <> 'o_custkey'
    union all select 'orders', unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']), 'STRING', 'NOT_NULL', 'ERROR',
      (select count(*) from orders)""",
)
def rules_seeded_from_profile(spark, sf):
    """Seeds for the unruled columns of the orders, and the static suggestion for all of them."""
    from siltworks.operators import rule_catalog as rc

    orders = table(spark, sf, "orders")
    p = prof.profile(orders, "orders", keys=False)
    known = literal_table(spark, [("orders", "o_custkey")], "dataset_id string, column_name string")
    seeds = rc.seed_rules(p, known).unionByName(rc.suggest_not_null(orders, "orders"), allowMissingColumns=True)
    n = orders.agg(F.count(F.lit(1)).alias("n"))
    out = seeds.select("dataset_id", "column_name", "expected_data_type", "dq_rule", "severity")
    return out.join(F.broadcast(n))  # one row
