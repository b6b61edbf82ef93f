"""Run history and activity runs, derived from the events: an event is one activity run."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.operators import runs
from siltworks.plans.registry import query, table

# Payload texts are JSON; nothing in them needs quoting beyond the double quotes.
ACTIVITY_RUNS = """
  event_id, cast(user_id as varchar(20)) as pipeline, event_type || '_' || user_id as activityName,
  case event_id % 6 when 0 then 'Copy' when 1 then 'Lookup' when 2 then 'WebActivity' when 3 then 'TridentNotebook' when 4 then 'Script' else 'copy' end as activityType,
  case event_type when 'error' then 'Failed' when 'purchase' then 'Completed' when 'view' then 'Succeeded' when 'signup' then 'Cancelled' else 'InProgress' end as status,
  cast(floor(value * 1000) as bigint) as durationInMs,
  case when event_id % 4 = 0 then 2 when event_id % 9 = 0 then null else 0 end as retryAttempt,
  ts as activityRunStart,
  case event_id % 6
    when 1 then '{"source": {"sqlReaderQuery": "select ' || event_id || '"}}'
    when 2 then '{"method": "GET", "relativeUrl": "/v1/' || user_id || '"}'
    when 3 then '{"notebookId": "nb' || user_id || '", "parameters": {"layer": "gold"}}'
    when 4 then '{"text": "delete ' || event_id || '"}'
    else '{"source": {"type": "Json", "fileName": "f' || event_id || '"}, "sink": {"type": "Parquet", "table": "t' || user_id || '", "format": "delta"}}' end as input,
  case event_id % 6
    when 1 then '{"firstRow": {"a": ' || user_id || '}}'
    when 2 then '{"statuscode": 200}'
    when 3 then '{}'
    when 4 then '{"rowsAffected": ' || user_id || '}'
    else '{"rowsRead": ' || event_id || ', "rowsCopied": ' || case when event_id % 12 = 0 then event_id else event_id + 1 end || ', "dataRead": ' || event_id * 1000 || '}' end as output,
  case when event_type = 'error' then '{"message": "no ' || user_id || '"}' end as error"""
_RUNS_SQL = f"runs as (select {ACTIVITY_RUNS}, ts + to_milliseconds(cast(floor(value * 1000) as bigint)) as activityRunEnd from events)"


def activity_runs(spark, sf):
    e = table(spark, sf, "events")
    end = F.expr("timestampadd(MILLISECOND, cast(floor(value * 1000) as int), ts)")
    return e.select(*[F.expr(x) for x in _split(ACTIVITY_RUNS)], end.alias("activityRunEnd"))


def _split(text: str) -> list[str]:
    """The select list at its top-level commas."""
    out, depth, quoted, last = [], 0, False, 0
    for i, ch in enumerate(text):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch in "()":
            depth += 1 if ch == "(" else -1
        elif not quoted and not depth and ch == ",":
            out.append(text[last:i])
            last = i + 1
    return [x.strip() for x in [*out, text[last:]]]


_BUCKET = "case status when 'Completed' then 'SUCCESS' when 'Succeeded' then 'SUCCESS' when 'Failed' then 'FAILURE' when 'Cancelled' then 'FAILURE' else 'RUNNING' end"


@query("status_buckets", sql=f"with {_RUNS_SQL} select {_BUCKET} as bucket, count(*) as n from runs group by 1")
def status_buckets(spark, sf):
    return activity_runs(spark, sf).groupBy(runs.status_bucket(F.col("status")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "activity_metrics",
    sql=f"""
    with {_RUNS_SQL}
    select pipeline, count(*) as total, count(*) filter (where status in ('Completed', 'Succeeded')) as success_count,
      count(*) filter (where status = 'Failed') as failure_count, cast(sum(coalesce(retryAttempt, 0)) as bigint) as retry_count,
      date_sub('millisecond', min(activityRunStart), max(activityRunEnd)) as duration_ms from runs group by pipeline""",
)
def activity_metrics(spark, sf):
    return runs.activity_metrics(activity_runs(spark, sf), ["pipeline"])


@query(
    "runtime_statistics",
    sql=f"""
    with {_RUNS_SQL}, o as (select *, event_id % 6 in (0, 5) as c from runs)
    select activityName as activity, case when c then event_id end as rows_read,
      case when c then event_id + case when event_id % 12 = 0 then 0 else 1 end end as rows_written,
      cast(case when c then 1 end as bigint) as files_read, cast(case when c then 1 end as bigint) as files_written,
      case when c and event_id > 0 and durationInMs > 0
        then round(event_id * 1000.0::double / greatest(durationInMs / 1000.0::double, 0.001::double) / (1024 * 1024), 3) end as throughput,
      nullif(durationInMs, 0) as duration_ms from o""",
)
def runtime_statistics(spark, sf):
    return runs.runtime_statistics(activity_runs(spark, sf))


@query(
    "copied_row_rates",
    sql=f"""
    with {_RUNS_SQL}
    select event_id, round(event_id / greatest(durationInMs / 1000.0::double, 0.001::double), 2) as rows_per_second from runs where event_id % 6 in (0, 5)""",
)
def copied_row_rates(spark, sf):
    r = activity_runs(spark, sf).where(F.lower("activityType") == "copy")
    return r.select("event_id", F.round(runs.rows_per_second(runs.rows_read(), F.col("durationInMs")), 2).alias("rows_per_second"))


@query(
    "primary_copies",
    sql=f"""
    with {_RUNS_SQL}, m as (select *, event_id + case when event_id % 12 = 0 then 0 else 1 end as moved from runs where event_id % 6 in (0, 5)),
    r as (select *, row_number() over (partition by pipeline order by moved desc, durationInMs desc, event_id) as rn from m)
    select pipeline, event_id, moved from r where rn = 1""",
)
def primary_copies(spark, sf):
    return runs.primary_copy(activity_runs(spark, sf), ["pipeline"], "event_id").select("pipeline", "event_id", "moved")


@query(
    "copy_lineage",
    sql=f"""
    with {_RUNS_SQL}
    select activityName as activity, 'Json' as source_type, 'Parquet' as sink_type, 'f' || event_id as source_path, 't' || pipeline as target_path,
      event_id as rows_read, event_id + case when event_id % 12 = 0 then 0 else 1 end as rows_written, 'delta' as format
    from runs where event_id % 6 in (0, 5)""",
)
def copy_lineage(spark, sf):
    return runs.copy_lineage(activity_runs(spark, sf))


@query(
    "run_observations",
    sql=f"""
    with {_RUNS_SQL}
    select activityName as activity, 'Row count mismatch' as observation, 'rowsRead=' || event_id || ' rowsWritten=' || (event_id + 1) as evidence
      from runs where event_id % 6 in (0, 5) and event_id % 12 <> 0
    union all select activityName, 'Runtime retry detected', 'retryAttempt=' || retryAttempt from runs where retryAttempt > 0
    union all select activityName, 'Activity failure captured', 'no ' || pipeline from runs where status = 'Failed'""",
)
def run_observations(spark, sf):
    return runs.run_observations(activity_runs(spark, sf))


@query(
    "run_lookups",
    sql=f"""
    with {_RUNS_SQL}
    select activityName as activity, 'select ' || event_id as executed_sql, '[]' as rows, '{{"a":' || pipeline || '}}' as first_row,
      cast(null as varchar) as schema from runs where event_id % 6 = 1""",
)
def run_lookups(spark, sf):
    return runs.lookups(activity_runs(spark, sf))


@query(
    "run_web_calls",
    sql=f"""
    with {_RUNS_SQL}
    select activityName as activity, 'GET' as method, '/v1/' || pipeline as url, '200' as status_code, '{{"statuscode": 200}}' as response
    from runs where event_id % 6 = 2""",
)
def run_web_calls(spark, sf):
    return runs.web_calls(activity_runs(spark, sf))


@query(
    "run_notebooks",
    sql=f"""
    with {_RUNS_SQL}
    select activityName as activity, 'nb' || pipeline as notebook_id, '{{"layer":"gold"}}' as parameters, durationInMs as duration_ms
    from runs where event_id % 6 = 3""",
)
def run_notebooks(spark, sf):
    return runs.notebook_runs(activity_runs(spark, sf))


@query(
    "run_sql",
    sql=f"""
    with {_RUNS_SQL}
    select activityName as activity, activityType as activity_type, case event_id % 6 when 1 then 'select ' else 'delete ' end || event_id as sql,
      case event_id % 6 when 4 then cast(pipeline as bigint) end as affected_rows from runs where event_id % 6 in (1, 4)""",
)
def run_sql(spark, sf):
    return runs.sql_runs(activity_runs(spark, sf))


def last_runs(spark, sf):
    """The last run of each activity."""
    from siltworks.operators.keyed import first_per_key

    return first_per_key(activity_runs(spark, sf), ["activityName"], [F.desc("event_id")])


_LAST_SQL = f"{_RUNS_SQL}, last as (select * from (select *, row_number() over (partition by activityName order by event_id desc) as rn from runs) where rn = 1)"


@query(
    "node_status",
    sql=f"""
    with {_LAST_SQL}, nodes as (select c_custkey as k, 'click_' || c_custkey as label, 'view_' || c_custkey as id from customer)
    select k, label, id, coalesce(a.status, b.status) as status,
      case when a.activityName is not null then a.durationInMs else b.durationInMs end as duration_ms
    from nodes left join last a on label = a.activityName left join last b on id = b.activityName""",
)
def node_status(spark, sf):
    nodes = table(spark, sf, "customer").selectExpr("c_custkey as k", "'click_' || c_custkey as label", "'view_' || c_custkey as id")
    return runs.node_status(nodes, last_runs(spark, sf)).select("k", "label", "id", "status", "duration_ms")


@query(
    "resolved_expressions",
    sql=f"""
    with {_LAST_SQL}
    select activityName as activity, p.field_path, 'x' as expression,
      case when event_id % 6 = 2 and field_path = 'typeProperties.relativeUrl' then '/v1/' || pipeline
           when event_id % 6 = 3 and field_path = 'typeProperties.parameters.p' then '{{"layer":"gold"}}'
           when event_id % 6 = 1 and field_path = 'source.sqlReaderQuery' then 'select ' || event_id
           when event_id % 6 = 1 then '{{"a":' || pipeline || '}}' end as resolved_value,
      activityName || case when event_id % 6 = 2 then ' input' when event_id % 6 = 3 then ' input parameters'
        when field_path = 'source.sqlReaderQuery' then ' input SQL' else ' output' end as resolved_from
    from last, (select unnest(['typeProperties.relativeUrl', 'typeProperties.parameters.p', 'source.sqlReaderQuery']) as field_path) p
    where event_id % 6 = 1 or (event_id % 6 = 2 and field_path = 'typeProperties.relativeUrl') or (event_id % 6 = 3 and field_path = 'typeProperties.parameters.p')""",
)
def resolved_expressions(spark, sf):
    exprs = last_runs(spark, sf).select(
        F.col("activityName").alias("activity"), F.lit("x").alias("expression"),
        F.explode(F.array(F.lit("typeProperties.relativeUrl"), F.lit("typeProperties.parameters.p"), F.lit("source.sqlReaderQuery"))).alias("field_path"),
    )
    return runs.resolve_expressions(exprs, last_runs(spark, sf))


# Batch results: an order is the run of one dataset, a customer's orders are a batch.
_RESULTS = [
    "cast(o_custkey as varchar(20)) as batch_id",
    "cast(o_orderkey as varchar(20)) as dataset_id",
    "case when o_orderkey % 2 = 0 then 'orders ' || o_orderkey end as dataset_name",
    "case o_orderstatus when 'P' then 'FAILURE' else 'SUCCESS' end as status",
    "case o_orderstatus when 'P' then 'bad ' || o_orderpriority end as reason",
    "o_orderkey * 2 as raw_rows",
    "o_orderkey * 2 as bronze_rows",
    "o_orderkey as silver_rows",
    "case when o_orderkey % 3 = 0 then 0 else o_orderkey - 1 end as gold_rows",
    "'PASSED' as gold_status",
    "o_orderkey % 5 as dq_violations",
    "o_orderkey % 7 as dq_warnings",
    "'Bronze/' || o_orderkey as bronze_path",
    "'Silver/' || o_orderkey as silver_path",
    "case when o_orderkey % 3 <> 0 then 'Gold/' || o_orderkey end as gold_path",
    "cast(null as varchar(20)) as rejected_path",
]
_RESULTS_SQL = f"results as (select o_orderdate, {', '.join(_RESULTS)} from orders)"


def results(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderdate", *_RESULTS)


@query(
    "batch_rollup",
    sql=f"""
    with {_RESULTS_SQL}, b as (
      select batch_id, count(*) filter (where status = 'SUCCESS') as success_count, count(*) filter (where status = 'FAILURE') as failure_count,
        cast(coalesce(sum(raw_rows) filter (where status = 'SUCCESS'), 0) as bigint) as rows_read,
        cast(coalesce(sum(coalesce(nullif(gold_rows, 0), silver_rows)) filter (where status = 'SUCCESS'), 0) as bigint) as rows_written,
        cast(sum(dq_violations) as bigint) as dq_violations, cast(sum(dq_warnings) as bigint) as dq_warnings, count(*) as total
      from results group by batch_id)
    select *, case when failure_count = 0 then 'SUCCESS' when success_count > 0 then 'PARTIAL' else 'FAILURE' end as status,
      success_count / greatest(total, 1) as success_ratio from b""",
)
def batch_rollup(spark, sf):
    return runs.batch_rollup(results(spark, sf))


@query(
    "batch_report",
    sql=f"""
    with {_RESULTS_SQL}, r as (select *, status = 'SUCCESS' as ok from results)
    select status, coalesce(dataset_name, dataset_id) as dataset, dataset_id, case when ok then cast(raw_rows as varchar) else '' end as raw_rows,
      case when ok then cast(bronze_rows as varchar) else '' end as bronze_rows, case when ok then cast(silver_rows as varchar) else '' end as silver_rows,
      case when ok then cast(gold_rows as varchar) else '' end as gold_rows, case when ok then gold_status else '' end as gold_status,
      case when ok then bronze_path else '' end as bronze_path, case when ok then silver_path else '' end as silver_paths,
      case when ok then coalesce(gold_path, '') else '' end as gold_paths, '' as rejected_paths,
      case when ok then cast(dq_violations as varchar) else '' end as dq_violations, case when ok then cast(dq_warnings as varchar) else '' end as dq_warnings,
      case when ok then '' else reason end as reason from r""",
)
def batch_report(spark, sf):
    return runs.report_rows(results(spark, sf))


@query("newest_runs", sql=f"with {_RESULTS_SQL} select dataset_id, status from results order by cast(dataset_id as bigint) desc limit 50")
def newest_runs(spark, sf):
    h = results(spark, sf).withColumn("k", F.col("dataset_id").cast("bigint"))
    return runs.newest_runs(h, 50, "k").select("dataset_id", "status")
