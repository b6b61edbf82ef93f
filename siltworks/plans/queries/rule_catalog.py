"""Rule-catalog jobs.  The catalog is derived from the documents: a source is a dataset, a language is a column."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.operators import rule_catalog as rc
from siltworks.operators.table_checks import Check, run_checks
from siltworks.plans.registry import query, table

# Valid in both dialects.
RULE_ROWS = [
    "doc_id as id",
    "source as dataset_id",
    "case when doc_id % 11 = 0 then null else lang end as column_name",
    "case when doc_id % 5 = 0 then null when n_chars > 1000 then 'STRING' else 'FLOAT' end as expected_data_type",
    "case doc_id % 7 when 0 then null when 1 then 'UNIQUE' when 2 then 'RANGE' else 'NOT_NULL' end as dq_rule",
    "case when doc_id % 7 = 2 then '1:' || cast(n_chars as varchar(20)) end as rule_value",
    "case when doc_id % 9 = 0 then null when n_chars > 2000 then 'WARN' else 'ERROR' end as severity",
    "doc_id % 3 <> 0 as is_active",
]
RULE_ROWS_SQL = f"rules as (select {', '.join(RULE_ROWS)} from documents)"


def rule_rows(spark, sf):
    return table(spark, sf, "documents").selectExpr(*RULE_ROWS)


@query(
    "rule_catalog_fold",
    sql=f"""
    with {RULE_ROWS_SQL},
    r as (select *, coalesce(column_name, '__dataset__') as c, is_active and dq_rule is not null as live from rules),
    firsts as (select dataset_id, c, dq_rule, min(id) as f from r where live group by all),
    lists as (select dataset_id, c, string_agg(dq_rule, ',' order by f) as dq_rules from firsts group by all)
    select r.dataset_id, r.c as column_name,
      arg_max(expected_data_type, id) filter (where expected_data_type is not null) as expected_data_type,
      coalesce(any_value(lists.dq_rules), '') as dq_rules,
      arg_max(rule_value, id) filter (where live and rule_value is not null) as rule_value,
      arg_max(severity, id) filter (where severity is not null) as severity,
      bool_or(live) as is_active, count(*) filter (where live) as active_rows
    from r left join lists on r.dataset_id = lists.dataset_id and r.c = lists.c
    group by r.dataset_id, r.c""",
)
def rule_catalog_fold(spark, sf):
    return rc.fold_rules(rule_rows(spark, sf), "id").withColumn("dq_rules", F.array_join("dq_rules", ","))


@query(
    "rule_catalog_replace",
    sql=f"""
    with {RULE_ROWS_SQL},
    sub as (select distinct source as dataset_id, lang as column_name from documents
            where doc_id in (select doc_id from labels where toxic = 1)),
    after as (
      select dataset_id, column_name, dq_rule,
        is_active and dataset_id not in (select dataset_id from sub) as is_active, id is null as is_new from rules
      union all
      select dataset_id, column_name, unnest(['NOT_NULL', 'UNIQUE']), true, true from sub)
    select dataset_id, is_new, is_active, dq_rule, count(*) as n from after group by all""",
)
def rule_catalog_replace(spark, sf):
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    submitted = (
        table(spark, sf, "documents")
        .join(toxic, "doc_id", "left_semi")
        .select("source", "lang")
        .distinct()
        .selectExpr(
            "source as dataset_id", "lang as column_name", "'STRING' as expected_data_type",
            "array('NOT_NULL', 'UNIQUE') as dq_rules", "cast(null as string) as rule_value",
            "'ERROR' as severity", "true as is_active",
        )
    )
    existing = rule_rows(spark, sf).withColumn("updated_at", F.lit(None).cast("timestamp"))
    after = rc.replace_rules(existing, submitted, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return (
        after.withColumn("is_new", F.col("id").isNull())
        .groupBy("dataset_id", "is_new", "is_active", "dq_rule")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "rule_catalog_seed",
    sql=f"""
    with {RULE_ROWS_SQL},
    seen as (select distinct dataset_id, column_name from rules where dq_rule = 'UNIQUE' and dataset_id < 'src15'),
    prof as (select distinct source as dataset_id, lang as column_name from documents)
    select dataset_id, column_name, 'STRING' as expected_data_type, 'NOT_NULL' as dq_rule, 'WARN' as severity,
      true as is_active
    from prof where not exists (select 1 from seen where seen.dataset_id = prof.dataset_id
      and seen.column_name = prof.column_name)
    union all
    select dataset_id, column_name, 'STRING', null, null, false
    from prof where not exists (select 1 from seen where seen.dataset_id = prof.dataset_id
      and seen.column_name = prof.column_name)""",
)
def rule_catalog_seed(spark, sf):
    profile = (
        table(spark, sf, "documents").select(F.col("source").alias("dataset_id"), F.col("lang").alias("column_name"))
        .distinct().withColumn("data_type", F.lit("STRING"))
    )
    some = rule_rows(spark, sf).where("dq_rule = 'UNIQUE' and dataset_id < 'src15'")
    both = rc.seed_rules(profile, some).unionByName(rc.seed_rules(profile, some, active=False))
    return both.drop("rule_value")


@query(
    "rule_suggestions_normalised",
    sql="""
    with s as (select doc_id, source as dataset_id, lang as column_name, n_chars, doc_id % 4 as v from documents),
    items as (
      select s.*, unnest(case v when 0 then ['not_null', 'unique'] when 1 then ['range'] when 2 then ['NOT_NULL']
        else ['custom', 'regex'] end) as name from s),
    sev as (select *, case when n_chars > 2000 then 'WARN' else 'ERROR' end as severity from items)
    select dataset_id, column_name, case when v = 1 then null when v = 3 then 'FLOAT' else 'STRING' end
      as expected_data_type, upper(name) as dq_rule, severity, count(*) as n
    from sev group by all""",
)
def rule_suggestions_normalised(spark, sf):
    s = table(spark, sf, "documents").selectExpr(
        "source as dataset_id",
        "lang as column_name",
        "case doc_id % 4 when 1 then 'money' when 3 then 'float' else '' end as expected_data_type",
        """case doc_id % 4 when 0 then '["not_null", "unique"]' when 1 then '[{"rule": "range"}, "guess"]'
           when 2 then '[{"name": "Not_Null"}]' else '["custom", {"rule": "", "name": "regex"}]' end as rules_json""",
        "cast(null as string) as rule_value",
        "case when n_chars > 2000 then 'warn' when doc_id % 2 = 0 then 'urgent' end as severity",
    )
    out = rc.normalise_suggestions(s)
    return out.groupBy("dataset_id", "column_name", "expected_data_type", "dq_rule", "severity").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "rule_suggestions_accepted",
    sql=f"""
    with {RULE_ROWS_SQL},
    long as (select distinct source as d, lang as c from documents where n_chars > 20000)
    select dataset_id, dq_rule, count(*) as n from (
      select dataset_id, dq_rule from rules where dataset_id not in (select d from long)
      union all select d, 'NOT_NULL' from long) group by all""",
)
def rule_suggestions_accepted(spark, sf):
    s = (
        table(spark, sf, "documents").where("n_chars > 20000").select("source", "lang").distinct()
        .selectExpr(
            "source as dataset_id", "lang as column_name", "'string' as expected_data_type",
            "'[\"not_null\"]' as rules_json", "cast(null as string) as rule_value", "'error' as severity",
        )
    )
    return rc.accept_suggestions(rule_rows(spark, sf), s).groupBy("dataset_id", "dq_rule").agg(F.count(F.lit(1)).alias("n"))


# Runs per day and event type: rows read are all events, rows written the ones that are not errors.
_RUNS_SQL = """
    runs as (select event_type || '-' || strftime(ts, '%Y%m%d') as dataset_id, count(*) as rows_read,
      count(*) filter (where value >= 1) as rows_written from events group by 1)"""


def daily_runs(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.concat_ws("-", "event_type", F.date_format("ts", "yyyyMMdd")).alias("dataset_id")).agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col("value") >= 1).alias("rows_written")
    )


@query(
    "run_reconciliation",
    sql=f"""
    with {_RUNS_SQL}
    select *, case when rows_read = rows_written then 'INFO' else 'ERROR' end as severity from runs""",
)
def run_reconciliation(spark, sf):
    return rc.reconcile(daily_runs(spark, sf))


@query(
    "rule_recommendations",
    sql=f"""
    with {_RUNS_SQL},
    p as (select event_type as dataset_id, unnest(['event_id', 'ts', 'user_id', 'value']) as column_name,
      unnest(['INTEGER', 'TIMESTAMP', 'INTEGER', 'DOUBLE']) as data_type,
      unnest([false, count(ts) < count(*), min(user_id) = 0, false]) as nullable from events group by event_type)
    select dataset_id, 'NOT_NULL' as rule, 'WARN' as severity, column_name,
      'column ' || column_name || ' has no gaps' as reason from p where not nullable
    union all select dataset_id, 'TIMESTAMP_PARSE', 'WARN', null, 'timestamp columns: ts' from p where column_name = 'ts'
    union all select distinct dataset_id, 'HEADER_VALIDATION', 'WARN', null, 'header matches the schema' from p
    union all select distinct dataset_id, 'DELIMITER_CONSISTENCY', 'WARN', null, 'every row uses ,' from p
    union all select dataset_id, 'ROW_COUNT_RECONCILIATION',
      case when rows_read = rows_written then 'INFO' else 'ERROR' end, null,
      'read ' || rows_read || ' written ' || rows_written from runs""",
)
def rule_recommendations(spark, sf):
    per_type = table(spark, sf, "events").groupBy(F.col("event_type").alias("dataset_id")).agg(
        (F.count("ts") < F.count(F.lit(1))).alias("n_ts"), (F.min("user_id") == 0).alias("n_user")
    )
    profile = per_type.selectExpr(
        "dataset_id",
        "stack(4, 'event_id', 'INTEGER', false, 'ts', 'TIMESTAMP', n_ts, 'user_id', 'INTEGER', n_user, "
        "'value', 'DOUBLE', false) as (column_name, data_type, nullable)",
    )
    return rc.recommend(profile, daily_runs(spark, sf), delimiter=",", header=True)


@query(
    "table_checks",
    sql="""
    with c as (
      select 'rows' as check_name, 'row_count' as kind, cast(count(*) as double) as observed, 1 as low, null as high from lineitem
      union all select 'nulls', 'values_null', count(*) filter (where l_tax is null), null, 0 from lineitem
      union all select 'quantity', 'values_between', count(*) filter (where l_quantity not between 1 and 49), null, 0 from lineitem
      union all select 'flags', 'values_in_set', count(*) filter (where l_returnflag not in ('A', 'N')), null, 0 from lineitem
      union all select 'not flags', 'values_not_in_set', count(*) filter (where l_linestatus in ('X')), null, 0 from lineitem
      union all select 'status', 'values_match', count(*) filter (where not regexp_matches(l_linestatus, '^(?:[A-Z])')), null, 0 from lineitem
      union all select 'pair', 'pair_unequal', count(*) filter (where l_orderkey is distinct from l_partkey), null, 0 from lineitem
      union all select 'sum of columns', 'sum_of_columns_off', count(*) filter (where l_orderkey + l_linenumber <> 7), null, 0 from lineitem
      union all select 'sum', 'sum', round(sum(l_linenumber), 2), 1, null from lineitem
      union all select 'mean', 'mean', round(avg(l_quantity), 4), 20, 30 from lineitem
      union all select 'stdev', 'stdev', round(stddev_samp(l_quantity), 4), 20, 30 from lineitem
      union all select 'fresh', 'staleness_seconds', date_diff('second', max(l_shipdate), timestamp '2002-01-01 00:00:00'), null, 86400 from lineitem
      union all select 'parts', 'distinct_count', count(distinct l_partkey), 10, null from lineitem
      union all select 'repeats', 'duplicate_rows', (select sum(n) from (select count(*) as n from lineitem group by l_orderkey) where n > 1), null, 0
      union all select 'orphans', 'orphan_rows', count(*) filter (where l_suppkey not in (select s_suppkey from supplier where s_acctbal >= 0)), null, 0 from lineitem
      union all select 'order', 'column_order_differs', 1, null, 0
      union all select 'type', 'type_differs', 0, null, 0)
    select check_name, kind, observed, coalesce(observed >= low, true) and coalesce(observed <= high, true) as passed from c""",
)
def table_checks(spark, sf):
    parents = {"supplier.s_suppkey": table(spark, sf, "supplier").where("s_acctbal >= 0")}
    checks = [
        Check("rows", "row_count", low=1),
        Check("nulls", "values_null", ("l_tax",), high=0),
        Check("quantity", "values_between", ("l_quantity",), high=0, args={"min": 1, "max": 49}),
        Check("flags", "values_in_set", ("l_returnflag",), high=0, args={"values": ("A", "N")}),
        Check("not flags", "values_not_in_set", ("l_linestatus",), high=0, args={"values": ("X",)}),
        Check("status", "values_match", ("l_linestatus",), high=0, args={"pattern": "[A-Z]"}),
        Check("pair", "pair_unequal", ("l_orderkey", "l_partkey"), high=0),
        Check("sum of columns", "sum_of_columns_off", ("l_orderkey", "l_linenumber"), high=0, args={"total": 7}),
        Check("sum", "sum", ("l_linenumber",), low=1),
        Check("mean", "mean", ("l_quantity",), low=20, high=30),
        Check("stdev", "stdev", ("l_quantity",), low=20, high=30),
        Check("fresh", "staleness_seconds", ("l_shipdate",), high=86400, args={"as_of": "2002-01-01 00:00:00"}),
        Check("parts", "distinct_count", ("l_partkey",), low=10),
        Check("repeats", "duplicate_rows", ("l_orderkey",), high=0),
        Check("orphans", "orphan_rows", ("l_suppkey",), high=0, args={"reference": "supplier.s_suppkey"}),
        Check("order", "column_order_differs", high=0, args={"columns": ("l_orderkey",)}),
        Check("type", "type_differs", ("l_quantity",), high=0, args={"type": "double"}),
    ]
    out = run_checks(table(spark, sf, "lineitem"), checks, parents)
    return out.withColumn("observed", F.round("observed", 4))
