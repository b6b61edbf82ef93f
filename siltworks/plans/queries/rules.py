"""Data-quality rules over the given tables, with defects injected by the same expression on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.functions.rules import Rule
from siltworks.operators import dq
from siltworks.plans.registry import query, table

# Event rows with a share of nulls, blanks, bad numbers and broken JSON; the text is valid in both dialects.
DIRTY_EVENTS = [
    "event_id",
    "case when event_id % 17 = 0 then null when event_id % 19 = 0 then '  ' else event_type end as event_type",
    "case when event_id % 23 = 0 then 'abc' when event_id % 31 = 0 then '1e3' when event_id % 37 = 0 then '7.5' "
    "else cast(user_id as varchar(20)) end as user_text",
    "case when event_id % 29 = 0 then '{' else props end as props",
    "case when event_id % 41 = 0 then 'yes' when event_id % 2 = 0 then 'TRUE' else 'False' end as flag_text",
    "value",
]
DIRTY_EVENTS_SQL = f"dirty as (select {', '.join(DIRTY_EVENTS)} from events)"

# Text numbers as the INTEGER cast reads them: whole numbers in any spelling.
_INT = (
    "case when regexp_full_match(user_text, '[0-9]+') then cast(user_text as bigint) "
    "when user_text = '1e3' then 1000 end"
)


def dirty_events(spark, sf):
    return table(spark, sf, "events").selectExpr(*DIRTY_EVENTS)


def flagged_counts(flagged):
    """Rows, rejected rows and warnings of a flagged table."""
    return dq.split_counts(flagged)


@query(
    "cast_standard_types",
    sql=f"""
    with {DIRTY_EVENTS_SQL}
    select event_id, {_INT} as as_integer,
      case when user_text = 'abc' then null else cast(user_text as double) end as as_float,
      case lower(flag_text) when 'true' then true when 'false' then false end as as_boolean
    from dirty where user_text is not null""",
)
def cast_standard_types(spark, sf):
    from pyspark.sql import types as T

    from siltworks.functions.casts import to_boolean, to_float, to_integer

    s = T.StringType()
    return (
        dirty_events(spark, sf)
        .where("user_text is not null")
        .select(
            "event_id",
            to_integer(F.col("user_text"), s).alias("as_integer"),
            to_float(F.col("user_text"), s).alias("as_float"),
            to_boolean(F.col("flag_text"), s).alias("as_boolean"),
        )
    )


@query(
    "cast_timestamps",
    sql="""
    select event_id, case when event_id % 13 = 0 then null else date_trunc('second', ts) end as parsed
    from events""",
)
def cast_timestamps(spark, sf):
    from pyspark.sql import types as T

    from siltworks.functions.casts import to_timestamp

    text = F.expr("case when event_id % 13 = 0 then 'soon' else date_format(ts, 'yyyy-MM-dd HH:mm:ss') end")
    e = table(spark, sf, "events").select("event_id", text.alias("t"))
    return e.select("event_id", to_timestamp(F.col("t"), T.StringType()).alias("parsed"))


@query(
    "dq_cast_fail",
    sql=f"""
    with {DIRTY_EVENTS_SQL}
    select count(*) as rows_read,
      count(*) filter (where {_INT} is null and user_text is not null) as failed_rows,
      count(*) filter (where not ({_INT} is null and user_text is not null)) as valid_rows,
      cast(0 as bigint) as warnings
    from dirty""",
)
def dq_cast_fail(spark, sf):
    return flagged_counts(dq.flag(dirty_events(spark, sf), [Rule("user_text", "INTEGER", "RANGE", "ERROR", ":")]))


@query(
    "dq_not_null",
    sql=f"""
    with {DIRTY_EVENTS_SQL}
    select event_id, event_type from dirty where event_type is null or trim(event_type) = ''""",
)
def dq_not_null(spark, sf):
    flagged = dq.flag(dirty_events(spark, sf), [Rule("event_type", "STRING", "NOT_NULL", "ERROR")])
    return dq.rejected_rows(flagged).select("event_id", "event_type")


@query(
    "dq_unique",
    sql="""
    select doc_id from documents where text in (select text from documents group by text having count(*) > 1)""",
)
def dq_unique(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return dq.rejected_rows(dq.flag(docs, [Rule("text", "STRING", "UNIQUE", "BLOCK")])).select("doc_id")


@query(
    "dq_unique_nulls_and_hot_key",
    sql=f"""
    with {DIRTY_EVENTS_SQL}, k as (
      select event_id, case when event_id % 3 = 0 then null when event_id % 3 = 1 then 'hot'
        else cast(event_id / 4 as varchar) end as k
      from (select cast(event_id as bigint) as event_id from dirty)),
    k2 as (select event_id, case when event_id % 3 = 2 then cast(event_id // 4 as varchar) else k end as k from k),
    n as (select k, count(*) as n from k2 group by k)
    select event_id from k2 join n on k2.k is not distinct from n.k where n.n > 1""",
)
def dq_unique_nulls_and_hot_key(spark, sf):
    k = (
        "case when event_id % 3 = 0 then null when event_id % 3 = 1 then 'hot' "
        "else cast(event_id div 4 as string) end as k"
    )
    events = table(spark, sf, "events").selectExpr("event_id", k)
    return dq.rejected_rows(dq.flag(events, [Rule("k", "STRING", "UNIQUE", "ERROR")])).select("event_id")


@query(
    "dq_range",
    sql="""
    select l_returnflag, count(*) as out_of_range from lineitem
    where l_quantity < 5 or l_quantity > 45 group by l_returnflag""",
)
def dq_range(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity")
    flagged = dq.flag(li, [Rule("l_quantity", "FLOAT", "RANGE", "ERROR", "5:45")])
    return dq.rejected_rows(flagged).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("out_of_range"))


@query(
    "dq_regex",
    sql="""
    select o_orderpriority, count(*) as mismatches from orders
    where not regexp_matches(o_orderpriority, '^(?:[1-3]-[A-Z]+)') group by o_orderpriority""",
)
def dq_regex(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderpriority")
    flagged = dq.flag(orders, [Rule("o_orderpriority", "STRING", "REGEX", "ERROR", "[1-3]-[A-Z]+")])
    return dq.rejected_rows(flagged).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("mismatches"))


@query(
    "dq_allowed_values",
    sql="""
    select c_mktsegment, count(*) as refused from customer
    where c_mktsegment not in ('BUILDING', 'MACHINERY', 'HOUSEHOLD') group by c_mktsegment""",
)
def dq_allowed_values(spark, sf):
    rule = Rule("c_mktsegment", "STRING", "CUSTOM", "ERROR", "ALLOWED_VALUES=BUILDING, MACHINERY, HOUSEHOLD")
    flagged = dq.flag(table(spark, sf, "customer").select("c_mktsegment"), [rule])
    return dq.rejected_rows(flagged).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("refused"))


@query("dq_negative", sql="select c_custkey, c_acctbal from customer where c_acctbal < 0")
def dq_negative(spark, sf):
    rule = Rule("c_acctbal", "FLOAT", "CUSTOM", "BLOCK", "NEGATIVE_CHECK=true")
    flagged = dq.flag(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), [rule])
    return dq.rejected_rows(flagged).select("c_custkey", "c_acctbal")


@query(
    "dq_referential",
    sql="""
    select o_orderkey from orders
    where o_custkey not in (select c_custkey from customer where c_mktsegment <> 'BUILDING')""",
)
def dq_referential(spark, sf):
    parents = {"customer.c_custkey": table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'")}
    rule = Rule("o_custkey", "INTEGER", "REFERENTIAL", "ERROR", "customer.c_custkey")
    flagged = dq.flag(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), [rule], parents)
    return dq.rejected_rows(flagged).select("o_orderkey")


@query(
    "dq_valid_json",
    sql=f"with {DIRTY_EVENTS_SQL} select event_id from dirty where props is not null and not json_valid(props)",
)
def dq_valid_json(spark, sf):
    flagged = dq.flag(dirty_events(spark, sf), [Rule("props", "STRING", "VALID_JSON", "ERROR")])
    return dq.rejected_rows(flagged).select("event_id")


# A rule set that mixes severities, several rules per column, an incomplete row and a malformed range.
MIXED_RULES = [
    Rule("event_type", "STRING", "NOT_NULL", "ERROR"),
    Rule("event_type", "STRING", "CUSTOM", "WARN", "ALLOWED_VALUES=click, view, purchase"),
    Rule("user_text", "INTEGER", "RANGE", "WARN", "10:"),
    Rule("user_text", "INTEGER", "NOT_NULL", "INFO"),
    Rule("user_text", "INTEGER", "UNIQUE", "INFO"),
    Rule("value", "FLOAT", "RANGE", "BLOCK", ":95"),
    Rule("value", "FLOAT", "RANGE", "ERROR", "abc"),
    Rule("flag_text", "BOOLEAN", "NOT_NULL", "WARN"),
    Rule("props", "STRING", "VALID_JSON", "ERROR"),
    Rule("value", None, "NOT_NULL", None),
]
_MIXED_SQL = f"""
    {DIRTY_EVENTS_SQL},
    typed as (select *, {_INT} as u,
      case lower(flag_text) when 'true' then true when 'false' then false end as f from dirty),
    dup as (select u as du, count(*) as n from typed group by u),
    m as (select typed.*,
      event_type is null or trim(event_type) = '' as r0,
      coalesce(event_type not in ('click', 'view', 'purchase'), false) as r1,
      user_text is not null and u is null as cu,
      coalesce(u < 10, false) as r2, u is null as r3, dup.n > 1 as r4,
      coalesce(value > 95, false) as r5,
      flag_text is not null and f is null as cf, f is null as r7,
      props is not null and not json_valid(props) as r8
      from typed join dup on typed.u is not distinct from dup.du)
"""


@query(
    "dq_split",
    sql=f"""
    with {_MIXED_SQL}
    select count(*) as rows_read,
      count(*) filter (where r0 or r5 or r8) as failed_rows,
      count(*) filter (where not (r0 or r5 or r8)) as valid_rows,
      cast(sum(r1::int + 3 * cu::int + r2::int + r3::int + r4::int + cf::int + r7::int) as bigint) as warnings
    from m""",
)
def dq_split(spark, sf):
    return flagged_counts(dq.flag(dirty_events(spark, sf), MIXED_RULES))


@query(
    "dq_valid_rows",
    sql=f"""
    with {_MIXED_SQL}
    select event_id, event_type, u as user_text, props, f as flag_text, value from m where not (r0 or r5 or r8)""",
)
def dq_valid_rows(spark, sf):
    return dq.valid_rows(dq.flag(dirty_events(spark, sf), MIXED_RULES))


@query(
    "dq_rejected",
    sql=f"""
    with {_MIXED_SQL}
    select event_id, event_type, u as user_text, props, f as flag_text, value,
      concat_ws('|', case when r0 then 'NOT_NULL' end, case when r5 then 'RANGE' end,
        case when r8 then 'VALID_JSON' end) as failed
    from m where r0 or r5 or r8""",
)
def dq_rejected(spark, sf):
    rejected = dq.rejected_rows(dq.flag(dirty_events(spark, sf), MIXED_RULES))
    return rejected.withColumn("failed", F.array_join("_dq_failed", "|")).drop("_dq_failed")


@query(
    "dq_details",
    sql=f"""
    with {_MIXED_SQL},
    hits as (
      select 0 as rule_id, 'NOT_NULL' as rule, 'violations' as bucket, event_type as s from m where r0
      union all select 1, 'CUSTOM', 'warnings', event_type from m where r1
      union all select 2, 'CAST_FAIL', 'warnings', user_text from m where cu
      union all select 2, 'RANGE', 'warnings', user_text from m where r2
      union all select 3, 'CAST_FAIL', 'warnings', user_text from m where cu
      union all select 3, 'NOT_NULL', 'warnings', user_text from m where r3
      union all select 4, 'CAST_FAIL', 'warnings', user_text from m where cu
      union all select 4, 'UNIQUE', 'warnings', user_text from m where r4
      union all select 5, 'RANGE', 'violations', cast(value as varchar) from m where r5
      union all select 7, 'CAST_FAIL', 'warnings', flag_text from m where cf
      union all select 7, 'NOT_NULL', 'warnings', flag_text from m where r7
      union all select 8, 'VALID_JSON', 'violations', props from m where r8),
    ranked as (select *, row_number() over (partition by rule_id, rule order by s nulls last) as rn from hits)
    select bucket, rule_id,
      ['event_type', 'event_type', 'user_text', 'user_text', 'user_text', 'value', 'value', 'flag_text', 'props']
        [rule_id + 1] as column_name,
      rule,
      case when rule = 'CAST_FAIL' then case when rule_id = 7 then 'BOOLEAN' else 'INTEGER' end end as expected,
      count(*) as n, coalesce(string_agg(s, '|' order by rn) filter (where rn <= 5 and s is not null), '') as samples
    from ranked group by bucket, rule_id, rule""",
)
def dq_details(spark, sf):
    report = dq.details(dq.flag(dirty_events(spark, sf), MIXED_RULES), MIXED_RULES)
    return report.select(
        "bucket",
        "rule_id",
        F.col("column").alias("column_name"),
        "rule",
        "expected",
        F.col("count").alias("n"),
        F.array_join("samples", "|").alias("samples"),
    )


@query(
    "dq_segment_summary",
    sql="""
    select c_mktsegment, count(*) filter (where c_acctbal >= 0) as valid_rows,
      count(*) filter (where c_acctbal < 0) as rejected_rows,
      count(*) filter (where c_mktsegment not in ('BUILDING', 'MACHINERY', 'HOUSEHOLD')) as warnings
    from customer group by c_mktsegment""",
)
def dq_segment_summary(spark, sf):
    """The flagship: customers per segment that pass, fail or warn."""
    rules = [
        Rule("c_acctbal", "FLOAT", "CUSTOM", "ERROR", "NEGATIVE_CHECK=true"),
        Rule("c_mktsegment", "STRING", "CUSTOM", "WARN", "ALLOWED_VALUES=BUILDING,MACHINERY,HOUSEHOLD"),
        Rule("c_custkey", "INTEGER", "UNIQUE", "BLOCK"),
    ]
    customers = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    flagged = dq.flag(customers, rules)
    return flagged.groupBy("c_mktsegment").agg(
        F.count_if(~F.col(dq.INVALID)).alias("valid_rows"),
        F.count_if(F.col(dq.INVALID)).alias("rejected_rows"),
        F.sum(dq.WARNINGS).cast("bigint").alias("warnings"),
    )


@query(
    "dq_no_rules",
    sql="select count(*) as rows_read, cast(0 as bigint) as failed_rows, count(*) as valid_rows, "
    "cast(0 as bigint) as warnings from part",
)
def dq_no_rules(spark, sf):
    return flagged_counts(dq.flag(table(spark, sf, "part"), []))


# Nineteen- and twenty-digit texts: the last two digits are lost by a double.
_LONG_IDS = [
    "o_orderkey",
    "case o_orderkey % 4 when 0 then '99999999999999999999' when 1 then '12345678901234' || lpad(cast(o_orderkey as varchar(20)), 5, '0') "
    "when 2 then '922337203685477' || lpad(cast(o_orderkey % 5808 as varchar(20)), 4, '0') else cast(o_orderkey as varchar(20)) end as id_text",
]
_LONG_IDS_SQL = f"ids as (select {', '.join(_LONG_IDS)} from orders)"


def long_ids(spark, sf):
    return table(spark, sf, "orders").selectExpr(*_LONG_IDS)


@query(
    "cast_long_integers",
    sql=f"with {_LONG_IDS_SQL} select o_orderkey, try_cast(id_text as bigint) as id, try_cast(id_text as bigint) is null as failed from ids",
)
def cast_long_integers(spark, sf):
    from pyspark.sql import types as T

    from siltworks.functions.casts import to_integer

    value = to_integer(F.col("id_text"), T.StringType())
    return long_ids(spark, sf).select("o_orderkey", value.alias("id"), value.isNull().alias("failed"))


@query(
    "dq_unique_long_integers",
    sql=f"""
    with {_LONG_IDS_SQL}, n as (select try_cast(id_text as bigint) as id, count(*) as n from ids group by 1)
    select i.o_orderkey from ids i left join n on n.id = try_cast(i.id_text as bigint)
    where try_cast(i.id_text as bigint) is null or n.n > 1""",
)
def dq_unique_long_integers(spark, sf):
    """Ids that a bigint cannot hold are cast failures; of the others only equal ones repeat."""
    rules = [Rule("id_text", "INTEGER", "UNIQUE", "ERROR")]
    return dq.rejected_rows(dq.flag(long_ids(spark, sf), rules)).select("o_orderkey")


@query(
    "dq_many_keys",
    sql="""
    with k as (
      select l_orderkey, l_linenumber,
        count(*) over (partition by l_orderkey) > 1 as a, count(*) over (partition by l_partkey) > 1 as b, count(*) over (partition by l_suppkey) > 1 as c,
        count(*) over (partition by l_comment_key) > 1 as d, l_partkey not in (select p_partkey from part where p_partkey % 7 <> 0) as e
      from (select *, l_orderkey * 7 + l_linenumber as l_comment_key from lineitem))
    select count(*) as rows_read, count(*) filter (where a or d) as failed_rows, count(*) filter (where not (a or d)) as valid_rows,
      cast(sum(case when b then 1 else 0 end + case when c then 1 else 0 end + case when e then 1 else 0 end) as bigint) as warnings from k""",
)
def dq_many_keys(spark, sf):
    """Four UNIQUE rules and one REFERENTIAL rule on one table."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    li = li.withColumn("l_comment_key", F.col("l_orderkey") * 7 + F.col("l_linenumber"))
    parts = table(spark, sf, "part").where("p_partkey % 7 <> 0")
    rules = [
        Rule("l_orderkey", "INTEGER", "UNIQUE", "ERROR"), Rule("l_partkey", "INTEGER", "UNIQUE", "WARN"), Rule("l_suppkey", "INTEGER", "UNIQUE", "WARN"),
        Rule("l_comment_key", "INTEGER", "UNIQUE", "BLOCK"), Rule("l_partkey", "INTEGER", "REFERENTIAL", "WARN", "part.p_partkey"),
    ]
    return flagged_counts(dq.flag(li, rules, {"part.p_partkey": parts}))


@query(
    "dq_missing_column",
    sql="""
    select o_orderstatus, cast(null as varchar) as approved_by, count(*) as rows, count(*) filter (where o_totalprice >= 400000) as failed_rows, count(*) as warnings
    from orders group by o_orderstatus""",
)
def dq_missing_column(spark, sf):
    """A rule names a column that the orders lack: it is there afterwards, empty, and its NOT_NULL warns on every row."""
    rules = [Rule("approved_by", "STRING", "NOT_NULL", "WARN"), Rule("o_totalprice", "FLOAT", "RANGE", "ERROR", ":399999.99")]
    flagged = dq.flag(table(spark, sf, "orders"), rules)
    return flagged.groupBy("o_orderstatus", F.col("approved_by").cast("string").alias("approved_by")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(dq.INVALID).alias("failed_rows"), F.sum(dq.WARNINGS).alias("warnings")
    )


@query(
    "dq_registered_rules",
    sql="""
    select l_returnflag, count(*) as rows, count(*) filter (where l_quantity % 5 <> 0) as failed_rows, count(*) filter (where l_shipdate < l_commitdate_floor) as warnings
    from (select *, timestamp '1995-01-01' as l_commitdate_floor from lineitem) group by l_returnflag""",
)
def dq_registered_rules(spark, sf):
    """A row rule and a keyword of the CUSTOM rule that the caller adds, used on the line items and taken away again."""
    from siltworks.functions.rules import register_rule, unregister_rule

    register_rule("MULTIPLE_OF", lambda c, kind, value: c.isNotNull() & (c % F.lit(float(value)) != 0))
    register_rule("NOT_BEFORE", lambda c, kind, value: c < F.lit(value).cast("timestamp"), custom=True)
    try:
        rules = [Rule("l_quantity", "FLOAT", "MULTIPLE_OF", "ERROR", "5"), Rule("l_shipdate", "TIMESTAMP", "CUSTOM", "WARN", "NOT_BEFORE=1995-01-01")]
        flagged = dq.flag(table(spark, sf, "lineitem"), rules)
    finally:
        unregister_rule("MULTIPLE_OF")
        unregister_rule("NOT_BEFORE", custom=True)
    return flagged.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(dq.INVALID).alias("failed_rows"), F.sum(dq.WARNINGS).alias("warnings")
    )
