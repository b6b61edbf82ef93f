"""Labels and facts read out of definition texts: every document, whole, with a technical passage appended."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.functions import labels as L
from siltworks.functions import text as tx
from siltworks.operators import classify as cl
from siltworks.operators.exploding import explode_once
from siltworks.operators.scans import spread
from siltworks.plans.registry import query, table

PASSAGES = (
    "spark job reads s3://lake-a/raw/x.csv and S3A://lake-b/y via pyspark",
    "glue crawler to redshift jdbc:redshift://host-1:5439/dev?ssl=true",
    "ADF pipeline copies to databricks notebook run, mail ops.team@corp.example.com and a@b.co",
    "azure synapse with adf and abfss://cont@acct.dfs.core.windows.net/path",
    "kafka_topics = orders, bootstrap_servers=broker1:9092 StreamExecutionEnvironment",
    "airflow dag calls https://host.example/api/v1/items and graphql",
    "dbt test select * from control.config_tbl where load_type = incremental order by id",
    'great expectations suite_name: "daily" {"expectation_type": "expect_column_values_to_be_unique"}',
    "snowflake copy into @my_stage from spark",
    "assert the count where x is null between 1 and 5 duplicate check",
    "MERGE into target when watermark is old; count(*) > 10",
    "insert into audit_log select * from sales.fact join dim.day where day > 5 group by day",
    "truncate and full reload to lakehouse warehouse as parquet and json",
    "mongodb and dynamodb and kinesis firehose; a loop until done",
    "gs://bucket-g/one gs://bucket-g/two bigquery, event stream and csv",
    "soda cloud freshness_check; schema validation failed status",
    'suite_name: "nightly" {"expectation_type": "expect_column_values_to_not_be_null"} {"expectation_type": "expect_odd"}',
    "nothing to see",
)
_CASES = " ".join(f"when {i} then '{p}'" for i, p in enumerate(PASSAGES))
DEFINITION = f"text || ' ' || case doc_id % {len(PASSAGES)} {_CASES} end"
_DEFS_SQL = f"defs as (select doc_id, source, lang, {DEFINITION} as body, lower({DEFINITION}) as low from documents)"


def definitions(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "lang", F.expr(DEFINITION).alias("body"))


def _quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _label_sql(catalog, prefix: str = "") -> str:
    """concat_ws arguments: the label where any of its patterns occurs."""
    parts = []
    for name, patterns in catalog:
        tests = " or ".join(f"regexp_matches(low, {_quoted(prefix + p)})" for p in patterns)
        parts.append(f"case when {tests} then {_quoted(name)} end")
    return ", ".join(parts)


def _joined(c):
    return F.array_join(c, "|")


_FW_SQL = f"concat_ws('|', {_label_sql(L.FRAMEWORKS)})"
_COMBO_SQL = ", ".join(
    "case when " + " and ".join(f"list_contains(fw, {_quoted(r)})" for r in req) + f" then {_quoted(label)} end"
    for req, label in L.COMBINATIONS
)


@query(
    "labels_frameworks",
    sql=f"""
    with {_DEFS_SQL}, f as (select doc_id, string_split({_FW_SQL}, '|') as fw from defs)
    select doc_id, concat_ws('|', nullif(array_to_string(fw, '|'), ''), {_COMBO_SQL}) as frameworks,
      case when array_to_string(fw, '|') = '' then 0.0 else 0.95 end as confidence from f""",
)
def labels_frameworks(spark, sf):
    d = cl.with_labels(definitions(spark, sf), "body", ["frameworks"])
    return d.select("doc_id", _joined("frameworks").alias("frameworks"), cl.confidence(F.col("frameworks"), "frameworks").alias("confidence"))


@query(
    "labels_sources",
    sql=f"with {_DEFS_SQL} select doc_id, concat_ws('|', {_label_sql(L.SOURCES)}) as sources from defs",
)
def labels_sources(spark, sf):
    return cl.with_labels(definitions(spark, sf), "body", ["sources"]).select("doc_id", _joined("sources").alias("sources"))


@query(
    "labels_ingestion",
    sql=f"with {_DEFS_SQL} select doc_id, concat_ws('|', {_label_sql(L.INGESTION, '(?i)')}) as ingestion from defs",
)
def labels_ingestion(spark, sf):
    return cl.with_labels(definitions(spark, sf), "body", ["ingestion"]).select("doc_id", _joined("ingestion").alias("ingestion"))


_SUITE_SQL = "case " + " ".join(
    f"when regexp_matches(low, {_quoted(p)}) then "
    + (f"'Great Expectations Suite: ' || regexp_extract(low, {_quoted(p)}, 1)" if "([^" in p else "'Great Expectations'")
    for p in L.SUITE_PATTERNS
) + " end"
_EXP_SQL = "case t " + " ".join(f"when '{k}' then '{v}'" for k, v in L.EXPECTATIONS.items()) + " else 'GE: ' || t end"


@query(
    "labels_checks",
    sql=f"""
    with {_DEFS_SQL}, e as (
      select doc_id, {_SUITE_SQL} as suite,
        array_to_string(list_transform(regexp_extract_all(body, '"expectation_type"\\s*:\\s*"([^"]+)"', 1), lambda t : {_EXP_SQL}), '|') as exps,
        concat_ws('|', {_label_sql(L.SQL_CHECKS, '(?i)')}) as sqls, concat_ws('|', {_label_sql(L.CHECK_TOOLS, '(?i)')}) as tools from defs)
    select doc_id, concat_ws('|', suite, nullif(exps, ''), nullif(sqls, ''), nullif(tools, '')) as checks from e""",
)
def labels_checks(spark, sf):
    return cl.with_labels(definitions(spark, sf), "body", ["checks"]).select("doc_id", _joined("checks").alias("checks"))


def _evidence_sql(catalog) -> str:
    return " union all ".join(
        f"select {_quoted(n)} as label, case "
        + " ".join(f"when regexp_matches(low, {_quoted(p)}) then {_quoted(p)}" for p in ps)
        + " end as pattern from defs"
        for n, ps in catalog
    )


@query(
    "label_evidence",
    sql=f"""
    with {_DEFS_SQL}, e as ({_evidence_sql(L.SOURCES)})
    select label, pattern, count(*) as n from e where pattern is not null group by all""",
)
def label_evidence(spark, sf):
    low = spread(definitions(spark, sf)).select(F.lower("body").alias("low"))
    found = explode_once(low, [], cl.hits(F.col("low"), L.SOURCES), "h").select("h.*")
    return found.groupBy("label", "pattern").agg(F.count(F.lit(1)).alias("n"))


_CATALOG_SQL = " union all ".join(
    f"select {_quoted(n)} as name, '{'supported' if n in L.EXTRACTABLE_SOURCES else 'detected_only'}' as support_level"
    for n in dict.fromkeys([n for n, _ in L.SOURCES] + list(L.EXTRACTABLE_SOURCES))
)


@query(
    "source_support",
    sql=f"""
    with {_DEFS_SQL}, e as ({_evidence_sql(L.SOURCES)}),
    n as (select label, count(*) as n from e where pattern is not null group by 1), c as ({_CATALOG_SQL})
    select c.name, c.support_level, n.n is not null as detected, coalesce(n.n, 0) as n from c left join n on c.name = n.label""",
)
def source_support(spark, sf):
    found = explode_once(cl.with_labels(definitions(spark, sf), "body", ["sources"]), [], F.col("sources"), "label")
    return cl.support_matrix(found, "label")


@query(
    "urn_labels",
    sql="""
    with u as (select page_id, case page_id % 6 when 0 then 'urn:li:dataPlatform:glue' when 1 then
      'urn:li:dataset:(urn:li:dataPlatform:Snowflake,' || page_id || ',PROD)' when 2 then 'kafka' when 3 then 's3://x'
      when 4 then 'urn:li:dataset:(urn:li:dataPlatform:adls,p,DEV)' else url end as urn from pages)
    select page_id, case page_id % 6 when 0 then 'AWS Glue' when 1 then 'Snowflake' when 2 then 'Apache Kafka' end as framework,
      case page_id % 6 when 1 then 'Snowflake Stage' when 2 then 'Kafka Topic' when 3 then 'S3' when 4 then 'ADLS Gen2'
        else case when contains(lower(urn), 's3') then 'S3' end end as source,
      case page_id % 2 when 0 then 'AWS Glue Jobs' end as job from u""",
)
def urn_labels(spark, sf):
    u = table(spark, sf, "pages").selectExpr(
        "page_id",
        """case page_id % 6 when 0 then 'urn:li:dataPlatform:glue' when 1 then
        'urn:li:dataset:(urn:li:dataPlatform:Snowflake,' || page_id || ',PROD)' when 2 then 'kafka' when 3 then 's3://x'
        when 4 then 'urn:li:dataset:(urn:li:dataPlatform:adls,p,DEV)' else url end as urn""",
        "case page_id % 2 when 0 then 'GlueJob' else 'Other' end as kind",
    )
    c = F.col("urn")
    return u.select(
        "page_id", cl.urn_framework(c).alias("framework"), cl.urn_source(c).alias("source"), cl.job_type(F.col("kind")).alias("job")
    )


def _has(col: str, *tokens: str) -> str:
    return "(" + " or ".join(f"contains({col}, {_quoted(t)})" for t in tokens) + ")"


@query(
    "load_strategies",
    sql=f"""
    with {_DEFS_SQL}
    select doc_id, case when {_has('low', 'merge', 'upsert')} then 'merge'
      when {_has('low', 'watermark', 'incremental', 'lastmodified', 'modifieddate')} then 'incremental'
      when {_has('low', 'append', 'insert')} then 'append' when {_has('low', 'full', 'truncate')} then 'full_load' end as strategy,
      {_has('low', 'cdc', 'changefeed')} as is_cdc, {_has('low', 'truncate')} as truncates from defs""",
)
def load_strategies(spark, sf):
    primary, signals = cl.load_strategy(F.col("body"))
    return definitions(spark, sf).select(
        "doc_id", primary.alias("strategy"), signals["cdc"].alias("is_cdc"), signals["truncate"].alias("truncates")
    )


# Node types and names of each definition, by its number.
_NODES = [
    "doc_id",
    "body",
    "case doc_id % 5 when 0 then 'WebActivity' when 1 then 'ForEach' when 2 then 'IfCondition' else 'Copy' end as node_type",
    "case doc_id % 7 when 0 then 'send_email' when 1 then 'call_rest' when 2 then 'my_loop' when 3 then 'a_condition' else 'copy_' || source end as node_id",
    "case when doc_id % 3 = 0 then 'null_check' end as rule",
]
_CAPS_SQL = f"""
    {_DEFS_SQL}, n as (select low, {', '.join(_NODES)} from defs),
    caps as (select doc_id, unnest(['API Ingestion', 'File Ingestion', 'Database/Table Ingestion', 'Batch Processing', 'Streaming',
        'Data Quality', 'Notifications']) as capability,
      unnest([
        case when node_type = 'WebActivity' or {_has('node_id', 'http', 'rest')} then 'SUPPORTED' else 'NOT_SUPPORTED' end,
        case when {_has('low', *L.FILE_TOKENS)} then 'SUPPORTED' else 'NOT_SUPPORTED' end,
        case when {_has('low', *L.DATABASE_TOKENS)} then 'SUPPORTED' else 'NOT_SUPPORTED' end,
        case when node_type = 'ForEach' or {_has('node_id', 'foreach', 'loop')} then 'SUPPORTED' else 'NOT_SUPPORTED' end,
        case when {_has('low', *L.STREAM_TOKENS)} then 'SUPPORTED' else 'NOT_SUPPORTED' end,
        case when rule is not null then 'SUPPORTED' when node_type = 'IfCondition' or {_has('node_id', 'condition')} then 'PARTIAL'
          else 'NOT_SUPPORTED' end,
        case when {_has('node_id', 'email', 'alert', 'notification')} then 'SUPPORTED' else 'NOT_SUPPORTED' end]) as status from n)"""


def _capabilities(spark, sf):
    d = definitions(spark, sf).selectExpr("source", *_NODES)
    d = d.withColumns({
        "node_types": F.array("node_type"), "node_ids": F.array("node_id"), "rules": F.array_compact(F.array("rule"))
    })
    return cl.capability_matrix(d, ["doc_id"], "body", "node_types", "node_ids", "rules")


@query("capability_matrix", sql=f"with {_CAPS_SQL} select doc_id, capability, status from caps")
def capability_matrix(spark, sf):
    return _capabilities(spark, sf)


@query(
    "capability_counts",
    sql=f"""
    with {_CAPS_SQL}
    select capability, count(*) filter (where status = 'SUPPORTED') as supported_count,
      count(*) filter (where status = 'PARTIAL') as partial_count,
      count(*) filter (where status = 'NOT_SUPPORTED') as not_supported_count from caps group by 1""",
)
def capability_counts(spark, sf):
    return cl.capability_counts(_capabilities(spark, sf), ["capability"])


@query(
    "storage_kinds",
    sql=f"""
    with {_DEFS_SQL}
    select doc_id, case when {_has('low', 'http', 'rest', 'relativeurl', 'baseurl', 'webactivity')} then 'REST API'
      when {_has('low', 'warehouse', 'sql', 'jdbc', 'table')} then 'Warehouse'
      when {_has('low', 'lakehouse', 'onelake', 'deltalake', 'adls', 'blob', 'file')} then 'Lakehouse'
      when {_has('low', 'notebook')} then 'Notebook' else 'Unknown' end as kind,
      case when {_has('low', 'stream', 'eventhub', 'kafka')} then 'streaming' else 'batch' end as mode from defs""",
)
def storage_kinds(spark, sf):
    return definitions(spark, sf).select(
        "doc_id", cl.storage_kind(F.col("body")).alias("kind"), cl.ingestion_mode(F.col("body")).alias("mode")
    )


@query(
    "triggers_and_formats",
    sql=f"""
    with {_DEFS_SQL}
    select doc_id, case when doc_id % 3 = 0 then 'tumbling' when doc_id % 4 = 0 then 'schedule' end as trigger_type,
      case when doc_id % 5 = 0 then 'Daily' when doc_id % 4 = 0 then 'Hour' end as frequency,
      array_to_string(list_distinct_in_order, '|') as formats
    from (select doc_id, list_filter([case when lang = 'en' then 'JSON' end,
        case when contains(low, 'parquet') then 'PARQUET' end, case when contains(low, 'json') and lang <> 'en' then 'JSON' end,
        case when contains(low, 'csv') then 'CSV' end, case when contains(low, 'delta') then 'Delta' end], lambda x : x is not null) as list_distinct_in_order
      from defs)""",
)
def triggers_and_formats(spark, sf):
    d = definitions(spark, sf).selectExpr(
        "*",
        "case when doc_id % 3 = 0 then 'Tumbling' else ' ' end as t",
        "case when doc_id % 5 = 0 then 'Daily' end as f",
        """case when doc_id % 4 = 0 then '{"frequency": "Hour", "interval": 3}' end as recurrence""",
        "case when lang = 'en' then 'JSON' end as explicit",
    )
    trigger, frequency = cl.trigger_and_frequency([F.col("t")], [F.col("f")], F.col("recurrence"))
    formats = cl.data_formats(F.col("explicit"), F.col("body"), F.lit(None))
    return d.select("doc_id", trigger.alias("trigger_type"), frequency.alias("frequency"), _joined(formats).alias("formats"))


@query(
    "recommended_checks",
    sql=f"""
    with {_DEFS_SQL}
    select doc_id, concat_ws('|', case when {_has('low', 'watermark', 'incremental')} then 'Watermark freshness validation' end,
      case when contains(low, 'copies') then 'Copy boundary reconciliation' end,
      case when contains(low, 'notebook') then 'Notebook output validation' end,
      case when contains(low, 'https://') then 'Endpoint response validation' end) as recommended from defs""",
)
def recommended_checks(spark, sf):
    low = F.lower("body")
    flags = {
        "incremental": tx.contains_any(low, ("watermark", "incremental")), "copies": low.contains("copies"),
        "notebooks": low.contains("notebook"), "api_sources": low.contains("https://"),
    }
    return definitions(spark, sf).select("doc_id", _joined(cl.recommended_checks(flags)).alias("recommended"))


_PHRASES_SQL = ", ".join(f"case when contains(low, {_quoted(p)}) then '{v}' end" for p, v in L.CHECK_PHRASES)


@query(
    "check_phrases",
    sql=f"""
    with {_DEFS_SQL}, p as (select doc_id, lang, list_filter([{_PHRASES_SQL}], lambda x : x is not null) as l from defs),
    u as (select doc_id, lang, unnest(l) as x, generate_subscripts(l, 1) as i from p),
    f as (select doc_id, x, min(i) as i from u group by all), g as (select doc_id, string_agg(x, '|' order by i) as s from f group by 1)
    select d.doc_id, concat_ws('|', case when lang = 'en' then 'uniqueness_check:id' when lang = 'fr' then 'null_check:column' end, g.s) as rules
    from documents d left join g using (doc_id)""",
)
def check_phrases(spark, sf):
    exp = F.expr(
        """case when lang = 'en' then array(named_struct('type', 'expect_column_values_to_be_unique', 'column', 'id'))
        when lang = 'fr' then array(named_struct('type', 'expect_column_values_to_not_be_null', 'column', cast(null as string)))
        else array(named_struct('type', 'expect_odd', 'column', 'x')) end"""
    )
    return definitions(spark, sf).select("doc_id", _joined(cl.check_labels(F.col("body"), exp)).alias("rules"))


@query(
    "keyword_profiles",
    sql=f"""
    with {_DEFS_SQL}, k as (select *, {_has('low', 'csv', 'json', 'parquet', 'blob', 's3', 'adls', 'delimitedtext', 'storage')} as fb,
      {_has('low', 'webactivity', 'http', 'rest', 'graphql', 'apigateway')} as api,
      {_has('low', 'sql', 'jdbc', 'datawarehouse', 'table', 'database')} as db from defs)
    select doc_id, case when {_has('low', 'fabric', 'lakehouse')} then 'Microsoft Fabric' when {_has('low', 'databricks', 'spark')} then 'Databricks'
      when {_has('low', 'adf', 'typeproperties')} then 'Azure Data Factory' when {_has('low', 'glue', 'lambda')} then 'AWS Glue'
      else 'Azure Data Factory' end as framework,
      fb or not (fb or api or db) as file_based, api, db as database, {_has('low', 'kafka', 'eventhub', 'stream', 'kinesis')} as streaming,
      {_has('low', 'foreach', 'until', 'loop', 'batch', 'lambda')} or not (fb or api or db) as batch,
      concat_ws('|', case when {_has('low', 'csv', 'delimited')} then 'CSV' end, case when contains(low, 'json') then 'JSON' end,
        case when contains(low, 'parquet') then 'Parquet' end, case when contains(low, 'excel') then 'Excel' end) as file_types,
      {_has('low', 'schema', 'validation', 'datatype')} as schema_check, {_has('low', 'null')} as null_check,
      {_has('low', 'duplicate', 'distinct')} as duplicate_check, {_has('low', 'datatype', 'cast')} as type_check from k""",
)
def keyword_profiles(spark, sf):
    p = cl.keyword_profile(F.col("body"))
    p["file_types"] = _joined(p["file_types"])
    return definitions(spark, sf).select("doc_id", *[c.alias(n) for n, c in p.items()])


@query(
    "email_addresses",
    sql=rf"""
    with {_DEFS_SQL}, e as (select doc_id, list_sort(list_distinct(regexp_extract_all(body, '[\w.-]+@[\w.-]+\.\w+'))) as l from defs)
    select doc_id, array_to_string(l, ',') as emails from e where len(l) > 0""",
)
def email_addresses(spark, sf):
    d = definitions(spark, sf).select("doc_id", tx.emails(F.col("body")).alias("e"))
    return d.where(F.size("e") > 0).select("doc_id", F.array_join("e", ",").alias("emails"))


@query(
    "sql_statements",
    sql=rf"""
    with {_DEFS_SQL}, s as (select doc_id, body, low, regexp_extract_all(body, '(?i)(?:from|join)\s+([A-Za-z0-9_.\[\]]+)', 1) as t
      from defs where contains(low, 'select'))
    select doc_id, coalesce(t[1], 'UNKNOWN') as config_table, array_to_string(t, '|') as tables,
      trim(regexp_extract(body, '(?is)\bwhere\b\s+(.+?)(?:\border\b|\bgroup\b|$)', 1)) as filter_logic,
      case when regexp_matches(lower(t[1]), 'config|control|metadata') then 'Metadata-driven ingestion controller'
        when regexp_matches(lower(t[1]), 'audit|status|log') then 'Audit/status tracking'
        when regexp_matches(low, 'watermark|incremental') then 'Incremental load control' else 'Operational SQL' end as purpose
    from s""",
)
def sql_statements(spark, sf):
    out = tx.sql_analysis(definitions(spark, sf), "body")
    return out.select("doc_id", "config_table", _joined("tables").alias("tables"), "filter_logic", "purpose")


# Statements over the given rows: (statement, tables, condition, purpose), SQL texts over event_id, user_id and event_type.
_STATEMENTS = (
    ("'select * from control.' || event_type || '_tbl -- from hidden' || chr(10) || 'where id = ' || event_id || ' order by id'",
     "'control.' || event_type || '_tbl'", "'id = ' || event_id", "Metadata-driven ingestion controller"),
    ("'with c as (select * from [raw].' || event_type || ') select * from c join dim_' || user_id || ' using (i) where x in (select y from z where y > 0)'",
     "'[raw].' || event_type || '|dim_' || user_id || '|z'", "'x in (select y from z where y > 0)'", "Operational SQL"),
    ("'select ~from audit~, extract(day from ts) from /* join b */ ' || event_type || ' a, status_log where k = ~where ' || user_id || '~ group by k'",
     "event_type || '|status_log'", "'k = ~where ' || user_id || '~'", "Operational SQL"),
    ("'delete from audit_log where watermark < ' || event_id", "'audit_log'", "'watermark < ' || event_id", "Audit/status tracking"),
    ("'select max(watermark) from (select * from t' || user_id || ') s union all select 1 from range(3)'", "'t' || user_id", "''", "Incremental load control"),
    ("'select ' || event_id", "''", "''", "Operational SQL"),
)


def _statement(part: int) -> str:
    cases = " ".join(f"when {i} then {x[part] if part < 3 else chr(39) + x[part] + chr(39)}" for i, x in enumerate(_STATEMENTS))
    return f"replace(case event_id % {len(_STATEMENTS)} {cases} end, '~', chr(39))"


@query(
    "sql_statements_scanned",
    sql=f"""
    select event_id, coalesce(nullif(split_part({_statement(1)}, '|', 1), ''), 'UNKNOWN') as config_table, {_statement(1)} as tables,
      {_statement(2)} as filter_logic, {_statement(3)} as purpose from events""",
)
def sql_statements_scanned(spark, sf):
    """Statements with comments, strings, common table expressions, derived tables and functions: what each reads."""
    out = tx.sql_reading(table(spark, sf, "events").select("event_id", F.expr(_statement(0)).alias("body")), "body")
    return out.select("event_id", "config_table", _joined("tables").alias("tables"), "filter_logic", "purpose")


@query(
    "expression_references",
    sql="""
    select event_id,
      case event_id % 7 when 0 then 'activity' when 1 then 'concat,item' when 2 then 'variables' when 3 then 'equals,parameters,pipeline'
        when 4 then 'formatdatetime,utcnow' when 5 then 'greater,if' else '' end as functions,
      case event_id % 7 when 0 then 'Load ' || event_type else '' end as activities,
      case event_id % 7 when 2 then 'v1' else '' end as variables,
      case event_id % 7 when 3 then 'day,p' else '' end as parameters,
      case event_id % 7 when 1 then 'TableName,file_path' else '' end as item_fields,
      case event_id % 7 when 1 then 'TableName' else '' end as table_fields,
      case event_id % 7 when 1 then 'TableName,file_path' else '' end as file_fields,
      case event_id % 7 when 0 then 'activity_output_reference' when 1 then 'foreach_item_reference' when 2 then 'variable_reference'
        when 3 then 'parameter_reference' when 4 then 'dynamic_value_builder' when 5 then 'branch_condition'
        else 'runtime_expression' end as classification
    from events""",
)
def expression_references(spark, sf):
    e = F.expr(
        """case event_id % 7 when 0 then concat("@activity('Load ", event_type, "').output")
        when 1 then "@concat(item().TableName, item().file_path)" when 2 then "@variables('v1')"
        when 3 then "@equals(pipeline().parameters.day, parameters('p'))" when 4 then "@formatDateTime(utcnow())"
        when 5 then "@if(greater(1, 2), 3, 4)" else "plain" end"""
    )
    refs = tx.expression_references(F.col("e"))
    out = table(spark, sf, "events").select("event_id", e.alias("e"))
    return out.select(
        "event_id", *[(c if n == "classification" else F.array_join(c, ",")).alias(n) for n, c in refs.items()]
    )


@query(
    "connection_parts",
    sql=rf"""
    with {_DEFS_SQL}
    select doc_id, nullif(regexp_extract(body, '(?i)s3[an]?://([^/\s"''>,]+)', 1), '') as s3_bucket,
      nullif(regexp_extract(body, '(?i)abfss?://([^@]+)@', 1), '') as adls_container,
      nullif(regexp_extract(body, '(?i)gs://([^/]+)', 1), '') as gcs_bucket,
      nullif(regexp_extract(body, '(?i)jdbc:[a-z]+://[^\s"''>,]+'), '') as jdbc_url,
      nullif(regexp_extract(body, '(?i)jdbc:redshift://([^:/]+)', 1), '') as redshift_host,
      case when contains(low, 'jdbc:redshift') then 'dev' end as redshift_database,
      case when contains(low, 'bootstrap_servers') then 'broker1:9092' end as brokers,
      array_to_string(regexp_extract_all(body, '(?i)kafka[._-]topics?\s*[=:]\s*[''"]?([^\s"'',]+)', 1), '|') as topics,
      array_to_string(regexp_extract_all(body, '(?i)https?://[^\s"''>,]*api[^\s"''>,]*'), '|') as api_urls
    from defs""",
)
def connection_parts(spark, sf):
    p = tx.connection_parts(F.col("body"))
    p["topics"], p["api_urls"] = _joined(p["topics"]), _joined(p["api_urls"])
    return definitions(spark, sf).select("doc_id", *[c.alias(n) for n, c in p.items()])


@query(
    "storage_paths",
    sql=rf"""
    with {_DEFS_SQL}
    select doc_id, array_to_string(regexp_extract_all(body, '(?i)s3[an]?://[^\s"''>,]+'), '|') as s3_paths,
      array_to_string(regexp_extract_all(body, '(?i)abfss?://[^\s"''>,]+'), '|') as adls_paths,
      array_to_string(regexp_extract_all(body, '(?i)gs://[^\s"''>,]+'), '|') as gcs_paths from defs""",
)
def storage_paths(spark, sf):
    return definitions(spark, sf).select("doc_id", *[_joined(c).alias(n) for n, c in tx.storage_paths(F.col("body")).items()])


@query(
    "storage_buckets",
    sql=rf"""
    with {_DEFS_SQL}, p as (select source, unnest(regexp_extract_all(body, '(?i)s3[an]?://[^\s"''>,]+')) as path from defs)
    select source, regexp_extract(path, '(?i)s3[an]?://([^/]+)', 1) as bucket, count(*) as path_count from p group by all""",
)
def storage_buckets(spark, sf):
    return cl.bucket_counts(definitions(spark, sf), "body", ["source"])


@query(
    "nested_key_values",
    sql="""
    select event_id, case event_id % 3 when 0 then regexp_extract(props, '[0-9]+') when 1 then '7|' || regexp_extract(props, '[0-9]+')
      else '' end as ks from events""",
)
def nested_key_values(spark, sf):
    doc = F.expr(
        """case event_id % 3 when 0 then '{"a": [{"b": ' || props || '}]}' when 1 then '[{"K": 7}, ' || props || ']'
        else '{"x": {"y": []}}' end"""
    )
    return table(spark, sf, "events").select("event_id", _joined(tx.key_values(doc, "k")).alias("ks"))


@query(
    "nested_key_values_deep",
    sql="select event_id, regexp_extract(props, '[0-9]+') as ks from events",
)
def nested_key_values_deep(spark, sf):
    """The value stands fifteen levels down."""
    doc = F.concat(F.lit('{"a":[' * 7), F.col("props"), F.lit("]}" * 7))
    return table(spark, sf, "events").select("event_id", _joined(tx.key_values(doc, "K")).alias("ks"))


@query(
    "flattened_structs",
    sql="select event_id, event_type as \"a.kind\", value as \"a.v.amount\", user_id as \"a.v.who\" from events",
)
def flattened_structs(spark, sf):
    nested = table(spark, sf, "events").selectExpr(
        "event_id", "named_struct('kind', event_type, 'v', named_struct('amount', value, 'who', user_id)) as a"
    )
    return tx.flatten_struct(nested)


@query(
    "ordered_distinct_texts",
    sql="""
    select o_orderkey, case when o_orderstatus = 'F' then 'F' else o_orderstatus || '|F' end as seen,
      case when o_orderstatus = 'F' then 1 else 2 end as kept from orders""",
)
def ordered_distinct_texts(spark, sf):
    values = F.array("o_orderstatus", F.lit(None), F.lit(""), F.lit("F"), "o_orderstatus")
    filled = F.create_map(F.lit("s"), F.col("o_orderstatus"), F.lit("f"), F.when(F.col("o_orderstatus") != "F", "x").otherwise(""), F.lit("n"), F.lit(None).cast("string"))
    return table(spark, sf, "orders").select(
        "o_orderkey", _joined(tx.distinct_texts(values)).alias("seen"), F.size(tx.drop_empty(filled)).alias("kept")
    )
