"""Catalog jobs: every page of the site is a dataset, its host the client, its path the file."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.operators import catalog as cat
from siltworks.operators import upsert as up
from siltworks.plans.queries.texts import _DEFS_SQL, definitions
from siltworks.plans.registry import query, table
from siltworks.plans.scratch import scratch_path
from siltworks.sources import inventory
from siltworks.sources.readers import read_delimited

_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_PATH = "regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1)"
_LANG = "regexp_extract(url, '/([a-z]{2})/', 1)"
NOW_TEXT = "2024-01-02 03:04:05"


def now():
    return F.lit(NOW_TEXT).cast("timestamp")



@query(
    "catalog_from_inventory",
    sql=f"""
    with p as (select {_HOST} as client, url as path, length(html) as n, regexp_extract(url, '([^/]*)$', 1) as name from pages)
    select sha256(lower(client) || 'S3' || lower(path)) as dataset_id, client || '_' || replace(replace(path, '/', '_'), '.', '_') as pipeline_id,
      client as client_name, 'landing' as source_folder, name as source_object,
      case when contains(name, '.') then upper(regexp_extract(name, '([^.]*)$', 1)) else 'UNKNOWN' end as file_format, path as raw_layer_path,
      'az://lake/Bronze/' || client || '/' || path || '/' as target_layer_bronze, false as is_active, 'B1' as last_seen_batch from p""",
)
def catalog_from_inventory(spark, sf):
    files = table(spark, sf, "pages").select(F.col("url").alias("path"), F.length("html").cast("bigint").alias("length"), F.expr(_HOST).alias("client"))
    inv = inventory.describe(files, F.col("client"), F.lit("S3"))
    rows = cat.catalog_rows(inv, F.lit("landing"), "B1", "az://lake", now())
    return rows.select(
        "dataset_id", "pipeline_id", "client_name", "source_folder", "source_object", "file_format", "raw_layer_path",
        "target_layer_bronze", "is_active", "last_seen_batch",
    )


# A catalog with one row per document, as it stands and as it arrives again.
_EXISTING = [
    "cast(doc_id as varchar(20)) as dataset_id", "'p' || doc_id as pipeline_id", "source as client_name",
    "case when lang = 'en' then 'S3' when lang = 'fr' then 'adls' else 'LOCAL' end as source_type",
    "lang || '/' || source as source_folder", "'f' || doc_id || '.csv' as source_object", "'CSV' as file_format",
    "'raw/' || lang as raw_layer_path", "'Bronze/' || source as target_layer_bronze", "'Silver/' || source as target_layer_silver",
    "n_chars % 2 = 0 as is_active", "case when doc_id % 3 = 0 then 'INCREMENTAL' end as load_type",
    "case when doc_id % 3 = 0 then 'id' end as upsert_key", "cast(null as varchar(20)) as watermark_column",
    "cast(null as varchar(20)) as partition_column", "'B0' as last_seen_batch",
]


def existing_catalog(spark, sf):
    return table(spark, sf, "documents").selectExpr(
        *_EXISTING, "timestamp '2023-01-01 00:00:00' as created_at", "cast(null as timestamp) as updated_at"
    )


# Labelled documents arrive again, toxic ones under new ids, low-quality ones without an id.
_ARRIVING_SQL = f"""
    existing as (select {', '.join(_EXISTING)} from documents),
    arriving as (select l.doc_id as ord, case when quality = 0 then ' ' when toxic = 1 then 'new' || l.doc_id else ' ' || l.doc_id || ' ' end as dataset_id,
      'q' || l.doc_id as pipeline_id, case when l.doc_id % 2 = 0 then 'FULL' else ' ' end as load_type,
      case when l.doc_id % 5 = 0 then 'yes' end as is_active from labels l)"""


def arriving(spark, sf):
    return table(spark, sf, "labels").selectExpr(
        "doc_id as ord",
        "case when quality = 0 then ' ' when toxic = 1 then 'new' || doc_id else ' ' || doc_id || ' ' end as dataset_id",
        "'q' || doc_id as pipeline_id", "'c' as client_name", "'S3' as source_type", "'f' as source_folder", "'o' as source_object",
        "'CSV' as file_format", "'r' as raw_layer_path", "'b' as target_layer_bronze", "'s' as target_layer_silver",
        "'B1' as last_seen_batch", "case when doc_id % 2 = 0 then 'FULL' else ' ' end as load_type",
        "'' as upsert_key", "cast(null as string) as watermark_column", "'day' as partition_column",
        "case when doc_id % 5 = 0 then 'yes' end as is_active",
    )


@query(
    "catalog_merge",
    sql=f"""
    with {_ARRIVING_SQL}, a as (select *, trim(dataset_id) as id from arriving where trim(dataset_id) <> '')
    select coalesce(e.dataset_id, a.id) as dataset_id, case when a.id is null then e.pipeline_id else a.pipeline_id end as pipeline_id,
      coalesce(nullif(trim(a.load_type), ''), e.load_type) as load_type, e.upsert_key as upsert_key,
      case when a.id is not null then 'day' end as partition_column,
      coalesce(case when a.is_active = 'yes' then true end, e.is_active, false) as is_active,
      case when a.id is null then 'B0' else 'B1' end as last_seen_batch, e.dataset_id is null as created_now,
      e.dataset_id is not null and a.id is not null as updated_now,
      case when e.dataset_id is null then 'insert' when a.id is not null then 'update' else 'keep' end as action
    from existing e full outer join a on e.dataset_id = a.id""",
)
def catalog_merge(spark, sf):
    merged = cat.merge_catalog(existing_catalog(spark, sf), arriving(spark, sf), "ord", now())
    return merged.select(
        "dataset_id", "pipeline_id", "load_type", "upsert_key", "partition_column", "is_active", "last_seen_batch",
        (F.col("created_at") == now()).alias("created_now"), F.col("updated_at").isNotNull().alias("updated_now"), "action",
    )


@query(
    "catalog_merge_counts",
    sql=f"""
    with {_ARRIVING_SQL}
    select case when trim(dataset_id) = '' then 'skip' when dataset_id like 'new%' then 'insert' else 'update' end as action, count(*) as n
    from arriving group by 1""",
)
def catalog_merge_counts(spark, sf):
    incoming = arriving(spark, sf)
    return cat.merge_counts(cat.merge_catalog(existing_catalog(spark, sf), incoming, "ord", now()), incoming)


@query(
    "catalog_generated_rows",
    sql=f"""
    with r as (select page_id, {_HOST} as c, case when page_id % 2 = 0 then {_LANG} || '/all.csv' end as raw, 'fold/' || {_LANG} as folder from pages),
    f as (select *, coalesce(raw, folder) as p from r), g as (select *, sha256(lower(c) || 'S3' || lower(p)) as dataset_id from f)
    select dataset_id, arg_max(c, page_id) as client_name, arg_max('obj_' || page_id || '.Json', page_id) as source_object, 'JSON' as file_format,
      arg_max(p, page_id) as raw_layer_path, arg_max('Bronze/acme/obj_' || page_id, page_id) as target_layer_bronze from g group by dataset_id""",
)
def catalog_generated_rows(spark, sf):
    rows = table(spark, sf, "pages").selectExpr(
        "page_id", "'' as dataset_id", f"{_HOST} as client_name", "cast(null as string) as source_type", f"'fold/' || {_LANG} as source_folder",
        "'obj_' || page_id || '.Json' as source_object", "'' as file_format", f"case when page_id % 2 = 0 then {_LANG} || '/all.csv' end as raw_layer_path",
    )
    out = cat.generated_rows(rows, "acme", "page_id")
    return out.select("dataset_id", "client_name", "source_object", "file_format", "raw_layer_path", "target_layer_bronze")


@query("catalog_lookup", sql="select 'f7.csv' as source_object, source as client_name from documents where doc_id = 7")
def catalog_lookup(spark, sf):
    return cat.find_dataset(existing_catalog(spark, sf), "7").select("source_object", "client_name")


@query(
    "catalog_search",
    sql="""
    select cast(doc_id as varchar) as dataset_id from documents where n_chars % 2 = 0 and source = 'src1' and lang = 'en'
    union select cast(doc_id as varchar) from documents where n_chars % 2 = 0 and source = 'src2' and lang not in ('en', 'fr')
      and (lang || '/' || source = 'de/src2' or doc_id = 2)""",
)
def catalog_search(spark, sf):
    c = existing_catalog(spark, sf)
    every = cat.discover(c, "src1", "S3")
    some = cat.discover(c, "src2", "LOCAL", ["de/src2", "f2.csv"])
    return every.unionByName(some).select("dataset_id")


@query(
    "catalog_name_match",
    sql="""
    select cast(doc_id as varchar) as dataset_id from documents
    where doc_id in (3, 4) or 'f' || doc_id = 'f5' or lang || '/' || source = 'fr/src1' or lang = 'es'
      or lang || '/' || source = 'de/src0'""",
)
def catalog_name_match(spark, sf):
    targets = ["3", "F4.csv ", "f5", "/FR/src1/", "es", "de/src0/deep/er"]
    return cat.match_names(existing_catalog(spark, sf), targets).select("dataset_id")


@query(
    "catalog_path_match",
    sql="""
    with c as (select doc_id, lang || '/' || source as f from documents),
    w as (select distinct lang as p from documents where n_chars > 10000
      union select distinct lang || '/' || source || '/x' from documents where n_chars > 15000
      union select distinct lang || '/' || source from documents where n_chars < 200)
    select doc_id, p as wanted from c join w on f = p or starts_with(f, p || '/') or starts_with(p, f || '/')""",
)
def catalog_path_match(spark, sf):
    d = table(spark, sf, "documents")
    wanted = (
        d.where("n_chars > 10000").selectExpr("lang as path")
        .union(d.where("n_chars > 15000").selectExpr("lang || '/' || source || '/x' as path"))
        .union(d.where("n_chars < 200").selectExpr("lang || '/' || source as path"))
    )
    folders = d.selectExpr("doc_id", "lang || '/' || source as source_folder")
    return cat.match_paths(folders, wanted).select("doc_id", "wanted")


@query(
    "client_sources",
    sql="""
    select distinct source as client_name, case lang when 'en' then 'AWS' when 'fr' then 'AZURE' else 'LOCAL' end as source_type from documents
    union select distinct source, 'REST_API' from documents where n_chars > 500""",
)
def client_sources(spark, sf):
    apis = table(spark, sf, "documents").where("n_chars > 500").selectExpr("source as client_name", "'rest' as source_type")
    return cat.client_sources(existing_catalog(spark, sf), apis)


@query(
    "catalog_without_client",
    sql="""
    select (select count(*) from documents where source <> 'src3') as catalog_rows,
      (select count(*) from labels where doc_id not in (select doc_id from documents where source = 'src3')) as rule_rows""",
)
def catalog_without_client(spark, sf):
    rules = table(spark, sf, "labels").selectExpr("cast(doc_id as string) as dataset_id")
    c, r = cat.remove_client(existing_catalog(spark, sf), rules, "src3")
    n = c.agg(F.count(F.lit(1)).alias("catalog_rows"))
    return n.join(F.broadcast(r.agg(F.count(F.lit(1)).alias("rule_rows"))))  # one row each


@query(
    "catalog_new_rows",
    sql="select doc_id from labels where doc_id not in (select doc_id from documents where lang = 'en')",
)
def catalog_new_rows(spark, sf):
    known = table(spark, sf, "documents").where("lang = 'en'").select("doc_id")
    return up.absent_from(table(spark, sf, "labels").select("doc_id"), known, ["doc_id"])


@query(
    "catalog_replaced_rows",
    sql="""
    select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P')
    union all select o_orderkey, 0, o_totalprice from orders where o_orderstatus = 'P'""",
)
def catalog_replaced_rows(spark, sf):
    old = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = table(spark, sf, "orders").where("o_orderstatus = 'P'").selectExpr("o_orderkey as l_orderkey", "0 as l_linenumber", "o_totalprice as l_quantity")
    return up.replace_by_key(old, new, ["l_orderkey"])


@query(
    "real_scan_gate",
    sql="""
    select user_id, bool_or(event_type in ('view', 'click') and event_id % 3 = 0 and event_id % 4 <> 0) as has_real_scan, count(*) as configs
    from events group by user_id""",
)
def real_scan_gate(spark, sf):
    rules = F.expr(
        """'{"scan_status": "' || case event_type when 'view' then 'success' when 'click' then 'partial' else 'failed' end ||
        '", "auth_mode": "' || case when event_id % 3 = 0 then 'key' else 'none' end || '", "is_fallback": ' ||
        case when event_id % 4 = 0 then 'true' else 'false' end || ', "pipeline_capabilities": {"scan_mode": "live"}}'"""
    )
    return cat.real_scan(table(spark, sf, "events").select("user_id", rules.alias("rules")), "rules", ["user_id"])


# Three sources of one field per order: priority from the order, status from its lines, a default.
_VALUES_SQL = """
    v as (select o_orderkey as entity, case when o_orderkey % 4 = 0 then null when o_orderkey % 4 = 1 then '' else o_orderpriority end as raw,
      case when o_orderkey % 3 = 0 then null else '5-LOW' end as ext, case when o_orderkey % 5 = 0 then null else '1-URGENT' end as ex from orders),
    c as (select entity, nullif(raw, '') as raw, ext, ex from v)"""


@query(
    "config_precedence",
    sql=f"""
    with {_VALUES_SQL}
    select entity, 'priority' as path, coalesce(raw, ext, ex) as value,
      case when raw is not null then 'raw' when ext is not null then 'extracted' when ex is not null then 'example' end as origin,
      case when raw is not null and ext is null then 'filled' when raw <> ext then 'overruled' end as correction,
      case when raw <> ext then 'raw' when raw is null and ext <> ex then 'extracted' end as conflict_winner from c""",
)
def config_precedence(spark, sf):
    v = table(spark, sf, "orders").selectExpr(
        "o_orderkey as entity", "'priority' as path",
        """stack(3, 'raw', case when o_orderkey % 4 = 0 then null when o_orderkey % 4 = 1 then '' else o_orderpriority end,
        'extracted', case when o_orderkey % 3 = 0 then null else '5-LOW' end,
        'example', case when o_orderkey % 5 = 0 then null else '1-URGENT' end) as (source, value)""",
    )
    return cat.merge_by_precedence(v)


@query(
    "config_rule_merge",
    sql=f"""
    with {_DEFS_SQL},
    s as (select doc_id as entity, unnest(list_filter([case when contains(low, 'count(*)') or contains(low, 'rowcount') then 'row_count_check' end,
        case when contains(low, 'is null') then 'null_check' end, case when contains(low, 'duplicate') or contains(low, 'distinct') then 'uniqueness_check' end,
        case when contains(low, 'schema') then 'schema_check' end, case when contains(low, 'between') or contains(low, 'range') then 'range_check' end],
        lambda x : x is not null)) as rule from defs),
    r as (select doc_id as entity, 'null_check' as rule, 'raw' as source from defs where lang = 'en'
      union all select doc_id, 'uniqueness_check', 'extracted' from defs union all select doc_id, 'schema_check', 'example' from defs
      union all select doc_id, 'range_check', 'example' from defs),
    ok as (select r.* from r join s using (entity, rule)),
    g as (select entity, rule, bool_or(source = 'raw') as raw, bool_or(source = 'extracted') as ext, bool_or(source = 'example') as ex from ok group by all),
    h as (select entity, bool_or(raw) as has_raw from g group by 1)
    select entity, rule, case when raw then 'raw' when ext and not has_raw then 'extracted' else 'example' end as origin
    from g join h using (entity) where raw or (ext and not has_raw) or ex""",
)
def config_rule_merge(spark, sf):
    d = definitions(spark, sf)
    rules = d.selectExpr(
        "doc_id as entity",
        """inline(array(named_struct('rule', case when lang = 'en' then 'null_check' end, 'source', 'raw'),
        named_struct('rule', 'uniqueness_check', 'source', 'extracted'), named_struct('rule', 'schema_check', 'source', 'example'),
        named_struct('rule', 'range_check', 'source', 'example')))""",
    ).where("rule is not null")
    return cat.merge_rules(rules, cat.supported_rules(d, "doc_id", "body"))


@query(
    "config_record_merge",
    sql="""
    with a as (select 0 as src, c_custkey as ord, case when c_nationkey < 5 then null else c_mktsegment end as name, cast(c_nationkey as varchar) as id from customer
      union all select 1, s_suppkey, s_name, cast(s_nationkey as varchar) from supplier),
    m as (select *, coalesce('name:' || name, 'id:' || id) as marker from a),
    r as (select *, row_number() over (partition by marker order by src, ord) as rn from m)
    select ord, name, id from r where rn = 1""",
)
def config_record_merge(spark, sf):
    p = table(spark, sf, "customer").selectExpr(
        "c_custkey as ord", "case when c_nationkey < 5 then null else c_mktsegment end as name", "cast(c_nationkey as string) as id"
    )
    s = table(spark, sf, "supplier").selectExpr("s_suppkey as ord", "s_name as name", "cast(s_nationkey as string) as id")
    return cat.merge_records(p, s, fields=("name", "id"))


@query(
    "config_overlay",
    sql="""
    select c_custkey, case when c_acctbal < 0 then 'LATE' else c_mktsegment end as segment, c_name as name from customer""",
)
def config_overlay(spark, sf):
    base = table(spark, sf, "customer").selectExpr("c_custkey", "c_mktsegment as segment", "c_name as name")
    top = table(spark, sf, "customer").selectExpr("c_custkey", "case when c_acctbal < 0 then 'LATE' else ' ' end as segment")
    return cat.overlay(base, top, "c_custkey")


@query(
    "config_candidates",
    sql="""
    select o_custkey, case when min(o_orderstatus) = max(o_orderstatus) then min(o_orderstatus) else 'Mixed' end as status,
      case when min(p) = max(p) then min(p) when min(p) is not null then 'Mixed' end as priority
    from (select o_custkey, o_orderstatus, nullif(case when o_orderkey % 3 = 0 then '' else o_orderpriority end, '') as p from orders) group by o_custkey""",
)
def config_candidates(spark, sf):
    o = table(spark, sf, "orders").selectExpr(
        "o_custkey", "o_orderstatus as status", "case when o_orderkey % 3 = 0 then '' else o_orderpriority end as priority"
    )
    return cat.combine_candidates(o, ["o_custkey"], ["status", "priority"])


@query(
    "inventory_assets",
    sql="""
    select event_id, 's3' as type, 'b' || user_id as name, '{"r":"eu"}' as configuration from events
    union all select event_id, 'jobs', event_type, '{"name":"' || event_type || '"}' from events where event_id % 2 = 0
    union all select event_id, 'jobs', 'plain', '{}' from events where event_id % 2 = 0""",
)
def inventory_assets(spark, sf):
    payload = F.expr(
        """'{"s3": [{"id": "b' || user_id || '", "configuration": {"r": "eu"}}], "warnings": ["w"], "jobs": ' ||
        case when event_id % 2 = 0 then '[{"name": "' || event_type || '"}, "plain", ""]' else '[]' end || '}'"""
    )
    e = table(spark, sf, "events").select("event_id", payload.alias("payload"))
    # an object with neither id nor configuration is named after its own name
    return cat.flatten_assets(e, "payload", ["event_id"])


@query(
    "api_endpoints",
    sql="""
    select page_id, 'p' || page_id as source_name, unnest(['items', 'v' || page_id]) as endpoint,
      'http://h/' || unnest(['items', 'v' || page_id]) as full_url from pages where page_id % 2 = 0""",
)
def api_endpoints(spark, sf):
    c = table(spark, sf, "pages").selectExpr(
        "page_id", "'p' || page_id as source_name", "'http://h' as base_url", "' items ,, v' || page_id as endpoints", "page_id % 2 = 0 as is_active"
    )
    return cat.explode_endpoints(c, ["page_id"])


_CONFIG = [
    "case when o_orderkey % 2 = 0 then 'svc' end as service_name",
    "case o_orderkey % 4 when 0 then 'send_email' when 1 then o_orderstatus else 'T' end as destination",
    "case when o_orderkey % 3 = 0 then null else 'T' end as raw_destination",
    "case o_orderkey % 3 when 0 then '' when 1 then 'a->b' else 'x' end as flow",
    "case when o_orderkey % 5 = 0 then null else 'a->b' end as raw_flow",
]
_SCORE_SQL = f"""
    c as (select o_orderkey, o_orderpriority, {', '.join(_CONFIG)} from orders),
    s as (select *, case when service_name is not null then 1.0 else 0.6 end as source_score,
      case when contains(destination, 'email') then 0.0 when raw_destination is not null and destination <> raw_destination then 0.5 else 1.0 end as destination_score,
      case when o_orderpriority = '1-URGENT' then 0.9 when o_orderpriority = '5-LOW' then 0.4 else 1.0 end as rules_score,
      case when flow = raw_flow then 1.0 when flow <> '' then 0.7 else 0.4 end as flow_score from c)"""


@query(
    "config_validation_score",
    sql=f"""
    with {_SCORE_SQL}
    select o_orderkey, source_score::double as source_score, destination_score::double as destination_score, rules_score::double as rules_score,
      flow_score::double as flow_score,
      printf('%.2f', (source_score::double + destination_score::double + rules_score::double + flow_score::double) / 4) as accuracy_score from s""",
)
def config_validation_score(spark, sf):
    c = table(spark, sf, "orders").selectExpr(
        "o_orderkey", *_CONFIG, "array('r') as supported",
        "case o_orderpriority when '1-URGENT' then array() when '5-LOW' then array('r', 'odd') else array('r') end as rules",
    )
    return cat.validation_score(c, "o_orderkey")


@query(
    "config_missing_fields",
    sql=f"""
    with {_SCORE_SQL}
    select o_orderkey, field from (
      select o_orderkey, unnest(['service_name', 'destination', 'raw_destination', 'flow', 'raw_flow']) as field,
        unnest([service_name, destination, raw_destination, flow, raw_flow]) as v from c) where v is null or v = ''""",
)
def config_missing_fields(spark, sf):
    c = table(spark, sf, "orders").selectExpr("o_orderkey", *_CONFIG)
    return cat.missing_fields(c, "o_orderkey", ["service_name", "destination", "raw_destination", "flow", "raw_flow"])


@query(
    "last_by_id",
    sql="select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey order by (l_linenumber, l_partkey, l_quantity) desc) as rn from lineitem) where rn = 1",
)
def last_by_id(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_linenumber", "l_partkey", "l_quantity").alias("o"))
    return up.last_by_id(li, "l_orderkey", "o").drop("o")


@query(
    "first_by_marker",
    sql="""
    with m as (select p_partkey, p_brand, p_type, coalesce('p_brand:' || case when p_size < 25 then p_brand end, 'p_type:' || p_type) as marker,
      case when p_size < 25 then p_brand end as b from part)
    select p_partkey, b as p_brand, p_type from (select *, row_number() over (partition by marker order by p_partkey) as rn from m) where rn = 1""",
)
def first_by_marker(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", "case when p_size < 25 then p_brand end as p_brand", "p_type")
    return up.first_by_marker(p, ["p_brand", "p_type"], ["p_partkey"])


@query(
    "first_by_record",
    sql="select min(doc_id) as doc_id, text, lang from documents group by text, lang",
)
def first_by_record(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", F.lit("").alias("name"))
    return up.first_by_marker(docs, ["name"], ["doc_id"]).drop("name")


_NOTED = "case page_id % 3 when 0 then 'plain' when 1 then 'a \"quoted\", comma' else 'tab' || {tab} || 'end' end"


@query(
    "catalog_file_round_trip",
    sql=f"""
    select cast(page_id as varchar) as dataset_id, {_HOST} as client_name, {_NOTED.format(tab="chr(9)").replace(chr(92), "")} as source_object,
      nullif({_LANG}, '') as source_folder, case when page_id % 2 = 0 then 'true' else 'false' end as is_active, cast(null as varchar) as upsert_key from pages""",
)
def catalog_file_round_trip(spark, sf):
    """The catalog as comma-separated files and back: all columns of a catalog, as text; what was empty is null."""
    noted = _NOTED.format(tab="chr(9)").replace(chr(92), "")
    c = table(spark, sf, "pages").selectExpr(
        "cast(page_id as string) as dataset_id", f"{_HOST} as client_name", f"{noted} as source_object", f"{_LANG} as source_folder",
        "page_id % 2 = 0 as is_active", "case when page_id % 5 = 0 then '' end as upsert_key",
    )
    path = scratch_path(spark, "catalog_csv")
    cat.export_csv(c, path)
    back = cat.import_csv(spark, path)
    return back.select("dataset_id", "client_name", "source_object", "source_folder", F.col("is_active").cast("string").alias("is_active"), "upsert_key")


@query(
    "catalog_missing_columns",
    sql="""
    select 'bare' as catalog, c as missing, n as rows from (select unnest(['pipeline_id', 'source_folder', 'file_format', 'target_layer_bronze', 'target_layer_silver']) as c),
      (select count(*) as n from documents where doc_id % 2 = 0)
    union all select 'named', 'target_layer_silver', count(*) from documents where doc_id % 2 = 1""",
)
def catalog_missing_columns(spark, sf):
    """Two catalog files of which one lacks five required columns and the other one: what an upload of them is told."""
    d = table(spark, sf, "documents").selectExpr("doc_id", "cast(doc_id as string) as dataset_id", "source as client_name", "'S3' as source_type", "lang as source_object")
    full = d.where("doc_id % 2 = 1").selectExpr("*", "'p' as pipeline_id", "source_object as source_folder", "'CSV' as file_format", "'Bronze' as target_layer_bronze")
    rows = []
    for name, c in (("bare", d.where("doc_id % 2 = 0")), ("named", full)):
        path = scratch_path(spark, f"catalog_{name}")
        cat.export_csv(c.drop("doc_id"), path)
        upload = read_delimited(spark, path)
        missing = F.explode(F.array(*[F.lit(m) for m in cat.missing_columns(upload)]))
        rows.append(upload.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("catalog"), missing.alias("missing"), "rows"))
    return rows[0].unionByName(rows[1])
