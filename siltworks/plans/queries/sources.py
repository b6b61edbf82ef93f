"""Sources: files written from the given tables and read back, inventories of page addresses, API payloads of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions import paths
from siltworks.plans.registry import query, table
from siltworks.plans.scratch import scratch_path
from siltworks.sources import checks, inventory, payloads, readers

# Customers as a delimited file spells them, with several texts for "no value".
CUSTOMER_TEXT = [
    "c_custkey",
    "c_name",
    "case c_nationkey when 1 then 'NA' when 2 then 'null' when 3 then '' else c_mktsegment end as segment",
    "c_acctbal",
]
_CUSTOMER_SQL = """
    select c_custkey, c_name, case when c_nationkey in (1, 2, 3) then null else c_mktsegment end as segment, c_acctbal
    from customer"""


def _customers(spark, sf):
    return table(spark, sf, "customer").selectExpr(*CUSTOMER_TEXT)


def _delimited(spark, sf, sep, ext):
    path = f"{scratch_path(spark, 'customers')}.{ext}"
    _customers(spark, sf).write.csv(path, sep=sep, header=True, emptyValue="")
    return readers.read_file(spark, path, infer=True)


@query("read_csv", sql=_CUSTOMER_SQL)
def read_csv(spark, sf):
    return _delimited(spark, sf, ",", "csv")


@query("read_tsv", sql=_CUSTOMER_SQL)
def read_tsv(spark, sf):
    return _delimited(spark, sf, "\t", "tsv")


@query(
    "read_csv_no_header",
    sql="select n_nationkey + c_custkey as k, n_name || '|' || c_name as names from customer join nation on c_nationkey = n_nationkey",
)
def read_csv_no_header(spark, sf):
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    path = scratch_path(spark, "pairs")
    pairs = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))  # nation: 25 rows, left to the planner
    pairs.selectExpr("n_nationkey + c_custkey as k", "n_name || '|' || c_name as names").write.csv(path, sep=";")
    back = readers.read_delimited(spark, path, sep=";", header=False, columns=["k", "names"])
    return back.select(F.col("k").cast("bigint").alias("k"), "names")


@query(
    "read_json_lines",
    sql="select event_id, event_type, value, cast(regexp_extract(props, '[0-9]+') as bigint) as k from events",
)
def read_json_lines(spark, sf):
    path = f"{scratch_path(spark, 'events')}.json"
    table(spark, sf, "events").selectExpr("event_id", "event_type", "value", "from_json(props, 'k bigint') as props").write.json(path)
    return readers.read_file(spark, path).selectExpr("event_id", "event_type", "value", "props.k as k")


@query("read_json_documents", sql="select doc_id, quality, toxic from labels")
def read_json_documents(spark, sf):
    """JSON array documents, each of at most 1000 labels: a document is one file and is read by one task."""
    path = f"{scratch_path(spark, 'labels')}.json"
    docs = table(spark, sf, "labels").groupBy(F.expr("doc_id div 1000").alias("part")).agg(
        F.to_json(F.collect_list(F.struct("doc_id", "quality", "toxic"))).alias("value")
    )
    docs.write.partitionBy("part").text(path)
    return readers.read_json(spark, path, "document").select("doc_id", "quality", "toxic")


@query(
    "read_csv_long_integers_all",
    sql="""
    select o_orderkey, cast('12345678901234' || lpad(cast(o_orderkey % 100000 as varchar), 5, '0') as bigint) as id,
      '99999999999999' || lpad(cast(o_orderkey % 100000000 as varchar), 8, '0') as longer from orders""",
)
def read_csv_long_integers_all(spark, sf):
    """Nineteen digits are a bigint, twenty-two a decimal."""
    path = f"{scratch_path(spark, 'ids')}.csv"
    ids = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "'12345678901234' || lpad(o_orderkey % 100000, 5, '0') as id", "'99999999999999' || lpad(o_orderkey % 100000000, 8, '0') as longer"
    )
    ids.write.csv(path, header=True)
    back = readers.read_file(spark, path, infer=True)
    if back.schema["longer"].dataType.simpleString() != "decimal(38,0)":
        raise TypeError("the longer ids are not decimals")
    return back.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "id", F.col("longer").cast("string").alias("longer"))


@query("read_json_mixed_folder", sql="select doc_id, quality, toxic from labels")
def read_json_mixed_folder(spark, sf):
    """One folder with lines, array documents and pretty-printed arrays; every label comes back."""
    path = scratch_path(spark, "mixed")
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    one = F.to_json(F.struct("doc_id", "quality", "toxic"))
    labels.where("doc_id % 3 = 0").select(one.alias("value")).write.text(f"{path}/lines")
    for k, gap in ((1, ","), (2, ",\n  ")):
        docs = labels.where(f"doc_id % 3 = {k}").groupBy(F.expr("doc_id div 1000").alias("part"))
        body = F.concat(F.lit("[" if k == 1 else "[\n  "), F.array_join(F.collect_list(one), gap), F.lit("]" if k == 1 else "\n]"))
        docs.agg(body.alias("value")).write.partitionBy("part").text(f"{path}/docs{k}")
    everything = [f"{path}/lines", *[f"{path}/docs{k}/part=*" for k in (1, 2)]]
    return readers.read_json(spark, everything).select("doc_id", "quality", "toxic")


@query("read_json_pretty", sql="select n_nationkey, n_name from nation")
def read_json_pretty(spark, sf):
    """One pretty-printed object per file."""
    path = scratch_path(spark, "pretty")
    value = F.concat(F.lit('{\n  "n_nationkey": '), F.col("n_nationkey").cast("string"), F.lit(',\n  "n_name": "'), F.col("n_name"), F.lit('"\n}'))
    table(spark, sf, "nation").select(value.alias("value"), F.col("n_nationkey").alias("part")).write.partitionBy("part").text(path)
    return readers.read_json(spark, f"{path}/part=*").select("n_nationkey", "n_name")


@query(
    "read_bad_lines",
    sql="""
    select count(*) filter (where c_nationkey <> 5) as good_rows, count(*) filter (where c_nationkey = 5) as bad_rows,
      count(*) filter (where c_nationkey <> 5) as rows_when_skipping from customer""",
)
def read_bad_lines(spark, sf):
    path = scratch_path(spark, "bad_lines")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", F.when(F.col("c_nationkey") == 5, "x,y,z"))
    table(spark, sf, "customer").select(line.alias("value")).write.text(path)
    cols = ["id", "name"]
    kept = readers.read_delimited(spark, path, header=False, columns=cols, bad_lines="quarantine")
    skipped = readers.read_delimited(spark, path, header=False, columns=cols, bad_lines="skip")
    good = F.col(readers.CORRUPT).isNull()
    n = kept.select("id", readers.CORRUPT).agg(F.count_if(good).alias("good_rows"), F.count_if(~good).alias("bad_rows"))
    return n.join(F.broadcast(skipped.select("id", "name").agg(F.count("name").alias("rows_when_skipping"))))  # one row each


@query("read_orc", sql="select p_partkey, p_name, p_retailprice from part")
def read_orc(spark, sf):
    path = scratch_path(spark, "parts")
    table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice").write.orc(path)
    return readers.read_connection(spark, {"format": "orc", "path": path})


@query("read_xml", sql="select s_suppkey, s_name from supplier")
def read_xml(spark, sf):
    path = scratch_path(spark, "suppliers")
    table(spark, sf, "supplier").select("s_suppkey", "s_name").write.format("xml").option("rowTag", "row").save(path)
    return readers.read_connection(spark, {"format": "xml", "path": path, "read_options": {"rowTag": "row"}})


@query("read_unknown_format", sql="select user_id, count(*) as n from events group by user_id")
def read_unknown_format(spark, sf):
    path = scratch_path(spark, "no_extension")
    table(spark, sf, "events").select("user_id", "event_id").write.json(path)
    return readers.read_unknown(spark, path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "raw_file_selection",
    sql="""
    select 'Raw/shop/B' || (page_id % 3) || '/' || regexp_extract(url, '/([a-z]{2})/', 1) || '/f' || page_id ||
      case page_id % 4 when 0 then '.csv' when 1 then '.exe' when 2 then '.json' else '.parquet' end as key
    from pages where page_id % 3 = 1 and page_id % 4 <> 1 and regexp_extract(url, '/([a-z]{2})/', 1) = 'en'""",
)
def raw_file_selection(spark, sf):
    path = F.expr(
        """'/lake/Raw/shop/B' || (page_id % 3) || '/' || regexp_extract(url, '/([a-z]{2})/', 1) || '/f' || page_id ||
        case page_id % 4 when 0 then '.csv' when 1 then '.exe' when 2 then '.json' else '.parquet' end"""
    )
    files = table(spark, sf, "pages").select(path.alias("path"), F.length("url").cast("bigint").alias("length"))
    found = readers.raw_files(inventory.describe(files, F.lit("shop"), F.lit("S3")), "shop", "en", batch="B1")
    return found.select(F.replace("file_path", F.lit("/lake/"), F.lit("")).alias("key"))


# Pages as a lake of objects: folders by host and language, a few files at the top.
_LAKE = [
    "case when page_id % 5 = 0 then 'lake/page_' || page_id || '.html' "
    "else 'lake/' || regexp_replace(url, '^https?://', '') end as path",
    "cast(length(html) as bigint) as length",
]
_LAKE_SQL = f"lake as (select {', '.join(_LAKE)} from pages)"


def lake(spark, sf):
    return table(spark, sf, "pages").selectExpr(*_LAKE)


_NAME_SQL = "regexp_extract(path, '([^/]*)$', 1)"
_EXT_SQL = f"case when contains({_NAME_SQL}, '.') then regexp_extract({_NAME_SQL}, '([^.]*)$', 1) else '' end"


@query(
    "file_inventory",
    sql=f"""
    with {_LAKE_SQL}
    select {_NAME_SQL} as file_name, path as file_path, coalesce(nullif(upper({_EXT_SQL}), ''), 'UNKNOWN') as file_format,
      length as file_size, 'S3' as source_type, 'acme' as client_name from lake""",
)
def file_inventory(spark, sf):
    return inventory.describe(lake(spark, sf), F.lit("acme"), F.lit("S3"))


@query(
    "file_inventory_known_formats",
    sql="""
    select 'f' || doc_id || '.' || (case doc_id % 5 when 0 then 'csv' when 1 then 'XLSX' else 'json' end) as file_name
    from documents where doc_id % 5 <= 2""",
)
def file_inventory_known_formats(spark, sf):
    name = F.expr(
        "'d/f' || doc_id || '.' || case doc_id % 5 when 0 then 'csv' when 1 then 'XLSX' when 2 then 'json' when 3 then 'md' else 'exe' end"
    )
    files = table(spark, sf, "documents").select(name.alias("path"), F.col("n_chars").alias("length"))
    return inventory.with_formats(inventory.describe(files, F.lit("acme"), F.lit("LOCAL"))).select("file_name")


def source_files(spark, sf) -> str:
    """A folder with files of each source of the documents: ids of a block of `IDS_A_FILE` each, in order."""
    path = scratch_path(spark, "by_source")
    ids = table(spark, sf, "documents").select("doc_id", "source", F.expr(f"doc_id div {IDS_A_FILE}").alias("block"))
    ids.repartition("source", "block").sortWithinPartitions("source", "block", "doc_id").write.partitionBy("source", "block").csv(path)
    return path


IDS_A_FILE = 10_000
_SOURCE, _BLOCK = r"/source=([^/]*)/", r"/block=([^/]*)/"


def _named_by(path: str) -> list:
    return [F.regexp_extract(path, _SOURCE, 1).alias("source"), F.regexp_extract(path, _BLOCK, 1).cast("bigint").alias("block")]



@query(
    "table_files",
    sql=f"""
    select source, doc_id // {IDS_A_FILE} as block, 'CSV' as file_format, cast(sum(length(cast(doc_id as varchar)) + 1) as bigint) as file_size,
      'LOCAL' as source_type, 'acme' as client_name from documents group by source, block""",
)
def table_files(spark, sf):
    """Written files, by a listing that opens none of them."""
    files = inventory.list_files(spark, source_files(spark, sf), "*.csv")
    rows = inventory.describe(files, F.lit("acme"), F.lit("LOCAL"))
    return rows.select(*_named_by("file_path"), "file_format", "file_size", "source_type", "client_name")


@query(
    "landing_manifest",
    sql=f"""
    select source, doc_id // {IDS_A_FILE} as block, cast(sum(length(cast(doc_id as varchar)) + 1) as bigint) as length,
      sha256(string_agg(cast(doc_id as varchar) || chr(10), '' order by doc_id)) as sha256 from documents group by source, block""",
)
def landing_manifest(spark, sf):
    rows = inventory.manifest(spark, source_files(spark, sf), "acme", "B1").where("raw_path like 'Raw/acme/B1/%.csv'")
    return rows.select(*_named_by("source_path"), "length", "sha256")


@query(
    "folder_children",
    sql=f"""
    with {_LAKE_SQL}, b as (select *, substr(path, 6) as rel from lake)
    select distinct 'folder' as kind, split_part(rel, '/', 1) as name, null as file_path, null as file_format,
      cast(null as bigint) as file_size from b where contains(rel, '/')
    union all select 'file', rel, path, 'HTML', length from b where not contains(rel, '/')""",
)
def folder_children(spark, sf):
    return inventory.children(lake(spark, sf), "lake")


@query(
    "first_data_file",
    sql=f"with {_LAKE_SQL} select path, length from lake order by path limit 1",
)
def first_data_file(spark, sf):
    marked = lake(spark, sf).unionByName(lake(spark, sf).selectExpr("'a/_SUCCESS' as path", "length"))
    return inventory.first_data_file(marked)


@query(
    "bucket_formats",
    sql="""
    with f as (select regexp_extract(url, '^https?://([^/]+)', 1) as bucket, regexp_extract(url, '/([a-z]{2})/', 1) as prefix,
      'x/f' || page_id || case page_id % 4 when 0 then '.csv' when 1 then '.log' when 2 then '.json' else '' end as path from pages),
    k as (select *, case when path like '%.csv' then 'CSV' when path like '%.json' then 'JSON' end as fmt from f)
    select bucket, count(*) as files, coalesce(string_agg(distinct fmt, ',' order by fmt), '') as formats,
      coalesce(arg_min(prefix, path) filter (where fmt is not null), arg_min(prefix, path)) as suggested_prefix
    from k group by bucket""",
)
def bucket_formats(spark, sf):
    files = table(spark, sf, "pages").select(
        F.expr(
            "'x/f' || page_id || case page_id % 4 when 0 then '.csv' when 1 then '.log' when 2 then '.json' else '' end"
        ).alias("path"),
        "url",
    )
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    out = inventory.bucket_summary(files, host, F.regexp_extract("url", "/([a-z]{2})/", 1))
    return out.withColumn("formats", F.array_join("formats", ","))


# API payloads in several wrappings around each event's properties.
PAYLOADS = """
  case event_id % 7
    when 0 then '[{"page": 1}, [' || props || ', 2]]'
    when 1 then '{"z": 0, "items": [' || props || ', {"b": "t", "a": 1.5}]}'
    when 2 then '{"q": true}'
    when 3 then '{"meta": [], "rows": [3], "more": [4]}'
    when 4 then '[1, ' || props || ']'
    when 5 then '"text"'
    else '{broken' end"""


def event_payloads(spark, sf):
    return table(spark, sf, "events").select("event_id", F.expr(PAYLOADS).alias("payload"))


_RECORDS_SQL = """
    p as (select event_id, replace(props, ' ', '') as props, event_id % 7 as v from events),
    lists as (select event_id, case v
      when 0 then [props, '{"value":2}'] when 1 then [props, '{"a":1.5,"b":"t"}'] when 2 then ['{"q":true}']
      when 3 then ['{"value":3}'] when 4 then ['{"value":1}', props] when 5 then ['{"value":"text"}'] else [] end as l from p),
    r as (select event_id, unnest(l) as record, generate_subscripts(l, 1) - 1 as pos from lists)"""


@query("api_records", sql=f"with {_RECORDS_SQL} select event_id, pos, record from r")
def api_records(spark, sf):
    return payloads.explode_records(event_payloads(spark, sf), "payload", ["event_id"])


@query(
    "api_records_table",
    sql=f"""
    with {_RECORDS_SQL}
    select event_id, pos, case when event_id % 7 = 0 and pos = 0 then regexp_extract(record, '[0-9]+')
      when event_id % 7 = 1 and pos = 0 then regexp_extract(record, '[0-9]+')
      when event_id % 7 = 4 and pos = 1 then regexp_extract(record, '[0-9]+') end as k from r""",
)
def api_records_table(spark, sf):
    rows = payloads.explode_records(event_payloads(spark, sf), "payload", ["event_id"])
    return payloads.records_table(rows, order=("event_id", "pos"))


@query(
    "api_records_all_keys",
    sql="""
    select count(*) filter (where event_id % 7 in (0, 1, 4)) as k, count(*) filter (where event_id % 7 = 1) as a,
      count(*) filter (where event_id % 7 = 1) as b, count(*) filter (where event_id % 7 = 2) as q,
      count(*) filter (where event_id % 7 in (0, 3, 4, 5)) as value from events""",
)
def api_records_all_keys(spark, sf):
    rows = payloads.explode_records(event_payloads(spark, sf), "payload", ["event_id"])
    wide = payloads.records_table(rows, union_keys=True)
    return wide.agg(*[F.count(c).alias(c) for c in ("k", "a", "b", "q", "value")])


@query(
    "api_schema",
    sql="""
    select 'k' as column_name, 'INTEGER' as data_type, 'NOT_NULL' as dq_rules, 'WARN' as severity
    union all select 'a', 'DOUBLE', 'NOT_NULL', 'WARN' union all select 'b', 'STRING', 'NOT_NULL', 'WARN'
    union all select 'q', 'BOOLEAN', 'NOT_NULL', 'WARN' union all select 'value', 'INTEGER', 'NOT_NULL', 'WARN'""",
)
def api_schema(spark, sf):
    rows = payloads.explode_records(event_payloads(spark, sf), "payload", ["event_id"])
    out = payloads.payload_schema(rows, "record", F.struct("event_id", "pos"))
    return out.withColumn("dq_rules", F.array_join("dq_rules", ","))


@query(
    "api_schema_per_user",
    sql="""
    with a as (select user_id, arg_min(case when event_id % 2 = 0 then 'INTEGER' else 'JSON' end, event_id) as t from events group by user_id)
    select user_id, 'x' as column_name, t as data_type, case when t = 'JSON' then 'NOT_NULL,VALID_JSON' else 'NOT_NULL' end
      as dq_rules from a""",
)
def api_schema_per_user(spark, sf):
    rec = F.expr("""case when event_id % 2 = 0 then '{"x": ' || event_id || '}' else '{"x": ' || props || '}' end""")
    rows = table(spark, sf, "events").select("user_id", "event_id", rec.alias("record"))
    out = payloads.payload_schema(rows, "record", F.col("event_id"), ["user_id"])
    return out.withColumn("dq_rules", F.array_join("dq_rules", ",")).drop("severity")


# Landing: one file per document, some empty, some of the wrong kind, some cut short.
_LANDED = [
    "'in/' || source || '/d' || doc_id || case doc_id % 6 when 0 then '.csv' when 1 then '.json' when 2 then '.parquet' "
    "when 3 then '.xlsx' when 4 then '.CSV' else '' end as path",
    "case when doc_id % 10 = 0 then 0 else n_chars end as length",
    "case when doc_id % 4 = 0 then n_chars * 3 else n_chars end as expected",
    "case when doc_id % 8 = 4 then 2 else 0 end as parse_errors",
]
_LANDED_SQL = f"""
    f as (select doc_id, source, {', '.join(_LANDED)}, case doc_id % 6 when 0 then 'csv' when 1 then 'json'
      when 2 then 'parquet' when 3 then 'xlsx' when 4 then 'csv' else '' end as ext from documents),
    checked as (select *, concat_ws('|', case when length = 0 then 'File is empty' end,
      case when ext not in ('csv', 'json', 'parquet') then 'Unsupported format: ' || ext end,
      case when expected > 0 and length > 0 and length < expected * 0.5 then 'Incomplete download' end,
      case when ext = 'csv' and length > 0 and parse_errors > 0 then 'CSV Parsing Failed' end) as failed from f)"""


def landed(spark, sf):
    files = table(spark, sf, "documents").selectExpr("source", *_LANDED)
    name = paths.file_name(F.col("path"))
    failed = checks.failed_rules(F.col("file_size"), F.col("file_name"), F.col("expected"), F.col("parse_errors"))
    rows = files.select(
        name.alias("file_name"), F.col("path").alias("file_path"), F.col("length").alias("file_size"),
        F.col("source").alias("client_name"), "expected", "parse_errors",
    )
    return checks.ingestion_log(rows, "B1", "2024-01-02T03:04:05", failed)


@query(
    "landing_checks",
    sql=f"""
    with {_LANDED_SQL}
    select path as source_path, regexp_extract(path, '([^/]*)$', 1) as source_object, source as client_name,
      case when failed = '' then 'PASS' else 'FAIL' end as validation_status, failed as failed_rules from checked""",
)
def landing_checks(spark, sf):
    log = landed(spark, sf)
    return log.select(
        "source_path", "source_object", "client_name", "validation_status",
        F.array_join("failed_validation_rules", "|").alias("failed_rules"),
    )


@query(
    "landing_summary",
    sql=f"""
    with {_LANDED_SQL}
    select 'B1' as batch_id, source as client_name, count(*) as total_files, count(*) filter (where failed <> '') as failed_files
    from checked group by source""",
)
def landing_summary(spark, sf):
    return checks.landing_summary(landed(spark, sf))


@query(
    "header_problems",
    sql="""
    select doc_id, case doc_id % 6 when 0 then 'Duplicate column names found' when 1 then 'Invalid column name found'
      when 2 then 'Dataset has no columns' when 3 then 'Duplicate column names found|Invalid column name found'
      when 4 then 'Invalid column name found' else '' end as problems from documents""",
)
def header_problems(spark, sf):
    header = F.expr(
        """case doc_id % 6 when 0 then 'a,b, a' when 1 then 'a,Unnamed: 1' when 2 then '  ' when 3 then 'a,a,,b'
        when 4 then '"x","",z' else 'id,' || lang || ',' || source end"""
    )
    docs = table(spark, sf, "documents").select("doc_id", header.alias("header"))
    return docs.select("doc_id", F.array_join(checks.header_problems(F.col("header")), "|").alias("problems"))


# Customers in four dialects, with separators and quotes of all of them inside a field.
DIALECTS = ((",", '"', True), (";", '"', False), ("|", "'", True), ("\t", '"', False))
_REMARK = """case c_nationkey % 6 when 0 then 'a, b' when 1 then 'c; d' when 2 then 'e | f' when 3 then 'it''s' when 4 then 'say "x"'
    else c_mktsegment end"""
_DIALECT_SQL = " union all ".join(
    f"select {i} as file, {str(header).lower()} as header, c_custkey as k, {_REMARK} as remark, c_acctbal as balance from customer"
    for i, (_, _, header) in enumerate(DIALECTS)
)


@query("read_inferred_dialects", sql=_DIALECT_SQL)
def read_inferred_dialects(spark, sf):
    customers = table(spark, sf, "customer").selectExpr("c_custkey as k", f"{_REMARK.replace(chr(39) * 2, chr(92) + chr(39))} as remark", "c_acctbal as balance")
    parts = []
    for i, (sep, quote, header) in enumerate(DIALECTS):
        path = scratch_path(spark, f"dialect-{i}")
        customers.write.csv(path, sep=sep, quote=quote, escape=quote, header=header)
        back = readers.read_inferred(spark, path)
        named = back.columns == customers.columns
        parts.append(back.toDF("k", "remark", "balance").select(F.lit(i).alias("file"), F.lit(named).alias("header"), "k", "remark", "balance"))
    return reduce(DataFrame.unionAll, parts)


@query("header_lines_of_files", sql="select 'c_custkey,c_name,segment,c_acctbal' as header, '' as problems")
def header_lines_of_files(spark, sf):
    path = scratch_path(spark, "headed")
    _customers(spark, sf).write.csv(path, header=True)
    lines = readers.header_lines(spark, path).select("header").distinct()  # what the files, as many as there are, begin with
    return lines.select("header", F.array_join(checks.header_problems(F.col("header")), "|").alias("problems"))


@query(
    "parse_errors_of_files",
    sql="select count(*) as n_rows, count(*) filter (where c_nationkey = 5) as n_bad from customer",
)
def parse_errors_of_files(spark, sf):
    path = scratch_path(spark, "with_bad_lines")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", F.when(F.col("c_nationkey") == 5, "x,y,z"))
    table(spark, sf, "customer").select(line.alias("value")).write.text(path)
    per_file = checks.parse_errors(spark, path, ["id", "name"], header=False)
    return per_file.agg(F.sum("rows").alias("n_rows"), F.sum("bad_rows").alias("n_bad"))


@query(
    "reader_strategies",
    sql="""
    select page_id, case page_id % 8 when 0 then 'api_preview' when 1 then 'sql_preview' when 2 then 'direct_csv'
      when 3 then 'direct_json' when 4 then 'parquet_preview' when 5 then
        case when url like 'https://%' then 'direct_file' else 'spark_fallback' end
      when 6 then case when url like 'https://%' then 'direct_file' else 'onelake_direct' end else 'api_preview' end as strategy
    from pages""",
)
def reader_strategies(spark, sf):
    p = table(spark, sf, "pages").selectExpr(
        "page_id", "url",
        "case when page_id % 8 = 6 then 'Lakehouse' else 'x' end as st",
        "case page_id % 8 when 0 then 'RestService' when 1 then 'AzurePostgreSql' when 2 then 'DelimitedText' else '' end as ct",
        "case page_id % 8 when 3 then 'JSON' when 4 then 'parquet' else '' end as fm",
        "case when page_id % 8 = 7 then array('endpoint') else array('name') end as mk",
    )
    s = readers.preview_strategy(F.col("st"), F.col("ct"), F.col("fm"), F.col("url"), F.col("mk"))
    return p.select("page_id", s.alias("strategy"))


@query(
    "table_structure_problems",
    sql="""
    select 'orders' as dataset, 'none' as problem, count(*) as rows from orders
    union all select 'unnamed', 'Invalid column name found', count(*) from customer
    union all select 'repeated', 'Duplicate column names found', count(*) from part
    union all select 'empty', 'Dataset is empty', count(*) from supplier where s_suppkey < 0""",
)
def table_structure_problems(spark, sf):
    """What is wrong with tables already read: no rows, names that are missing or stand twice."""
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    tables = {
        "orders": table(spark, sf, "orders"), "unnamed": table(spark, sf, "customer").withColumnRenamed("c_name", "Unnamed: 1"),
        "repeated": p.toDF("p_partkey", "p_partkey"), "empty": table(spark, sf, "supplier").where("s_suppkey < 0"),
    }
    rows = []
    for name, df in tables.items():
        found = F.explode(F.array(*[F.lit(x) for x in checks.table_problems(df) or ["none"]]))
        rows.append(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("dataset"), found.alias("problem"), "rows"))
    return reduce(lambda a, b: a.unionByName(b), rows)
