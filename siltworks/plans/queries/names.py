"""Paths, URLs, resource names and lenient readings over the page addresses and other text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.functions import lenient, paths
from siltworks.plans.registry import query, table

_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_TAIL = "regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1)"


def pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url")


@query(
    "dataset_ids",
    sql="select page_id, sha256(lower(trim('  Acme')) || upper(trim('s3 ')) || replace(lower(trim(url || ' A b')), ' ', '_')) as dataset_id from pages",
)
def dataset_ids(spark, sf):
    return pages(spark, sf).select(
        "page_id", paths.dataset_id(F.lit("  Acme"), F.lit("s3 "), F.concat("url", F.lit(" A b"))).alias("dataset_id")
    )


@query(
    "s3_addresses",
    sql=f"""
    select page_id, case page_id % 5 when 2 then 'bkt' else {_HOST} end as bucket,
      case page_id % 5 when 1 then '' when 2 then {_TAIL} when 4 then 'k/' || page_id else {_TAIL} end as key from pages""",
)
def s3_addresses(spark, sf):
    u = F.expr(
        f"""case page_id % 5 when 0 then 's3:// ' || {_HOST} || '/' || {_TAIL} when 1 then 's3://' || {_HOST}
        when 2 then 'https://s3.eu.amazonaws.com/bkt/' || {_TAIL}
        when 3 then 'https://' || {_HOST} || '.s3.eu.amazonaws.com/' || {_TAIL} || '?v=1'
        else ' ' || {_HOST} || '/k/' || page_id || ' ' end"""
    )
    bucket, key = paths.parse_s3(F.col("u"))
    return pages(spark, sf).withColumn("u", u).select("page_id", bucket.alias("bucket"), key.alias("key"))


@query(
    "az_addresses",
    sql=f"""
    select page_id, case page_id % 4 when 3 then 'c3' else {_HOST} end as container,
      case page_id % 4 when 0 then 'a b+c/' || {_TAIL} when 1 then '' when 2 then {_TAIL} else 'x (1)' end as blob from pages""",
)
def az_addresses(spark, sf):
    u = F.expr(
        f"""case page_id % 4 when 0 then 'az://MyAcct/' || {_HOST} || '/a%20b+c/' || {_TAIL} when 1 then 'az://' || {_HOST}
        when 2 then 'https://acct.blob.core.windows.net/' || {_HOST} || '/' || {_TAIL} else 'c3/x%20%281%29' end"""
    )
    container, blob = paths.parse_az(F.col("u"), account="myacct")
    return pages(spark, sf).withColumn("u", u).select("page_id", container.alias("container"), blob.alias("blob"))


@query(
    "folder_segments",
    sql=f"""
    select page_id, case page_id % 4 when 0 then {_HOST} || '_' || page_id when 1 then 'root' when 2 then 'x_' || page_id else {_HOST} end as segment
    from pages""",
)
def folder_segments(spark, sf):
    f = F.expr(
        f"""case page_id % 4 when 0 then '/' || {_HOST} || '/' || page_id || '/' when 1 then case when page_id % 8 = 1 then null else '/' end
        when 2 then 's3://b/x/' || page_id else 'az://' || {_HOST} end"""
    )
    return pages(spark, sf).select("page_id", paths.folder_segment(f).alias("segment"))


@query(
    "path_parts",
    sql=f"""
    select page_id, coalesce(nullif(regexp_extract(url, '([^/]*)$', 1), ''), '') as file_name,
      case when contains(regexp_extract(url, '([^/]*)$', 1), '.') then upper(regexp_extract(url, '([^.]*)$', 1)) else 'UNKNOWN' end as file_format,
      regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') as base,
      regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) as source_object from pages""",
)
def path_parts(spark, sf):
    name = paths.file_name(F.col("url"))
    return pages(spark, sf).select(
        "page_id", name.alias("file_name"), paths.file_format(name).alias("file_format"), paths.base_name(name).alias("base"),
        paths.source_object(F.col("url")).alias("source_object"),
    )


@query(
    "joined_paths",
    sql=f"""
    select page_id, case page_id % 4 when 0 then 's3://other/' || page_id when 1 then 's3://' || {_HOST} || '/i' || page_id
      when 2 then 'az://acct/' || {_HOST} || '/i' || page_id else {_HOST} || '/i' || page_id end as joined from pages""",
)
def joined_paths(spark, sf):
    src = F.expr(
        f"""case page_id % 4 when 1 then 's3://' || {_HOST} || '/deep/er' when 2 then 'az://acct/' || {_HOST} || '/deep'
        else '/' || {_HOST} || '/' end"""
    )
    item = F.expr("case page_id % 4 when 0 then 's3://other/' || page_id else '/i' || page_id end")
    return pages(spark, sf).select("page_id", paths.join_source_path(src, item).alias("joined"))


@query(
    "relative_and_search_paths",
    sql=f"""
    select page_id, {_TAIL} as relative,
      case page_id % 3 when 0 then 'lake/x/' || {_HOST} when 1 then 'lake/acme/y' else 'lake/acme/' || {_HOST} end as search from pages""",
)
def relative_and_search_paths(spark, sf):
    full = F.expr(f"case when page_id % 2 = 0 then 'lake/' else '' end || 'acme/' || {_TAIL}")
    folder = F.expr(f"case page_id % 3 when 0 then '/lake/x/' || {_HOST} || '/' when 1 then 'acme/y' else {_HOST} end")
    return pages(spark, sf).select(
        "page_id", paths.relative_path(full, F.lit("acme"), "lake").alias("relative"),
        paths.search_path(F.lit("acme"), folder, "/lake/").alias("search"),
    )


@query(
    "slugs",
    sql="select page_id, coalesce(nullif(trim(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), ''), 'dataset') as slug from pages",
)
def slugs(spark, sf):
    return pages(spark, sf).select("page_id", paths.slug(F.col("url")).alias("slug"))


@query(
    "catalog_names",
    sql=f"""
    select page_id, case page_id % 4 when 0 then 'dataJob' when 1 then 'dataFlow' when 2 then 'dataset' end as kind,
      case when page_id % 4 < 3 then 'glue' end as platform, case when page_id % 4 < 3 then {_HOST} end as flow_id,
      case when page_id % 4 < 3 then 'PROD' end as environment, case page_id % 4 when 0 then 'j' || page_id end as job_id,
      case page_id % 4 when 0 then 'urn:li:dataJob:(urn:li:dataFlow:(glue,' || {_HOST} || ',PROD),j' || page_id || ')'
        when 1 then 'urn:li:dataFlow:(glue,' || {_HOST} || ',PROD)'
        when 2 then 'urn:li:dataset:(urn:li:dataPlatform:glue,' || {_HOST} || ',PROD)' end as composed from pages""",
)
def catalog_names(spark, sf):
    urn = F.expr(
        f"""case page_id % 4 when 0 then 'urn:li:dataJob:(urn:li:dataFlow:(glue,' || {_HOST} || ',PROD),j' || page_id || ')'
        when 1 then 'urn:li:dataFlow:(glue,' || {_HOST} || ',PROD)'
        when 2 then 'urn:li:dataset:(urn:li:dataPlatform:glue,' || {_HOST} || ',PROD)' else url end"""
    )
    parsed = pages(spark, sf).select("page_id", paths.parse_urn(urn).alias("u"))
    return parsed.select("page_id", "u.*", paths.compose_urn(F.col("u")).alias("composed"))


@query(
    "resource_names",
    sql="""
    select page_id, case page_id % 4 when 0 then 'glue' when 1 then 's3' end as service, case page_id % 4 when 0 then 'eu-west-1' when 1 then '' end as region,
      case page_id % 4 when 0 then '123' when 1 then '' end as account_id,
      case page_id % 4 when 0 then 'job:' || url when 1 then 'bucket-' || page_id end as resource_id from pages""",
)
def resource_names(spark, sf):
    arn = F.expr(
        """case page_id % 4 when 0 then 'arn:aws:glue:eu-west-1:123:job:' || url when 1 then 'arn:aws:s3:::bucket-' || page_id
        when 2 then 'arn:aws:s3' else 'urn:aws:glue:a:b:c' end"""
    )
    parsed = pages(spark, sf).select("page_id", paths.parse_arn(arn).alias("a"))
    return parsed.select("page_id", "a.service", "a.region", "a.account_id", "a.resource_id")


@query(
    "lenient_values",
    sql="""
    select o_orderkey, case o_orderkey % 6 when 0 then true when 1 then false when 2 then true when 3 then false end as as_bool,
      coalesce(case o_orderkey % 6 when 0 then true when 2 then true end, false) as as_active,
      case o_orderkey % 3 when 0 then o_custkey when 1 then 1234567 end as as_int,
      case o_orderkey % 3 when 0 then cast(o_custkey as double) when 1 then 1234567.0 when 2 then -2.5 end as as_float from orders""",
)
def lenient_values(spark, sf):
    b = F.expr("element_at(array(' Yes ', 'N', '1', 'FALSE', 'maybe', ''), cast(o_orderkey % 6 as int) + 1)")
    n = F.expr("case o_orderkey % 3 when 0 then cast(o_custkey as string) when 1 then ' 1,234,567' else '-2.5' end")
    return table(spark, sf, "orders").select(
        "o_orderkey", lenient.boolean(b).alias("as_bool"), lenient.active_flag(b).alias("as_active"),
        lenient.integer(n).alias("as_int"), lenient.floating(n).alias("as_float"),
    )


@query(
    "iso_timestamps",
    sql="""
    select event_id, case event_id % 5 when 0 then ts when 1 then ts - interval 2 hour when 2 then date_trunc('day', ts)
      when 3 then date_trunc('second', ts) end as parsed from events""",
)
def iso_timestamps(spark, sf):
    t = F.expr(
        """case event_id % 5 when 0 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") || '789Z'
        when 1 then date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') || '+02:00' when 2 then date_format(ts, 'yyyy-MM-dd')
        when 3 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") else 'soon' end"""
    )
    out = table(spark, sf, "events").select("event_id", lenient.iso_timestamp(t).alias("p"))
    return out.select("event_id", F.expr("convert_timezone('UTC', cast(p as timestamp_ntz))").alias("parsed"))


@query(
    "masked_secrets",
    sql="select c_custkey, repeat('*', greatest(length(c_name) - 4, 0)) || right(c_name, 4) as masked, right('abc', 4) as short from customer",
)
def masked_secrets(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", lenient.mask_secret(F.col("c_name")).alias("masked"), lenient.mask_secret(F.lit("abc")).alias("short")
    )


@query(
    "name_aliases",
    sql="""
    select p_partkey, case p_partkey % 5 when 0 then 'AWS' when 1 then 'AZURE' when 2 then 'REST_API' when 3 then upper(p_type) end as source_type,
      case p_partkey % 4 when 0 then 'AWS' when 1 then 'FABRIC' when 2 then 'AZURE' end as platform,
      case p_partkey % 3 when 0 then 'txt' when 1 then 'csv' else lower(p_type) end as fmt from part""",
)
def name_aliases(spark, sf):
    s = F.expr("case p_partkey % 5 when 0 then ' s3' when 1 then 'ADLS' when 2 then 'rest' when 3 then p_type else '  ' end")
    p = F.expr("case p_partkey % 4 when 0 then 'amazon' when 1 then 'MsFabric ' when 2 then 'microsoft' else p_type end")
    f = F.expr("case p_partkey % 3 when 0 then 'Text' when 1 then 'DelimitedText' else p_type end")
    return table(spark, sf, "part").select(
        "p_partkey", lenient.source_type(s).alias("source_type"), lenient.platform(p).alias("platform"), lenient.file_format(f).alias("fmt")
    )
