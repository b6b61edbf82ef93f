"""Columns that take apart and build object paths, URLs and resource names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _after(c: Column, sep: str) -> Column:
    """Text behind the first `sep`, empty where there is none."""
    return F.when(F.locate(sep, c) > 0, F.substring(c, F.locate(sep, c) + len(sep), F.length(c))).otherwise("")


def _before(c: Column, sep: str) -> Column:
    return F.substring_index(c, sep, 1)


def strip_slashes(c: Column) -> Column:
    return F.btrim(c, F.lit("/"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Lower-case extension, empty if there is none."""
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def file_format(name: Column) -> Column:
    """Upper-case extension, UNKNOWN if there is none."""
    return F.coalesce(F.nullif(F.upper(extension(name)), F.lit("")), F.lit("UNKNOWN"))


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def source_object(path: Column) -> Column:
    clean = F.rtrim(F.coalesce(path, F.lit("")), F.lit("/"))
    return F.coalesce(F.nullif(file_name(clean), F.lit("")), F.lit("detected_source"))


def dataset_id(client: Column, source: Column, path: Column) -> Column:
    spelled = F.concat(F.lower(F.trim(client)), F.upper(F.trim(source)), F.replace(F.lower(F.trim(path)), F.lit(" "), F.lit("_")))
    return F.sha2(spelled, 256)


def parse_s3(url: Column) -> tuple[Column, Column]:
    """(bucket, key) of s3://b/k, https://b.s3.region/k, https://s3.region/b/k or plain b/k."""
    u = F.replace(F.trim(url), F.lit("s3:// "), F.lit("s3://"))
    scheme = u.startswith("s3://")
    http = u.contains("amazonaws.com") & u.contains("s3") & ~scheme
    host = F.regexp_extract(u, r"^[a-z]+://([^/?#]*)", 1)
    path = F.ltrim(F.regexp_extract(u, r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.lit("/"))
    path_style = host.startswith("s3.")
    rest = F.when(scheme, F.substring(u, 6, F.length(u))).when(http, path).otherwise(u)
    virtual = http & ~path_style
    bucket = F.when(virtual, _before(host, ".s3")).otherwise(_before(rest, "/"))
    return bucket, F.when(virtual, path).otherwise(_after(rest, "/"))


def parse_az(url: Column, account: str = "") -> tuple[Column, Column]:
    """(container, blob) of az://[account/]c/b or https://account.blob.core.windows.net/c/b; the blob is decoded."""
    host = ".blob.core.windows.net/"
    rest = F.ltrim(
        F.when(url.startswith("az://"), F.substring(url, 6, F.length(url)))
        .when(url.contains(host[:-1]), F.when(F.locate(host, url) > 0, F.substring_index(url, host, -1)).otherwise(url))
        .otherwise(url)
    )
    if account:
        rest = F.when(F.lower(_before(rest, "/")) == account.lower(), _after(rest, "/")).otherwise(rest)
    blob = _after(rest, "/")
    # a plus sign in a blob name is a plus sign
    return _before(rest, "/"), F.coalesce(F.try_url_decode(F.replace(blob, F.lit("+"), F.lit("%2B"))), blob)


def folder_segment(folder: Column) -> Column:
    """A folder as one path segment: a/b -> a_b, empty -> root; of a storage URI only the part behind the bucket."""
    f = strip_slashes(F.coalesce(folder, F.lit("")))
    uri = f.startswith("az://") | f.startswith("s3://")
    rest = F.substring(f, 6, F.length(f))
    inner = F.when(uri, F.when(rest.contains("/"), _after(rest, "/")).otherwise(rest)).otherwise(f)
    return F.coalesce(F.nullif(F.replace(strip_slashes(inner), F.lit("/"), F.lit("_")), F.lit("")), F.lit("root"))


def join_source_path(source_path: Column, item: Column) -> Column:
    tail = F.ltrim(item, F.lit("/"))
    bucket = F.regexp_extract(source_path, r"^s3://([^/]*)", 1)
    account = F.regexp_extract(source_path, r"^az://([^/]*(?:/[^/]*)?)", 1)
    return (
        F.when(item.startswith("s3://") | item.startswith("az://"), item)
        .when(source_path.startswith("s3://"), F.concat(F.lit("s3://"), bucket, F.lit("/"), tail))
        .when(source_path.startswith("az://"), F.concat(F.lit("az://"), account, F.lit("/"), tail))
        .otherwise(strip_slashes(F.concat(F.rtrim(source_path, F.lit("/")), F.lit("/"), tail)))
    )


def relative_path(path: Column, client: Column, root: str = "") -> Column:
    """Path without the storage root and the client prefix."""

    def drop(p: Column, prefix: Column) -> Column:
        return F.when(F.startswith(p, prefix), F.substring(p, F.length(prefix) + 1, F.length(p))).otherwise(p)

    root = root.strip("/")
    out = drop(path, F.lit(root + "/")) if root else path
    return drop(out, F.concat(client, F.lit("/")))


def search_path(client: Column, folder: Column, root: str = "") -> Column:
    """Root, client and folder as one path, none of them twice."""
    root = root.strip("/")
    raw = F.coalesce(folder, F.lit(""))
    bare = strip_slashes(raw)
    name = F.coalesce(client, F.lit(""))

    def part(c: Column) -> Column:
        return F.when(strip_slashes(c) != "", c)

    lead = [F.lit(root)] if root else []
    has_client = (name != "") & F.startswith(bare, F.concat(name, F.lit("/")))
    out = F.when(has_client, F.concat_ws("/", *lead, bare)).otherwise(F.concat_ws("/", *lead, part(name), part(raw)))
    return F.when(bare.startswith(root + "/"), bare).otherwise(out) if root else out


def slug(value: Column, default: str = "dataset") -> Column:
    cleaned = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.btrim(cleaned, F.lit("._-")), F.lit("")), F.lit(default))


# Fixed formats of catalog names.
_JOB = r"^urn:li:dataJob:\(urn:li:dataFlow:\(([^,]+),([^,]+),([^)]+)\),([^)]+)\)$"
_FLOW = r"^urn:li:dataFlow:\(([^,]+),([^,]+),([^)]+)\)$"
_TABLE = r"^urn:li:dataset:\(urn:li:dataPlatform:([^,]+),([^,]+),([^)]+)\)$"


def parse_urn(urn: Column) -> Column:
    """struct(kind, platform, flow_id, environment, job_id); null for anything else."""

    def fields(kind: str, pattern: str, job: bool) -> Column:
        g = [F.regexp_extract(urn, pattern, i) for i in range(1, 5 if job else 4)]
        return F.struct(
            F.lit(kind).alias("kind"), g[0].alias("platform"), g[1].alias("flow_id"), g[2].alias("environment"),
            (g[3] if job else F.lit(None).cast("string")).alias("job_id"),
        )

    return (
        F.when(urn.rlike(_JOB), fields("dataJob", _JOB, True))
        .when(urn.rlike(_FLOW), fields("dataFlow", _FLOW, False))
        .when(urn.rlike(_TABLE), fields("dataset", _TABLE, False))
    )


def compose_urn(parsed: Column) -> Column:
    flow = F.format_string("urn:li:dataFlow:(%s,%s,%s)", parsed["platform"], parsed["flow_id"], parsed["environment"])
    return (
        F.when(parsed["kind"] == "dataJob", F.format_string("urn:li:dataJob:(%s,%s)", flow, parsed["job_id"]))
        .when(parsed["kind"] == "dataFlow", flow)
        .when(
            parsed["kind"] == "dataset",
            F.format_string("urn:li:dataset:(urn:li:dataPlatform:%s,%s,%s)", parsed["platform"], parsed["flow_id"], parsed["environment"]),
        )
    )


def parse_arn(arn: Column) -> Column:
    """struct(service, region, account_id, resource_id); null without six parts, service or resource."""
    parts = F.split(arn, ":")
    resource = F.array_join(F.slice(parts, 6, F.greatest(F.size(parts) - 5, F.lit(0))), ":")
    ok = (F.size(parts) >= 6) & (F.get(parts, F.lit(0)) == "arn") & (F.get(parts, F.lit(2)) != "") & (resource != "")
    return F.when(
        ok,
        F.struct(
            F.get(parts, F.lit(2)).alias("service"), F.get(parts, F.lit(3)).alias("region"),
            F.get(parts, F.lit(4)).alias("account_id"), resource.alias("resource_id"),
        ),
    )


def path_related(stored: Column, wanted: Column) -> Column:
    """Equal paths, or one the parent of the other, whatever the case."""
    s, t = strip_slashes(F.lower(stored)), strip_slashes(F.lower(wanted))
    return (s == t) | F.startswith(s, F.concat(t, F.lit("/"))) | F.startswith(t, F.concat(s, F.lit("/")))


def ancestors(path: Column) -> Column:
    """The path and all of its parents, lower-case and without outer slashes."""
    parts = F.split(strip_slashes(F.lower(path)), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
