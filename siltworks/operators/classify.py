"""Multi-label classification of texts and definitions by ordered catalogs.

A catalog becomes one projection: every label is one boolean expression, so a table of texts is scanned once and
without a join, however long the texts are.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions import labels as L
from siltworks.functions.text import contains_any, find_all, first_match
from siltworks.operators.exploding import explode_once
from siltworks.operators.literals import literal_table
from siltworks.operators.scans import spread

Catalog = Sequence[tuple[str, Sequence[str]]]


def required_text(pattern: str) -> str:
    """The longest literal that every match of a pattern contains, empty if none is certain.

    A plain substring search is far cheaper than a pattern, and most texts contain few of the words.  Nothing is taken as
    certain in a pattern with counted repetitions or with groups inside groups."""
    if re.search(r"(?<!\\)\{|\([^()]*\(", pattern):
        return ""
    # classes, groups and escapes end a run of literal characters; an optional character is no part of it
    plain = re.sub(r"\\b", "\0", pattern)
    plain = re.sub(r"\[[^\]]*\][*+?]?|\([^)]*\)[*+?]?|\\[dswDSW][*+?]?|\.[*+?]*|.[*?]", "\0", re.sub(r"\\([^\w\s])", "\0", plain))
    return "" if "|" in plain else max(re.split(r"[^\w/: -]", plain), key=len)


def _occurs(low: Column, pattern: str) -> Column:
    # texts are lower-cased, so a pattern tried without regard to case is one in lower case
    need = required_text(pattern)
    return low.contains(need) & low.rlike(pattern) if need else low.rlike(pattern)


def _lowered(pattern: str) -> str:
    """The pattern in lower case but for its escapes: `\\S` and `\\s` are opposites."""
    return re.sub(r"(\\.)|([A-Z])", lambda m: m[1] or m[2].lower(), pattern)


def _patterns(patterns: Sequence[str], ignore_case: bool) -> list[str]:
    return [_lowered(p) if ignore_case else p for p in patterns]


def hits(low: Column, catalog: Catalog, ignore_case: bool = False) -> Column:
    """array<struct<label, pattern>>: each label whose pattern occurs, with the first pattern that does.

    `low` is the text in lower case."""

    def first_pattern(patterns: Sequence[str]) -> Column:
        out = None
        for p in patterns:
            cond = _occurs(low, _lowered(p) if ignore_case else p)
            out = F.when(cond, F.lit(p)) if out is None else out.when(cond, F.lit(p))
        return out

    found = [F.struct(F.lit(name).alias("label"), first_pattern(patterns).alias("pattern")) for name, patterns in catalog]
    return F.filter(F.array(*found), lambda h: h["pattern"].isNotNull())


def found_labels(low: Column, catalog: Catalog, ignore_case: bool = False) -> Column:
    """array<string> of the labels of which any pattern occurs in `low`, the text in lower case."""

    def any_of(patterns: Sequence[str]) -> Column:
        return reduce(lambda a, b: a | b, [_occurs(low, p) for p in _patterns(patterns, ignore_case)])

    return F.array_compact(F.array(*[F.when(any_of(patterns), F.lit(name)) for name, patterns in catalog]))


def combinations(found: Column) -> Column:
    """Combination labels whose required labels are all there."""
    return F.array_compact(F.array(*[
        F.when(F.size(F.array_except(F.array(*[F.lit(r) for r in required]), found)) == 0, F.lit(label))
        for required, label in L.COMBINATIONS
    ]))


def with_labels(df: DataFrame, text: str, kinds: Sequence[str]) -> DataFrame:
    """Add one array of labels per kind: frameworks (with combinations), sources, ingestion, checks.

    All kinds share one scan and one lower-cased copy of the text.
    """
    low = F.col("_low")
    build = {
        "frameworks": lambda: found_labels(low, L.FRAMEWORKS),
        "sources": lambda: found_labels(low, L.SOURCES),
        "ingestion": lambda: found_labels(low, L.INGESTION, ignore_case=True),
        "checks": lambda: checks(F.col(text), low),
    }
    out = spread(df).withColumn("_low", F.lower(text)).withColumns({k: build[k]() for k in kinds}).drop("_low")
    if "frameworks" in kinds:
        # a second step, so that the labels are found once and not again for each combination
        out = out.withColumn("frameworks", F.concat("frameworks", combinations(F.col("frameworks"))))
    return out


def suite_label(low: Column) -> Column:
    """The suite label of the first suite pattern that hits, with the suite's name where the pattern gives one."""
    out = None
    for p in L.SUITE_PATTERNS:
        named = "([^" in p
        label = F.concat(F.lit("Great Expectations Suite: "), F.regexp_extract(low, p, 1)) if named else F.lit("Great Expectations")
        out = F.when(_occurs(low, p), label) if out is None else out.when(_occurs(low, p), label)
    return out


def expectation_types(text: Column) -> Column:
    return F.array_distinct(find_all(text, r'"expectation_type"\s*:\s*"([^"]+)"', 1))


def expectation_labels(types: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in L.EXPECTATIONS.items() for x in kv])
    return F.transform(types, lambda t: F.coalesce(F.element_at(known, t), F.concat(F.lit("GE: "), t)))


def checks(text: Column, low: Column) -> Column:
    """Data-quality tools and checks a text mentions: suite, expectations, SQL checks, tools."""
    return F.concat(
        F.array_compact(F.array(suite_label(low))),
        expectation_labels(expectation_types(text)),
        found_labels(low, L.SQL_CHECKS, ignore_case=True),
        found_labels(low, L.CHECK_TOOLS, ignore_case=True),
    )


def confidence(found: Column, kind: str) -> Column:
    return F.when(F.size(found) > 0, F.lit(L.CONFIDENCE[kind])).otherwise(F.lit(0.0))


def urn_platform(urn: Column) -> Column:
    tail = F.substring_index(F.substring_index(urn, "dataPlatform:", -1), ",", 1)
    return F.when(urn.contains("dataPlatform:"), F.btrim(tail, F.lit(")"))).otherwise(urn)


def urn_framework(urn: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in L.PLATFORM_FRAMEWORKS.items() for x in kv])
    return F.element_at(known, F.lower(urn_platform(urn)))


def urn_source(urn: Column) -> Column:
    low = F.lower(urn)
    out = F.when(low.contains(L.URN_SOURCES[0][0]), L.URN_SOURCES[0][1])
    for token, label in L.URN_SOURCES[1:]:
        out = out.when(low.contains(token), label)
    return out


def job_type(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in L.JOB_TYPES.items() for x in kv]), kind)


def support_matrix(detected: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Every catalogued source with its support level and the number of rows that name it."""
    spark = detected.sparkSession
    known = dict.fromkeys([n for n, _ in L.SOURCES] + list(L.EXTRACTABLE_SOURCES))
    rows = [(n, "supported" if n in L.EXTRACTABLE_SOURCES else "detected_only") for n in known]
    catalog = literal_table(spark, rows, "name string, support_level string")
    counts = detected.groupBy(F.col(label).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return catalog.join(counts, "name", "left").select(
        "name", "support_level", F.col("n").isNotNull().alias("detected"), F.coalesce("n", F.lit(0)).alias("n")
    )


def load_strategy(text: Column) -> tuple[Column, Column]:
    """(primary strategy, signals map) of a definition text."""
    t = F.lower(text)
    signals = {
        "append": contains_any(t, ("append", "insert")),
        "merge": contains_any(t, ("merge", "upsert")),
        "truncate": t.contains("truncate"),
        "cdc": contains_any(t, ("cdc", "changefeed")),
        "incremental": contains_any(t, ("watermark", "incremental", "lastmodified", "modifieddate")),
        "full_load": contains_any(t, ("full", "truncate")),
    }
    primary = None
    for name in ("merge", "incremental", "append", "full_load"):
        primary = F.when(signals[name], name) if primary is None else primary.when(signals[name], name)
    return primary, F.create_map(*[x for k, v in signals.items() for x in (F.lit(k), v)])


def capability_matrix(df: DataFrame, key: Sequence[str], text: str, node_types: str, node_ids: str, rules: str) -> DataFrame:
    """(key, capability, status) for seven capabilities.

    `node_types` and `node_ids` are arrays of a definition's node types and names, `rules` an array of check labels.
    """
    types = F.transform(node_types, F.lower)
    ids = F.lower(F.array_join(node_ids, "\n"))
    low = F.lower(text)

    def typed(*wanted: str) -> Column:
        return F.arrays_overlap(types, F.array(*[F.lit(w) for w in wanted]))

    def yes_no(c: Column) -> Column:
        return F.when(c, "SUPPORTED").otherwise("NOT_SUPPORTED")

    quality = F.when(F.size(rules) > 0, "SUPPORTED").when(
        typed("ifcondition", "condition") | ids.contains("condition"), "PARTIAL"
    ).otherwise("NOT_SUPPORTED")
    cells = {
        "API Ingestion": yes_no(typed("webactivity") | contains_any(ids, ("http", "rest"))),
        "File Ingestion": yes_no(contains_any(low, L.FILE_TOKENS)),
        "Database/Table Ingestion": yes_no(contains_any(low, L.DATABASE_TOKENS)),
        "Batch Processing": yes_no(typed("foreach", "until") | contains_any(ids, ("foreach", "loop"))),
        "Streaming": yes_no(contains_any(low, L.STREAM_TOKENS)),
        "Data Quality": quality,
        "Notifications": yes_no(contains_any(ids, ("email", "alert", "notification"))),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("capability"), v.alias("status")) for k, v in cells.items()])
    return explode_once(df, key, rows, "c").select(*key, "c.*")


def capability_counts(matrix: DataFrame, by: Sequence[str]) -> DataFrame:
    return matrix.groupBy(*by).agg(*[
        F.count_if(F.col("status") == s).alias(n)
        for s, n in (("SUPPORTED", "supported_count"), ("PARTIAL", "partial_count"), ("NOT_SUPPORTED", "not_supported_count"))
    ])


def storage_kind(text: Column) -> Column:
    t = F.lower(text)
    return (
        F.when(contains_any(t, ("http", "rest", "relativeurl", "baseurl", "webactivity")), "REST API")
        .when(contains_any(t, ("warehouse", "sql", "jdbc", "table")), "Warehouse")
        .when(contains_any(t, ("lakehouse", "onelake", "deltalake", "adls", "blob", "file")), "Lakehouse")
        .when(t.contains("notebook"), "Notebook")
        .otherwise("Unknown")
    )


def ingestion_evidence(activities: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """First activity per ingestion type: web calls, and the formats and stores copies read or write."""
    kind = F.lower("type")
    body = F.lower(F.coalesce("definition", F.lit("")))
    copies = kind.contains("copy")

    def note(when: Column, label: str) -> Column:
        return F.when(when, F.lit(label))

    notes = F.array_compact(F.array(
        note(kind.contains("web"), "REST API"),
        note(copies & body.contains("json"), "JSON"),
        note(copies & body.contains("delimitedtext"), "DelimitedText"),
        note(copies & body.contains("lakehouse"), "Lakehouse"),
        note(copies & body.contains("warehouse"), "DataWarehouse"),
    ))
    first = F.struct(F.col(order).alias("o"), F.col("name").alias("n")).alias("s")
    rows = explode_once(activities, [*by, first], notes, "ingestion_type")
    return rows.groupBy(*by, "ingestion_type").agg(F.min("s")["n"].alias("activity"))


def ingestion_mode(text: Column) -> Column:
    return F.when(contains_any(F.lower(text), ("stream", "streaming", "eventhub", "kafka")), "streaming").otherwise("batch")


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def trigger_and_frequency(trigger: Sequence[Column], frequency: Sequence[Column], recurrence: Column) -> tuple[Column, Column]:
    """First filled trigger and frequency fields; a recurrence (JSON) implies a schedule."""
    t = F.coalesce(first_filled(*trigger), F.when(recurrence.isNotNull(), "schedule"))
    f = F.coalesce(
        first_filled(*frequency),
        first_filled(F.get_json_object(recurrence, "$.frequency"), F.get_json_object(recurrence, "$.interval")),
    )
    return F.lower(t), f


def data_formats(explicit: Column, text: Column, dataset_formats: Column) -> Column:
    """Explicit format, formats the text names, then formats of the datasets; each once."""
    t = F.lower(text)
    named = [F.when(t.contains(n), shown) for n, shown in (("parquet", "PARQUET"), ("json", "JSON"), ("csv", "CSV"), ("delta", "Delta"))]
    lists = F.concat(F.array(first_filled(explicit), *named), F.coalesce(dataset_formats, F.array().cast("array<string>")))
    return F.array_distinct(F.array_compact(lists))


def recommended_checks(flags: dict[str, Column]) -> Column:
    """array<string> of checks a definition calls for; flags by signal name."""
    wanted = (
        ("metadata_driven", "Metadata controller row validation"),
        ("incremental", "Watermark freshness validation"),
        ("retries", "Retry outcome audit validation"),
        ("copies", "Copy boundary reconciliation"),
        ("notebooks", "Notebook output validation"),
        ("api_sources", "Endpoint response validation"),
    )
    return F.array_compact(F.array(*[F.when(flags[k], F.lit(v)) for k, v in wanted if k in flags]))


def check_labels(text: Column, expectations: Column) -> Column:
    """Check labels of expectations (array<struct<type, column>>), then of the phrases a text has; each once."""
    known = F.create_map(*[F.lit(x) for kv in L.EXPECTATION_CHECKS for x in kv])
    from_rules = F.transform(
        F.filter(expectations, lambda e: F.element_at(known, e["type"]).isNotNull()),
        lambda e: F.concat(F.element_at(known, e["type"]), F.lit(":"), F.coalesce(e["column"], F.lit("column"))),
    )
    t = F.lower(text)
    phrases = F.array_compact(F.array(*[F.when(t.contains(p), F.lit(v)) for p, v in L.CHECK_PHRASES]))
    return F.array_distinct(F.concat(from_rules, phrases))


def keyword_profile(text: Column, default_framework: str = "Azure Data Factory") -> dict[str, Column]:
    """Framework, ingestion support, file types and checks of one definition text, by keywords."""
    t = F.lower(text)
    framework = (
        F.when(contains_any(t, ("fabric", "lakehouse")), "Microsoft Fabric")
        .when(contains_any(t, ("databricks", "spark")), "Databricks")
        .when(contains_any(t, ("adf", "typeproperties")), "Azure Data Factory")
        .when(contains_any(t, ("glue", "lambda")), "AWS Glue")
        .otherwise(default_framework)
    )
    files = contains_any(t, ("csv", "json", "parquet", "blob", "s3", "adls", "delimitedtext", "storage"))
    api = contains_any(t, ("webactivity", "http", "rest", "graphql", "apigateway"))
    database = contains_any(t, ("sql", "jdbc", "datawarehouse", "table", "warehousetable", "database"))
    none = ~(files | api | database)
    types = [F.when(c, F.lit(n)) for n, c in (
        ("CSV", contains_any(t, ("csv", "delimited"))), ("JSON", t.contains("json")),
        ("Parquet", t.contains("parquet")), ("Excel", t.contains("excel")),
    )]
    return {
        "framework": framework,
        "file_based": files | none,
        "api": api,
        "database": database,
        "streaming": contains_any(t, ("kafka", "eventhub", "stream", "kinesis")),
        "batch": contains_any(t, ("foreach", "until", "loop", "batch", "lambda")) | none,
        "file_types": F.array_compact(F.array(*types)),
        "schema_check": contains_any(t, ("schema", "validation", "datatype")),
        "null_check": t.contains("null"),
        "duplicate_check": contains_any(t, ("duplicate", "distinct")),
        "type_check": contains_any(t, ("datatype", "cast")),
    }


def ingestion_types(activities: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Ingestion types and input/output file types per definition, from its activity rows.

    `source_type`/`sink_type` are dataset types.  File types are first reduced to one row per type, so the lists
    stay as short as the list of known types.
    """
    body = F.lower(F.coalesce("definition", F.lit("")))
    shown = F.create_map(*[F.lit(x) for x in ("delimitedtext", "DelimitedText", "json", "JSON", "parquet", "Parquet")])

    def kind(c: str) -> Column:
        return F.element_at(shown, F.lower(F.trim(c)))

    file_sets = F.lower("source_type").isin("delimitedtext", "json", "parquet") | F.lower("sink_type").isin("delimitedtext", "json", "parquet")
    flags = activities.groupBy(*by).agg(
        F.bool_or(contains_any(F.concat_ws(" ", F.lower("type"), body), ("webactivity", "http", "rest", "graphql"))).alias("a"),
        F.bool_or(F.coalesce(file_sets, F.lit(False)) | contains_any(body, ("blob", "s3", "adls", "onelake", "lakehouse", "file"))).alias("f"),
        F.bool_or(contains_any(body, ("sql", "jdbc", "datawarehouse", "table"))).alias("d"),
        F.bool_or(contains_any(body, ("kafka", "eventhub", "kinesis"))).alias("s"),
        *[F.min(F.when(kind(side) == v, F.col(order))).alias(f"{side}_{v}") for side in ("source_type", "sink_type") for v in ("DelimitedText", "JSON", "Parquet")],
    )

    def ordered(side: str) -> Column:
        pairs = [F.when(F.col(f"{side}_{v}").isNotNull(), F.struct(F.col(f"{side}_{v}").alias("o"), F.lit(v).alias("v"))) for v in ("DelimitedText", "JSON", "Parquet")]
        return F.transform(F.array_sort(F.array_compact(F.array(*pairs))), lambda p: p["v"])

    inputs = ordered("source_type")
    types = F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in (("a", "API"), ("f", "File-based"), ("d", "Database"), ("s", "Streaming"))]))
    return flags.select(
        *by, types.alias("ingestion_types"),
        F.when(F.col("a") & (F.size(inputs) == 0), F.array(F.lit("JSON"))).otherwise(inputs).alias("input_types"),
        ordered("sink_type").alias("output_types"),
    )


def bucket_counts(df: DataFrame, text: str, by: Sequence[str]) -> DataFrame:
    """S3 paths named in texts and the buckets they are in, counted by a keyed aggregate."""
    paths = explode_once(df, by, find_all(F.col(text), r"""(?i)s3[an]?://[^\s"'>,]+"""), "path")
    return paths.groupBy(*by, first_match(F.col("path"), r"^(?i)s3[an]?://([^/]+)", 1).alias("bucket")).agg(
        F.count(F.lit(1)).alias("path_count")
    )
