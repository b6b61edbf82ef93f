"""The dataset catalog as a table: rows from inventories, merges, searches and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions import lenient, paths
from siltworks.operators.exploding import explode_map_once, explode_once
from siltworks.operators.keyed import first_per_key
from siltworks.operators.standardize import conform
from siltworks.operators.upsert import first_by_marker
from siltworks.plans.schemas import CATALOG_COLUMNS, CATALOG_HUMAN, CATALOG_REQUIRED, CATALOG_SYSTEM


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def catalog_rows(inventory: DataFrame, source_folder: Column, batch_id: str, root: str, now: Column) -> DataFrame:
    """One inactive catalog row per inventoried file."""
    path, client = F.col("file_path"), F.col("client_name")
    rows = inventory.select(
        paths.dataset_id(client, F.col("source_type"), path).alias("dataset_id"),
        F.concat(client, F.lit("_"), F.translate(path, "/.", "__")).alias("pipeline_id"),
        "client_name",
        "source_type",
        source_folder.alias("source_folder"),
        F.col("file_name").alias("source_object"),
        "file_format",
        path.alias("raw_layer_path"),
        F.concat(F.lit(f"{root}/Bronze/"), client, F.lit("/"), path, F.lit("/")).alias("target_layer_bronze"),
        F.concat(F.lit(f"{root}/Silver/"), client, F.lit("/"), path, F.lit("/")).alias("target_layer_silver"),
        F.lit(False).alias("is_active"),
        F.lit(batch_id).alias("last_seen_batch"),
        now.alias("created_at"),
    )
    return conform(rows, CATALOG_COLUMNS, {"updated_at": "timestamp"})


def missing_columns(df: DataFrame, required: Sequence[str] = CATALOG_REQUIRED) -> list[str]:
    return [c for c in required if c not in df.columns]


def fold_incoming(incoming: DataFrame, order: str) -> DataFrame:
    """One row per dataset: system fields of the last row, the last filled value of each human field."""
    o = F.col(order)

    def last(c: str, when: Column) -> Column:
        return F.max(F.when(when, F.struct(o.alias("o"), F.trim(F.col(c)).alias("v"))))["v"].alias(c)

    active = lenient.active_flag(F.col("is_active").cast("string"))
    named = incoming.where(_filled(F.col("dataset_id")).isNotNull()).withColumn("dataset_id", F.trim("dataset_id"))
    return named.groupBy("dataset_id").agg(
        *[last(c, F.lit(True)) for c in CATALOG_SYSTEM],
        *[last(c, _filled(F.col(c)).isNotNull()) for c in CATALOG_HUMAN],
        F.max(F.when(F.col("is_active").isNotNull(), F.struct(o.alias("o"), active.alias("v"))))["v"].alias("is_active"),
    )


def merge_catalog(existing: DataFrame, incoming: DataFrame, order: str, now: Column) -> DataFrame:
    """Catalog after a sync, with `action` (insert, update, keep).

    System columns are overwritten.  What people set (load type, key, watermark, partition, active) changes only
    where the incoming value is filled.  `created_at` stays.  Rows without an id are skipped (see `skipped`).
    """
    new = fold_incoming(incoming, order).select(*[F.col(c).alias(f"n_{c}") for c in ("dataset_id", *CATALOG_SYSTEM, *CATALOG_HUMAN, "is_active")])
    both = existing.join(new, F.col("dataset_id") == F.col("n_dataset_id"), "full_outer")
    arrived, known = F.col("n_dataset_id").isNotNull(), F.col("dataset_id").isNotNull()
    out = {"dataset_id": F.coalesce("dataset_id", "n_dataset_id")}
    for c in CATALOG_SYSTEM:
        out[c] = F.when(arrived, F.col(f"n_{c}")).otherwise(F.col(c))
    for c in CATALOG_HUMAN:
        out[c] = F.coalesce(f"n_{c}", c)
    out["is_active"] = F.coalesce("n_is_active", "is_active", F.lit(False))
    out["created_at"] = F.when(known, F.col("created_at")).otherwise(now)
    out["updated_at"] = F.when(known & arrived, now).otherwise(F.col("updated_at"))
    action = F.when(~known, "insert").when(arrived, "update").otherwise("keep")
    return both.select(*[out[c].alias(c) for c in CATALOG_COLUMNS], action.alias("action"))


def merge_counts(merged: DataFrame, incoming: DataFrame) -> DataFrame:
    """(action, n): inserts and updates of a merge, and the incoming rows skipped for want of an id."""
    done = merged.where("action <> 'keep'").groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    skipped = incoming.where(_filled(F.col("dataset_id")).isNull()).agg(F.lit("skip").alias("action"), F.count(F.lit(1)).alias("n"))
    return done.unionByName(skipped)


def generated_rows(rows: DataFrame, client: str, order: str) -> DataFrame:
    """Catalog rows from generated configurations: gaps filled by convention, the last row of an id wins."""
    obj = F.coalesce(_filled(F.col("source_object")), F.lit("detected_source"))
    base = paths.base_name(obj)
    name = F.coalesce(_filled(F.col("client_name")), F.lit(client))
    source = F.upper(F.coalesce(_filled(F.col("source_type")), F.lit("S3")))
    raw = F.coalesce(_filled(F.col("raw_layer_path")), F.col("source_folder"), F.lit(""))
    full = rows.select(
        F.coalesce(_filled(F.col("dataset_id")), paths.dataset_id(name, source, raw)).alias("dataset_id"),
        name.alias("client_name"),
        source.alias("source_type"),
        F.col("source_folder"),
        obj.alias("source_object"),
        F.upper(F.coalesce(_filled(F.col("file_format")), paths.file_format(obj))).alias("file_format"),
        raw.alias("raw_layer_path"),
        F.concat(F.lit(f"Bronze/{client}/"), base).alias("target_layer_bronze"),
        F.concat(F.lit(f"Silver/{client}/"), base).alias("target_layer_silver"),
        F.lit("full").alias("load_type"),
        F.lit(True).alias("is_active"),
        F.col(order),
    )
    return first_per_key(full, ["dataset_id"], [F.desc(order)])


def remove_client(catalog: DataFrame, dq_rules: DataFrame, client: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a client, under its name and its name with underscores."""
    gone = F.col("client_name").isin(client, client.strip().replace(" ", "_"))
    ids = catalog.where(gone).select("dataset_id").distinct()
    return catalog.where(~F.coalesce(gone, F.lit(False))), dq_rules.join(ids, "dataset_id", "left_anti")


def real_scan(configs: DataFrame, rules: str, by: Sequence[str]) -> DataFrame:
    """Does any configuration of a client come from a live scan?  `rules` is the configuration's JSON."""

    def field(path: str) -> Column:
        return F.get_json_object(rules, f"$.{path}")

    auth = field("auth_mode")
    live = (
        field("scan_status").isin("success", "partial")
        & ((field("framework") == "REST API") | (field("pipeline_capabilities.api") == "true") | (~auth.isin("", "none")))
        & (F.coalesce(field("is_fallback"), F.lit("false")) != "true")
        & (F.coalesce(field("pipeline_capabilities.scan_mode"), F.lit("")) != "mock")
    )
    return configs.groupBy(*by).agg(F.bool_or(F.coalesce(live, F.lit(False))).alias("has_real_scan"), F.count(F.lit(1)).alias("configs"))


# Searches.


def find_dataset(catalog: DataFrame, dataset_id: str) -> DataFrame:
    return catalog.where(F.col("dataset_id") == dataset_id)


def discover(catalog: DataFrame, client: str, source_type: str, targets: Sequence[str] = ()) -> DataFrame:
    """Active datasets of a client and source, all or those whose id, object or folder is among the targets."""
    rows = catalog.where(F.col("is_active") & (F.col("client_name") == client) & (F.col("source_type") == source_type))
    if targets:
        t = list(targets)
        rows = rows.where(F.col("dataset_id").isin(t) | F.col("source_object").isin(t) | F.col("source_folder").isin(t))
    return rows


def match_names(catalog: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Datasets whose id, object, object without extension or folder (or a parent or child of it) is a target."""
    t = [x.strip().lower() for x in targets if x.strip()]
    obj = F.lower("source_object")
    found = F.lower("dataset_id").isin(t) | obj.isin(t) | paths.base_name(obj).isin(t)
    for x in t:
        found = found | paths.path_related(F.col("source_folder"), F.lit(x))
    return catalog.where(found)


def match_paths(catalog: DataFrame, wanted: DataFrame, path: str = "path") -> DataFrame:
    """(catalog row, wanted path) pairs where one path is the other or its parent.

    Paths are joined on equality with the other side's ancestors, so no pair of unrelated rows is ever formed.
    """
    full = F.rtrim(F.ltrim(F.lower(F.col(path)), F.lit("/")), F.lit("/"))
    w = wanted.select(F.col(path).alias("wanted"), full.alias("_w")).distinct()
    folder = F.rtrim(F.ltrim(F.lower("source_folder"), F.lit("/")), F.lit("/"))
    c = catalog.withColumn("_f", folder)
    below = c.withColumn("_a", F.explode(paths.ancestors(F.col("_f")))).join(w, F.col("_a") == F.col("_w"))
    above = c.join(w.withColumn("_a", F.explode(paths.ancestors(F.col("_w")))), (F.col("_f") == F.col("_a")) & (F.col("_f") != F.col("_w")))
    cols = [*catalog.columns, "wanted"]
    return below.select(*cols).unionByName(above.select(*cols))


def client_sources(*tables: DataFrame) -> DataFrame:
    """Distinct (client_name, source_type), canonical, over any number of tables that have both."""
    out = None
    for t in tables:
        one = t.select("client_name", lenient.source_type(F.col("source_type")).alias("source_type")).where("source_type is not null")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


# Merging sources of configuration values.


def merge_by_precedence(values: DataFrame, by: Sequence[str] = ("entity", "path")) -> DataFrame:
    """From a long table (entity, path, value, source in raw/extracted/example): the winning value, where it comes
    from, and what happened.  Raw evidence beats what was extracted; an example only fills gaps."""
    present = _filled(F.col("value")).isNotNull()
    v = values.groupBy(*by).agg(*[
        F.max(F.when(present & (F.col("source") == s), F.col("value"))).alias(s) for s in ("raw", "extracted", "example")
    ])
    raw, ext, ex = F.col("raw"), F.col("extracted"), F.col("example")
    current = F.coalesce(raw, ext)
    origin = F.when(raw.isNotNull(), "raw").when(ext.isNotNull(), "extracted").when(ex.isNotNull(), "example")
    correction = F.when(raw.isNotNull() & ext.isNull(), "filled").when(raw.isNotNull() & (raw != ext), "overruled")
    conflict = F.when(raw != ext, "raw").when(raw.isNull() & (ext != ex), "extracted")
    return v.select(
        *by, F.coalesce(current, ex).alias("value"), origin.alias("origin"), correction.alias("correction"), conflict.alias("conflict_winner")
    )


def merge_rules(rules: DataFrame, supported: DataFrame) -> DataFrame:
    """(entity, rule, origin): supported raw rules, extracted ones only where there are no raw ones, then examples."""
    ok = rules.join(supported.select("entity", "rule").distinct(), ["entity", "rule"], "left_semi")
    best = ok.groupBy("entity", "rule").agg(*[F.bool_or(F.col("source") == s).alias(s) for s in ("raw", "extracted", "example")])
    has_raw = ok.groupBy("entity").agg(F.bool_or(F.col("source") == "raw").alias("_has_raw"))
    chosen = best.join(has_raw, "entity")
    origin = (
        F.when(F.col("raw"), "raw").when(F.col("extracted") & ~F.col("_has_raw"), "extracted").when(F.col("example"), "example")
    )
    return chosen.select("entity", "rule", origin.alias("origin")).where("origin is not null")


def supported_rules(texts: DataFrame, entity: str, text: str) -> DataFrame:
    """(entity, rule): the checks a raw definition text supports."""
    t = F.lower(text)
    found = F.array_compact(F.array(
        F.when(t.contains("count(*)") | t.contains("rowcount"), "row_count_check"),
        F.when(t.contains("is null"), "null_check"),
        F.when(t.contains("duplicate") | t.contains("distinct"), "uniqueness_check"),
        F.when(t.contains("schema"), "schema_check"),
        F.when(t.contains("between") | t.contains("range"), "range_check"),
    ))
    return explode_once(texts, [F.col(entity).alias("entity")], found, "rule")


def merge_records(primary: DataFrame, secondary: DataFrame, fields: Sequence[str] = ("name", "id", "label"), order: Sequence[str] = ("ord",)) -> DataFrame:
    """Records of two sources, the primary ones first, each marker once."""
    both = primary.withColumn("_src", F.lit(0)).unionByName(secondary.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return first_by_marker(both, fields, ["_src", *order]).drop("_src")


def overlay(base: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """Base rows with every filled value of the top table laid over them."""
    extra = [c for c in top.columns if c != key]
    joined = base.join(top.select(key, *[F.col(c).alias(f"_t_{c}") for c in extra]), key, "left")

    def value(c: str) -> Column:
        return F.coalesce(_filled(F.col(f"_t_{c}")), F.col(c)).alias(c) if c in extra else F.col(c)

    return joined.select(*[value(c) for c in base.columns])


def combine_candidates(candidates: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One value per field: the only one there is, `Mixed` for several, null for none.

    Smallest and largest value tell one from several, so no list of values is built."""

    def one(c: str) -> Column:
        v = _filled(F.col(c))
        return F.when(F.min(v) == F.max(v), F.min(v)).when(F.min(v).isNotNull(), "Mixed").alias(c)

    return candidates.groupBy(*by).agg(*[one(c) for c in fields])


# Keys of an inventory that describe the scan, not assets.
SERVICE_KEYS = ("warnings", "errors", "_scan_meta", "framework", "source", "ingestion", "dq_rules")


def flatten_assets(df: DataFrame, payload: str, keep: Sequence[str] = ()) -> DataFrame:
    """(type, name, configuration): the assets under each group of a nested inventory, service keys left out."""
    groups = explode_map_once(df, keep, F.from_json(payload, "map<string,variant>"), "type", "_v")
    groups = groups.where(~F.col("type").isin(*SERVICE_KEYS))
    as_list = F.coalesce(F.col("_v").try_cast("array<variant>"), F.array("_v"))
    rows = explode_once(groups, [*keep, "type"], as_list, "_a")
    is_object = F.schema_of_variant("_a").startswith("OBJECT")

    def field(name: str) -> Column:
        return F.try_variant_get("_a", f"$.{name}", "string")

    config = F.to_json(F.coalesce(F.try_variant_get("_a", "$.configuration", "variant"), F.col("_a")))
    name = F.when(is_object, F.coalesce(_filled(field("id")), _filled(field("name")), F.col("type"))).otherwise(F.col("_a").try_cast("string"))
    return rows.select(
        *keep, "type", name.alias("name"), F.when(is_object, config).otherwise("{}").alias("configuration")
    ).where(F.coalesce("name", F.lit("")) != "")


def explode_endpoints(configs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(source_name, endpoint, full_url) from comma-separated endpoint lists of active API sources."""
    rows = configs.where("is_active").select(*keep, "source_name", "base_url", F.explode(F.split("endpoints", ",")).alias("_e"))
    return rows.withColumn("endpoint", F.trim("_e")).where("endpoint <> ''").select(
        *keep, "source_name", "endpoint", F.concat_ws("/", "base_url", "endpoint").alias("full_url")
    )


def validation_score(configs: DataFrame, key: str) -> DataFrame:
    """Mean of four part scores: service, destination, rules and flow, as text with two places.

    Columns: service_name, destination, raw_destination, rules array, supported array, flow, raw_flow.
    """
    notifies = F.lower("destination").rlike("email|teams|notification|webhook")
    source = F.when(_filled(F.col("service_name")).isNotNull(), 1.0).otherwise(0.6)
    target = F.when(notifies, 0.0).when(F.col("raw_destination").isNotNull() & ~F.col("destination").eqNullSafe(F.col("raw_destination")), 0.5).otherwise(1.0)
    rules = F.when(F.size("rules") == 0, 0.9).when(F.size(F.array_except("rules", "supported")) > 0, 0.4).otherwise(1.0)
    flow = F.when(F.col("flow") == F.col("raw_flow"), 1.0).when(_filled(F.col("flow")).isNotNull(), 0.7).otherwise(0.4)
    parts = {"source_score": source, "destination_score": target, "rules_score": rules, "flow_score": flow}
    scored = configs.select(key, *[c.alias(n) for n, c in parts.items()])
    total = F.col("source_score") + F.col("destination_score") + F.col("rules_score") + F.col("flow_score")
    return scored.withColumn("accuracy_score", two_places(total / 4))


def two_places(x: Column) -> Column:
    """A score from 0.1 to 1 as text with two places, rounded by the exact value of the double (half to even).

    Means of these scores often lie at a half in decimal, where Spark's own formats round the printed digits."""
    unit = 1 << 56
    n = (x * F.lit(float(unit))).cast("bigint") * 100  # exact: no bits below 2^-56, and under 2^63
    r = n % F.lit(unit)
    q = F.shiftright(n, 56)
    up = (r > unit // 2) | ((r == unit // 2) & (q % 2 == 1))
    hundredths = q + up.cast("bigint")
    return F.format_string("%d.%02d", F.floor(hundredths / 100), hundredths % 100)


def missing_fields(configs: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field) for every field of a configuration that has no value."""
    rows = F.array_compact(F.array(*[F.when(_filled(F.col(f).cast("string")).isNull(), F.lit(f)) for f in fields]))
    return explode_once(configs, [key], rows, "field")


def export_csv(catalog: DataFrame, path: str) -> None:
    """The catalog as comma-separated text with a header; every task writes its own file."""
    catalog.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def import_csv(spark, path: str) -> DataFrame:
    """A catalog file, all columns as text, brought into catalog shape (see ``merge_catalog``)."""
    from siltworks.sources.readers import read_delimited

    return conform(read_delimited(spark, path), CATALOG_COLUMNS)
