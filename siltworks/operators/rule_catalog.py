"""The rule catalog as a table: replace, fold, seed, suggest, recommend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.casts import EXPECTED_TYPES
from siltworks.functions.rules import SEVERITIES, known_rules
from siltworks.operators.literals import literal_table


def replace_rules(dq_rules: DataFrame, submitted: DataFrame, now: Column) -> DataFrame:
    """Deactivate every active rule of the submitted datasets and add one row per (column, rule).

    `submitted` has (dataset_id, column_name, expected_data_type, dq_rules array, rule_value, severity, is_active).
    """
    touched = submitted.select("dataset_id").distinct().withColumn("_touched", F.lit(True))
    old = dq_rules.join(touched, "dataset_id", "left")
    retire = F.col("_touched").isNotNull() & F.col("is_active")
    old = old.withColumn("updated_at", F.when(retire, now).otherwise(F.col("updated_at"))).withColumn(
        "is_active", F.col("is_active") & ~retire
    )
    new = submitted.select(
        "dataset_id",
        "column_name",
        "expected_data_type",
        F.explode("dq_rules").alias("dq_rule"),
        "rule_value",
        "severity",
        "is_active",
        now.alias("created_at"),
    )
    return old.drop("_touched").unionByName(new, allowMissingColumns=True)


def fold_rules(dq_rules: DataFrame, order: str) -> DataFrame:
    """One row per (dataset, column): last known type and severity, the active rules in order, last active value.

    A rule that occurs several times in a column is listed once, at its first place, and `active_rows` keeps the
    number of rows; so a group's list never outgrows the number of rule names.
    """
    live = F.col("is_active") & F.col("dq_rule").isNotNull()
    ord_ = F.col(order)
    base = dq_rules.withColumn("column_name", F.coalesce("column_name", F.lit("__dataset__")))
    per_rule = base.groupBy("dataset_id", "column_name", "dq_rule").agg(
        F.min(F.when(live, ord_)).alias("first"),
        F.count_if(live).alias("n"),
        F.max(F.when(F.col("expected_data_type").isNotNull(), F.struct(ord_.alias("o"), F.col("expected_data_type").alias("v")))).alias("t"),
        F.max(F.when(F.col("severity").isNotNull(), F.struct(ord_.alias("o"), F.col("severity").alias("v")))).alias("s"),
        F.max(F.when(live & F.col("rule_value").isNotNull(), F.struct(ord_.alias("o"), F.col("rule_value").alias("v")))).alias("r"),
    )
    listed = F.when(F.col("n") > 0, F.struct("first", "dq_rule"))
    return per_rule.groupBy("dataset_id", "column_name").agg(
        F.max("t")["v"].alias("expected_data_type"),
        F.transform(F.sort_array(F.collect_list(listed)), lambda x: x["dq_rule"]).alias("dq_rules"),
        F.max("r")["v"].alias("rule_value"),
        F.max("s")["v"].alias("severity"),
        (F.sum("n") > 0).alias("is_active"),
        F.sum("n").alias("active_rows"),
    )


def seed_rules(profile: DataFrame, dq_rules: DataFrame, active: bool = True) -> DataFrame:
    """NOT_NULL/WARN for profiled columns that have no rule row of any kind; or an inactive placeholder."""
    unseen = profile.join(dq_rules.select("dataset_id", "column_name").distinct(), ["dataset_id", "column_name"], "left_anti")
    rule = ("NOT_NULL", "WARN") if active else (None, None)
    return unseen.select(
        "dataset_id",
        "column_name",
        F.col("data_type").alias("expected_data_type"),
        F.lit(rule[0]).cast("string").alias("dq_rule"),
        F.lit(None).cast("string").alias("rule_value"),
        F.lit(rule[1]).cast("string").alias("severity"),
        F.lit(active).alias("is_active"),
    )


def suggest_not_null(df: DataFrame, dataset_id: str) -> DataFrame:
    """The static suggestion when nothing better is known: NOT_NULL/ERROR/STRING for every column."""
    return literal_table(
        df.sparkSession,
        [(dataset_id, c, "STRING", "NOT_NULL", None, "ERROR") for c in df.columns],
        "dataset_id string, column_name string, expected_data_type string, dq_rule string, rule_value string, severity string",
    )


def normalise_suggestions(suggestions: DataFrame) -> DataFrame:
    """Rule rows from suggested ones; `rules_json` is a JSON array of names or of {rule|name} objects.

    Names are upper-cased; unknown rules are left out, an unknown type is null, an unknown severity is ERROR.
    """
    item = F.explode(F.from_json("rules_json", "array<string>")).alias("item")
    rows = suggestions.where(F.coalesce("column_name", F.lit("")) != "").select("*", item)
    name = F.when(
        F.col("item").startswith("{"),
        F.coalesce(_nonblank(F.get_json_object("item", "$.rule")), F.get_json_object("item", "$.name")),
    ).otherwise(F.col("item"))
    kind = F.upper(F.coalesce(_nonblank(F.col("expected_data_type")), F.lit("STRING")))
    severity = F.upper(F.coalesce(_nonblank(F.col("severity")), F.lit("ERROR")))
    return rows.withColumn("dq_rule", F.upper(name)).where(F.col("dq_rule").isin(*known_rules())).select(
        "dataset_id",
        "column_name",
        F.when(kind.isin(*EXPECTED_TYPES), kind).alias("expected_data_type"),
        "dq_rule",
        "rule_value",
        F.when(severity.isin(*SEVERITIES), severity).otherwise("ERROR").alias("severity"),
        F.lit(True).alias("is_active"),
    )


def _nonblank(c: Column) -> Column:
    return F.when(c != "", c)


def accept_suggestions(dq_rules: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Suggested rules replace all rows, active or not, of the datasets they cover."""
    new = normalise_suggestions(suggestions)
    kept = dq_rules.join(new.select("dataset_id").distinct(), "dataset_id", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def reconcile(runs: DataFrame) -> DataFrame:
    """Row-count reconciliation: INFO when rows read equal rows written, else ERROR; unknown counts say nothing."""
    return runs.where("rows_read is not null and rows_written is not null").withColumn(
        "severity", F.when(F.col("rows_read") == F.col("rows_written"), "INFO").otherwise("ERROR")
    )


def recommend(profile: DataFrame, runs: DataFrame | None = None, delimiter: str | None = None, header: bool = False) -> DataFrame:
    """(dataset_id, rule, severity, column_name, reason) from profiles (dataset_id, column_name, data_type, nullable)."""
    shape = ["dataset_id", "rule", "severity", "column_name", "reason"]

    def rec(rows: DataFrame, rule: str, severity: Column, column: Column, reason: Column) -> DataFrame:
        return rows.select("dataset_id", F.lit(rule).alias("rule"), severity.alias("severity"), column.alias("column_name"), reason.alias("reason"))

    warn, nothing = F.lit("WARN"), F.lit(None).cast("string")
    col = F.col("column_name")
    out = rec(
        profile.where(~F.col("nullable")), "NOT_NULL", warn, col,
        F.concat(F.lit("column "), col, F.lit(" has no gaps")),
    )
    stamps = profile.where(is_timestamp_column(col, F.col("data_type")))
    stamps = stamps.groupBy("dataset_id").agg(F.array_join(F.sort_array(F.collect_set("column_name")), ", ").alias("cols"))
    out = out.unionByName(rec(stamps, "TIMESTAMP_PARSE", warn, nothing, F.concat(F.lit("timestamp columns: "), F.col("cols"))))
    datasets = profile.select("dataset_id").distinct()
    if delimiter:
        out = out.unionByName(rec(datasets, "DELIMITER_CONSISTENCY", warn, nothing, F.lit(f"every row uses {delimiter}")))
    if header:
        out = out.unionByName(rec(datasets, "HEADER_VALIDATION", warn, nothing, F.lit("header matches the schema")))
    if runs is not None:
        reason = F.concat_ws(" ", F.lit("read"), F.col("rows_read").cast("string"), F.lit("written"), F.col("rows_written").cast("string"))
        out = out.unionByName(rec(reconcile(runs), "ROW_COUNT_RECONCILIATION", F.col("severity"), nothing, reason))
    return out.select(*shape)


def is_timestamp_column(name: Column, data_type: Column) -> Column:
    lowered = F.lower(name)
    tokens: Sequence[str] = ("date", "time", "timestamp")
    by_name = lowered.contains(tokens[0]) | lowered.contains(tokens[1])
    return (data_type == "TIMESTAMP") | by_name
