"""Run history, activity runs and the batch report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators.exploding import explode_once
from siltworks.operators.keyed import first_n_per_key
from siltworks.plans.schemas import REPORT_COLUMNS


def run_status(succeeded: Column, failed: Column) -> Column:
    return F.when(failed == 0, "SUCCESS").when(succeeded > 0, "PARTIAL").otherwise("FAILURE")


def success_ratio(succeeded: Column, total: Column) -> Column:
    return succeeded / F.greatest(total, F.lit(1))


def batch_rollup(results: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Totals, status, success ratio and the sums of the row and rule counts per batch."""
    ok = F.col("status") == "SUCCESS"
    written = F.coalesce(F.nullif(F.col("gold_rows"), F.lit(0)), F.col("silver_rows"), F.lit(0))
    sums = results.groupBy(*by).agg(
        F.count_if(ok).alias("success_count"),
        F.count_if(F.col("status") == "FAILURE").alias("failure_count"),
        F.coalesce(F.sum(F.when(ok, F.col("raw_rows"))), F.lit(0)).alias("rows_read"),
        F.coalesce(F.sum(F.when(ok, written)), F.lit(0)).alias("rows_written"),
        F.coalesce(F.sum("dq_violations"), F.lit(0)).alias("dq_violations"),
        F.coalesce(F.sum("dq_warnings"), F.lit(0)).alias("dq_warnings"),
    )
    s, f = F.col("success_count"), F.col("failure_count")
    return sums.withColumn("total", s + f).withColumn("status", run_status(s, f)).withColumn("success_ratio", success_ratio(s, s + f))


def newest_runs(history: DataFrame, n: int, order: str) -> DataFrame:
    return history.orderBy(F.desc(order)).limit(n)


def report_rows(results: DataFrame) -> DataFrame:
    """The 15 report columns: numbers and paths for successes, the reason for failures."""
    ok = F.col("status") == "SUCCESS"

    def number(c: str) -> Column:
        return F.when(ok, F.coalesce(F.col(c).cast("string"), F.lit(""))).otherwise("")

    def text(c: str) -> Column:
        return F.when(ok, F.coalesce(F.col(c), F.lit(""))).otherwise("")

    return results.where(F.col("status").isin("SUCCESS", "FAILURE")).select(
        "status",
        F.coalesce("dataset_name", "dataset_id").alias("dataset"),
        "dataset_id",
        *[number(c).alias(c) for c in ("raw_rows", "bronze_rows", "silver_rows", "gold_rows")],
        text("gold_status").alias("gold_status"),
        text("bronze_path").alias("bronze_path"),
        text("silver_path").alias("silver_paths"),
        text("gold_path").alias("gold_paths"),
        text("rejected_path").alias("rejected_paths"),
        number("dq_violations").alias("dq_violations"),
        number("dq_warnings").alias("dq_warnings"),
        F.when(ok, "").otherwise(F.coalesce("reason", F.lit(""))).alias("reason"),
    ).select(*REPORT_COLUMNS)


def write_report(results: DataFrame, path: str) -> None:
    """One CSV file: a report has one row per dataset of a batch."""
    report_rows(results).coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="")


def status_bucket(status: Column) -> Column:
    s = F.lower(F.coalesce(status, F.lit("")))
    return (
        F.when(s.isin("completed", "succeeded", "success"), "SUCCESS")
        .when(s.isin("failed", "cancelled", "canceled"), "FAILURE")
        .otherwise("RUNNING")
    )


def throughput_mb(n_bytes: Column, duration_ms: Column) -> Column:
    """Megabytes per second, three places; unknown or zero bytes or time give none."""
    known = (n_bytes > 0) & (duration_ms > 0)
    return F.when(known, F.round(n_bytes / F.greatest(duration_ms / 1000.0, F.lit(0.001)) / (1024 * 1024), 3))


def rows_per_second(rows: Column, duration_ms: Column) -> Column:
    return rows / F.greatest(duration_ms / 1000.0, F.lit(0.001))


def _output(name: str) -> Column:
    return F.get_json_object("output", f"$.{name}")


def _input(name: str) -> Column:
    return F.get_json_object("input", f"$.{name}")


def _whole(c: Column) -> Column:
    return c.try_cast("bigint")


def rows_read() -> Column:
    return _whole(_output("rowsRead"))


def rows_written() -> Column:
    copied = _whole(_output("rowsCopied"))
    return F.coalesce(F.nullif(copied, F.lit(0)), _whole(_output("rowsWritten")), copied)


def runtime_statistics(activity_runs: DataFrame) -> DataFrame:
    """Rows, files, bytes and throughput of each activity run, read from its output payload."""
    n_bytes = F.coalesce(_output("dataRead"), _output("bytesRead")).try_cast("double")
    read, written = rows_read(), rows_written()
    return activity_runs.select(
        F.col("activityName").alias("activity"),
        read.alias("rows_read"),
        written.alias("rows_written"),
        F.coalesce(_whole(_output("filesRead")), F.when(read.isNotNull(), 1)).alias("files_read"),
        F.coalesce(_whole(_output("filesWritten")), F.when(written.isNotNull(), 1)).alias("files_written"),
        F.coalesce(_output("throughput").try_cast("double"), throughput_mb(n_bytes, F.col("durationInMs"))).alias("throughput"),
        F.nullif(F.col("durationInMs"), F.lit(0)).alias("duration_ms"),
    )


def activity_metrics(activity_runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Total, success and failure counts, retries and wall time in milliseconds."""
    s = F.lower(F.coalesce("status", F.lit("")))
    return activity_runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s.isin("completed", "succeeded")).alias("success_count"),
        F.count_if(s == "failed").alias("failure_count"),
        F.sum(F.coalesce("retryAttempt", F.lit(0))).alias("retry_count"),
        F.timestamp_diff("MILLISECOND", F.min("activityRunStart"), F.max("activityRunEnd")).alias("duration_ms"),
    )


def primary_copy(activity_runs: DataFrame, by: Sequence[str], tie_break: str) -> DataFrame:
    """The copy run that moved the most rows, then took the longest, then came first."""
    moved = F.greatest(F.coalesce(rows_read(), F.lit(0)), F.coalesce(rows_written(), F.lit(0)))
    copies = activity_runs.where(F.lower("activityType") == "copy").withColumn("moved", moved)
    order = [F.desc("moved"), F.desc(F.coalesce("durationInMs", F.lit(0))), F.asc(tie_break)]
    return first_n_per_key(copies, list(by), order, 1, "_rn").drop("_rn")


def copy_lineage(activity_runs: DataFrame) -> DataFrame:
    """Source, sink and row counts of every copy run."""

    def place(side: str) -> Column:
        return F.coalesce(*[_input(f"{side}.{k}") for k in ("path", "fileName", "table")])

    return activity_runs.where(F.lower("activityType") == "copy").select(
        F.col("activityName").alias("activity"),
        _input("source.type").alias("source_type"),
        _input("sink.type").alias("sink_type"),
        place("source").alias("source_path"),
        place("sink").alias("target_path"),
        rows_read().alias("rows_read"),
        rows_written().alias("rows_written"),
        F.coalesce(_input("source.format"), _input("sink.format")).alias("format"),
    )


def run_observations(activity_runs: DataFrame) -> DataFrame:
    """(activity, observation, evidence): row-count mismatch of a copy, a retry, a failure; one pass over the runs."""
    read, written = rows_read(), rows_written()
    is_copy = F.lower("activityType") == "copy"

    def note(when: Column, what: str, evidence: Column) -> Column:
        return F.when(when, F.struct(F.lit(what).alias("observation"), evidence.alias("evidence")))

    notes = F.array_compact(F.array(
        note(is_copy & (read != written), "Row count mismatch",
             F.concat(F.lit("rowsRead="), read.cast("string"), F.lit(" rowsWritten="), written.cast("string"))),
        note(F.col("retryAttempt") > 0, "Runtime retry detected",
             F.concat(F.lit("retryAttempt="), F.col("retryAttempt").cast("string"))),
        note(F.lower("status") == "failed", "Activity failure captured", F.get_json_object("error", "$.message")),
    ))
    return explode_once(activity_runs, [F.col("activityName").alias("activity")], notes, "n").select("activity", "n.*")


def lookups(activity_runs: DataFrame) -> DataFrame:
    return activity_runs.where(F.lower("activityType") == "lookup").select(
        F.col("activityName").alias("activity"),
        F.coalesce(_input("source.sqlReaderQuery"), _input("sqlReaderQuery")).alias("executed_sql"),
        F.coalesce(_output("value"), _output("rows"), F.lit("[]")).alias("rows"),
        _output("firstRow").alias("first_row"),
        F.coalesce(_output("structure"), _output("schema")).alias("schema"),
    )


def web_calls(activity_runs: DataFrame) -> DataFrame:
    return activity_runs.where(F.lower("activityType") == "webactivity").select(
        F.col("activityName").alias("activity"),
        _input("method").alias("method"),
        F.coalesce(_input("url"), _input("relativeUrl")).alias("url"),
        F.coalesce(_output("statusCode"), _output("statuscode")).alias("status_code"),
        F.coalesce(_output("body"), F.col("output")).alias("response"),
    )


def notebook_runs(activity_runs: DataFrame) -> DataFrame:
    return activity_runs.where(F.lower("activityType").contains("notebook")).select(
        F.col("activityName").alias("activity"),
        F.coalesce(_input("notebookId"), _input("notebook")).alias("notebook_id"),
        F.coalesce(_input("parameters"), F.lit("{}")).alias("parameters"),
        F.col("durationInMs").alias("duration_ms"),
    )


def sql_runs(activity_runs: DataFrame) -> DataFrame:
    script = F.when(F.lower("activityType") == "script", F.coalesce(_input("script"), _input("text")))
    sql = F.coalesce(_input("source.sqlReaderQuery"), _input("sqlReaderQuery"), _input("query"), script)
    return activity_runs.select(
        F.col("activityName").alias("activity"),
        F.col("activityType").alias("activity_type"),
        sql.alias("sql"),
        _whole(_output("rowsAffected")).alias("affected_rows"),
    ).where("sql is not null")


def node_status(nodes: DataFrame, last_runs: DataFrame) -> DataFrame:
    """Graph nodes (id, label) with their last run, found by label, else by id."""
    runs = last_runs.select(
        F.col("activityName").alias("_name"), F.struct("status", "durationInMs", "activityRunStart", "activityRunEnd").alias("_run")
    )
    by_label = runs.select(F.col("_name").alias("_l"), F.col("_run").alias("_by_label"))
    by_id = runs.select(F.col("_name").alias("_i"), F.col("_run").alias("_by_id"))
    joined = nodes.join(by_label, F.col("label") == F.col("_l"), "left").join(by_id, F.col("id") == F.col("_i"), "left")
    run = F.coalesce("_by_label", "_by_id")
    return joined.select(
        *nodes.columns,
        run["status"].alias("status"),
        run["durationInMs"].alias("duration_ms"),
        run["activityRunStart"].alias("start_time"),
        run["activityRunEnd"].alias("end_time"),
    )


def resolve_expressions(expressions: DataFrame, activity_runs: DataFrame) -> DataFrame:
    """Runtime values of expressions (activity, field_path, expression): chosen by what the field path is about."""
    path = F.lower("field_path")
    url = F.coalesce(_input("url"), _input("relativeUrl"))
    sql = F.coalesce(_input("source.sqlReaderQuery"), _input("sqlReaderQuery"))
    is_sql = path.contains("sqlreaderquery") | path.contains("source.query")
    from_input = (
        F.when(path.contains("url"), url).when(path.contains("items"), _input("items"))
        .when(path.contains("parameters"), _input("parameters")).when(is_sql, sql)
    )
    from_output = F.coalesce(_output("value"), _output("firstRow"))
    origin = (
        F.when(from_input.isNull(), " output").when(path.contains("url") | path.contains("items"), " input")
        .when(path.contains("parameters"), " input parameters").otherwise(" input SQL")
    )
    runs = activity_runs.select(F.col("activityName").alias("activity"), "input", "output")
    return expressions.join(runs, "activity").select(
        "activity",
        "field_path",
        "expression",
        F.coalesce(from_input, from_output).alias("resolved_value"),
        F.concat(F.col("activity"), origin).alias("resolved_from"),
    ).where("resolved_value is not null")
