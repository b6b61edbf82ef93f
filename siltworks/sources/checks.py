"""Landing checks: does a file pass into the raw layer?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import paths
from siltworks.sources.readers import CORRUPT, corrupt_text

# Fixed values.
LANDING_FORMATS = ("csv", "json", "parquet")


def failed_rules(size: Column, name: Column, expected_size: Column | None = None, parse_errors: Column | None = None) -> Column:
    """array<string> of all checks a file fails; a file larger than expected is fine."""
    ext = paths.extension(name)
    rules = [
        F.when(size == 0, "File is empty"),
        F.when(~ext.isin(*LANDING_FORMATS), F.concat(F.lit("Unsupported format: "), ext)),
    ]
    if expected_size is not None:
        rules.append(F.when((expected_size > 0) & (size > 0) & (size < expected_size * 0.5), "Incomplete download"))
    if parse_errors is not None:
        rules.append(F.when((ext == "csv") & (size > 0) & (parse_errors > 0), "CSV Parsing Failed"))
    return F.array_compact(F.array(*rules))


def ingestion_log(inventory: DataFrame, batch_id: str, ingest_ts: str, failed: Column) -> DataFrame:
    """One PASS/FAIL row per inventoried file."""
    return inventory.withColumn("failed_validation_rules", failed).select(
        F.sha2(F.concat_ws("|", F.lit(batch_id), "file_path"), 256).alias("ingestion_id"),
        "client_name",
        F.col("file_path").alias("source_path"),
        F.col("file_name").alias("source_object"),
        F.lit(batch_id).alias("batch_id"),
        F.when(F.size("failed_validation_rules") == 0, "PASS").otherwise("FAIL").alias("validation_status"),
        "failed_validation_rules",
        F.lit(ingest_ts).alias("ingestion_ts"),
    )


def landing_summary(log: DataFrame) -> DataFrame:
    """Files and failed files per batch and client."""
    return log.groupBy("batch_id", "client_name").agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("validation_status") == "FAIL").alias("failed_files")
    )


def header_problems(header: Column, sep: str = ",") -> Column:
    """array<string>: no columns, duplicate names, blank or `Unnamed` names in a raw header line.

    The line is looked at before a reader renames anything, since readers make duplicate names unique.
    """
    names = F.transform(F.split(header, F.lit("\\Q" + sep + "\\E"), -1), lambda n: F.trim(F.btrim(F.trim(n), F.lit('"'))))
    filled = F.filter(names, lambda n: n != "")
    return F.array_compact(F.array(
        F.when(F.trim(header) == "", "Dataset has no columns"),
        F.when(F.size(F.array_distinct(filled)) < F.size(filled), "Duplicate column names found"),
        F.when(F.exists(names, lambda n: (n == "") | n.contains("Unnamed")) & (F.trim(header) != ""), "Invalid column name found"),
    ))


def table_problems(df: DataFrame) -> list[str]:
    """Structure of a table already read: columns, unique and named, and at least one row."""
    names = [c.strip() for c in df.columns]
    out = []
    if not names:
        out.append("Dataset has no columns")
    if len(set(names)) < len(names):
        out.append("Duplicate column names found")
    if any(not n or "Unnamed" in n for n in names):
        out.append("Invalid column name found")
    if df.isEmpty():
        out.append("Dataset is empty")
    return out


def parse_errors(
    spark: SparkSession, path: str | list[str], columns: list[str], sep: str = ",", header: bool = True
) -> DataFrame:
    """(file_path, rows, bad_rows): lines that do not fit the columns, per file."""
    schema = ", ".join(f"`{c}` string" for c in [*columns, CORRUPT])
    rows = (
        spark.read.options(sep=sep, header=header, mode="PERMISSIVE", enforceSchema=True, columnPruning=False)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .schema(schema)
        .csv(path)
    )
    marked = rows.select(F.col("_metadata.file_path").alias("file_path"), corrupt_text(columns[0]).alias("bad"))
    return marked.groupBy("file_path").agg(F.count(F.lit(1)).alias("rows"), F.count("bad").alias("bad_rows"))
