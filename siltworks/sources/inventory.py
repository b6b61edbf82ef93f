"""File inventories: what lies under a path, without reading the files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import paths

# Formats a local inventory lists.
LOCAL_FORMATS = ("csv", "json", "parquet", "xlsx", "xls", "tsv")


def list_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, length, modificationTime); the content column is never asked for, so no file is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "modificationTime")


def describe(files: DataFrame, client: Column, source_type: Column) -> DataFrame:
    """Inventory rows from (path, length)."""
    name = paths.file_name(F.col("path"))
    return files.select(
        name.alias("file_name"),
        F.col("path").alias("file_path"),
        paths.file_format(name).alias("file_format"),
        F.col("length").alias("file_size"),
        source_type.alias("source_type"),
        client.alias("client_name"),
    )


def with_formats(inventory: DataFrame, formats: Sequence[str] = LOCAL_FORMATS) -> DataFrame:
    return inventory.where(F.lower("file_format").isin(*formats))


def children(files: DataFrame, prefix: str) -> DataFrame:
    """(kind, name, file_path, file_format, file_size): the distinct first segments below `prefix`, folders first."""
    p = prefix.rstrip("/") + "/" if prefix else ""
    rel = F.substring(F.col("path"), len(p) + 1, 1 << 30)
    below = files.where(F.col("path").startswith(p) & (F.col("path") != p)).withColumn("_rel", rel)
    is_folder = F.col("_rel").contains("/")
    one = F.substring_index("_rel", "/", 1)
    nothing = F.lit(None).cast("string")
    folders = below.where(is_folder).select(
        F.lit("folder").alias("kind"), one.alias("name"), nothing.alias("file_path"),
        nothing.alias("file_format"), F.lit(None).cast("bigint").alias("file_size"),
    ).where("name <> ''").distinct()
    here = below.where(~is_folder & (F.col("_rel") != "")).select(
        F.lit("file").alias("kind"), F.col("_rel").alias("name"), F.col("path").alias("file_path"),
        paths.file_format(F.col("_rel")).alias("file_format"), F.col("length").alias("file_size"),
    )
    return folders.unionByName(here).orderBy(F.desc("kind"), "name")


def data_files(files: DataFrame) -> DataFrame:
    """Files that hold data, not markers or checksums."""
    name = F.lower(paths.file_name(F.col("path")))
    return files.where(~name.rlike(r"_metadata|_success|\.crc|\.metadata"))


def first_data_file(files: DataFrame) -> DataFrame:
    """The file a directory stands for in a preview: a known format first, then the first by path."""
    name = F.lower(paths.file_name(F.col("path")))
    return data_files(files).orderBy(F.when(name.rlike(r"\.(parquet|csv|json)$"), 0).otherwise(1), "path").limit(1)


def bucket_summary(files: DataFrame, bucket: Column, prefix: Column, formats: Sequence[str] = LOCAL_FORMATS) -> DataFrame:
    """Per bucket: the formats found, and the prefix of the first file with a known format, else the first prefix.

    Aggregated per (bucket, format) before the list is made, so a bucket with any number of files lists formats only.
    """
    fmt = paths.file_format(paths.file_name(F.col("path")))
    known = F.lower(fmt).isin(*formats)
    rows = files.select(bucket.alias("bucket"), prefix.alias("prefix"), F.when(known, fmt).alias("fmt"), "path")
    first = F.min(F.struct("path", "prefix"))
    per = rows.groupBy("bucket", "fmt").agg(F.count(F.lit(1)).alias("n"), first.alias("f"))
    return per.groupBy("bucket").agg(
        F.sum("n").alias("files"),
        F.sort_array(F.collect_list("fmt")).alias("formats"),
        F.coalesce(F.min(F.when(F.col("fmt").isNotNull(), F.col("f"))), F.min("f"))["prefix"].alias("suggested_prefix"),
    )


def manifest(spark: SparkSession, path: str, client: str, batch_id: str, root: str = "Raw") -> DataFrame:
    """Landing manifest: where each file belongs in the raw layer, its size and checksum; the bytes stay in place."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = paths.file_name(F.col("path"))
    return files.select(
        F.col("path").alias("source_path"),
        F.concat_ws("/", F.lit(root), F.lit(client), F.lit(batch_id), name).alias("raw_path"),
        "length",
        F.sha2("content", 256).alias("sha256"),
        paths.dataset_id(F.lit(client), F.lit("LOCAL"), F.col("path")).alias("dataset_id"),
    )
