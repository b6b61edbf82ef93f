"""Table profiles: types, gaps, keys, timestamps and personal data, one row per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.lenient import iso_timestamp
from siltworks.operators.keyed import compact_key
from siltworks.operators.literals import literal_table
from siltworks.operators.rule_catalog import is_timestamp_column

PROFILE = (
    "dataset_id string, column_name string, data_type string, nullable boolean, ordinal int, row_count bigint, "
    "null_count bigint, key_candidate boolean"
)

# Parts of names that mark keys and personal data.
KEY_TOKENS = ("id", "key", "code")
PERSONAL_TOKENS = ("email", "ssn", "phone", "address", "card")


def type_name(t: T.DataType) -> str:
    """The rule catalog's name for a Spark type."""
    if isinstance(t, T.BooleanType):
        return "BOOLEAN"
    if isinstance(t, T.IntegralType):
        return "INTEGER"
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return "FLOAT"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "DATE"
    return "STRING"


def profile(df: DataFrame, dataset_id: str, keys: bool = True) -> DataFrame:
    """Schema rows with gaps and key candidates, as one lazy pass over the table.

    Every row is unfolded into its columns, each as whether it is null and, for key-like columns, its value (long texts
    by digest); equal cells are counted together map-side, and the largest count of a column tells whether it is a key.
    """
    fields = df.schema.fields
    cells, rows = [], []
    for i, f in enumerate(fields):
        c, named = F.col(f"`{f.name}`"), keys and any(t in f.name.lower() for t in KEY_TOKENS)
        value = compact_key(c.cast("string"), True) if named else F.lit("")
        cells.append(F.struct(F.lit(i).alias("i"), c.isNull().alias("gap"), F.when(c.isNotNull(), value).alias("value")))
        rows.append((dataset_id, f.name, type_name(f.dataType), i, named))
    counted = df.select(F.inline(F.array(*cells))).groupBy("i", "gap", "value").agg(F.count(F.lit(1)).alias("n"))
    per = counted.groupBy("i").agg(
        F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(F.col("gap"), F.col("n"))), F.lit(0)).alias("null_count"), F.max("n").alias("most")
    )
    names = literal_table(df.sparkSession, rows, "dataset_id string, column_name string, data_type string, i int, named boolean")
    zero = F.lit(0).cast("bigint")
    return names.join(F.broadcast(per), "i", "left").select(  # one row per column
        "dataset_id", "column_name", "data_type", (F.coalesce("null_count", zero) > 0).alias("nullable"), (F.col("i") + 1).alias("ordinal"),
        F.coalesce("row_count", zero).alias("row_count"), F.coalesce("null_count", zero).alias("null_count"),
        F.coalesce(F.col("named") & (F.col("null_count") == 0) & (F.col("most") == 1), F.lit(False)).alias("key_candidate"),
    )


# Profiles kept per batch.  The sketch of 2^LG_BUCKETS registers takes at most 64 KB a key-like column and batch.
SKETCHES = (
    "dataset_id string, batch_id string, column_name string, data_type string, ordinal int, row_count bigint, null_count bigint, "
    "keyed boolean, sketch binary"
)
LG_BUCKETS = 16
# Three standard errors of a merged sketch (1.04 / sqrt(2^LG_BUCKETS)): a key column's estimate stays within it 99.7 % of the time.
SKETCH_ERROR = 3 * 1.04 / 2 ** (LG_BUCKETS / 2)
# A column whose estimate is this many such bounds below its number of rows is no key: six standard errors, so a true key is lost once in some 10^9 columns.
SURE = 2


def batch_sketches(df: DataFrame, dataset_id: str, batch_id: str) -> DataFrame:
    """What one batch adds to a profile: a row per column with its rows, gaps and, for key-like columns, a sketch of its values.

    One aggregate to one row per task; no value leaves its task but as part of a sketch."""
    fields = df.schema.fields
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for i, f in enumerate(fields):
        c, named = F.col(f"`{f.name}`"), any(t in f.name.lower() for t in KEY_TOKENS)
        aggs.append(F.count(c).alias(f"f{i}"))
        if named:
            aggs.append(F.hll_sketch_agg(c.cast("string"), LG_BUCKETS).alias(f"s{i}"))
        sketch = F.col(f"s{i}") if named else F.lit(None).cast("binary")
        rows.append(F.struct(
            F.lit(dataset_id).alias("dataset_id"), F.lit(batch_id).alias("batch_id"), F.lit(f.name).alias("column_name"), F.lit(type_name(f.dataType)).alias("data_type"),
            F.lit(i + 1).alias("ordinal"), F.col("n").alias("row_count"), (F.col("n") - F.col(f"f{i}")).alias("null_count"), F.lit(named).alias("keyed"), sketch.alias("sketch"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def keep_sketches(df: DataFrame, dataset_id: str, batch_id: str, path: str) -> None:
    """Write a batch's profile below the control folder `path`; the same batch again replaces its own."""
    part = "".join(ch if ch.isalnum() or ch in "._-" else f"%{ord(ch):X}" for ch in f"{dataset_id}.{batch_id}")
    batch_sketches(df, dataset_id, batch_id).write.mode("overwrite").parquet(f"{path}/{part}")


def kept_sketches(spark, path: str) -> DataFrame:
    return spark.read.schema(SKETCHES).option("recursiveFileLookup", True).parquet(path)


def merged_profile(sketches: DataFrame) -> DataFrame:
    """The profile of all batches together, from what was kept of them: PROFILE's columns and `distinct_estimate`.

    Counts are exact.  `key_candidate` is what counts and sketch leave open: a key-like column without gaps whose estimate is
    not surely below its number of rows; `exact_keys` decides.  A column that a batch lacks is a gap in all of its rows, one whose types differ a STRING,
    and its place is that of the last batch that has it."""
    batches = sketches.groupBy("dataset_id", "batch_id").agg(F.max("row_count").alias("n")).groupBy("dataset_id").agg(F.sum("n").alias("row_count"))
    filled = F.sum(F.col("row_count") - F.col("null_count"))
    per = sketches.groupBy("dataset_id", "column_name").agg(
        F.when(F.min("data_type") == F.max("data_type"), F.max("data_type")).otherwise("STRING").alias("data_type"),
        F.max_by("ordinal", "batch_id").alias("ordinal"), filled.alias("_filled"), F.bool_or("keyed").alias("_keyed"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("_estimate"),
    )
    open_ = F.col("_estimate") >= F.col("row_count") * (1 - SURE * SKETCH_ERROR)
    # a dataset is one row of `batches`
    return per.join(batches, "dataset_id").select(
        "dataset_id", "column_name", "data_type", (F.col("_filled") < F.col("row_count")).alias("nullable"), "ordinal", "row_count",
        (F.col("row_count") - F.col("_filled")).alias("null_count"),
        F.coalesce(F.col("_keyed") & (F.col("row_count") > 0) & (F.col("_filled") == F.col("row_count")) & open_, F.lit(False)).alias("key_candidate"),
        F.when(F.col("_keyed"), F.coalesce("_estimate", F.lit(0))).cast("bigint").alias("distinct_estimate"),
    )


def exact_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name) of those columns of a whole table that are unique and without gaps.  Only these columns are read; equal
    values are counted together map-side, long texts by digest."""
    if not columns:
        return literal_table(df.sparkSession, [], "column_name string")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = [F.struct(F.lit(c).alias("column_name"), compact_key(F.col(f"`{c}`").cast("string"), isinstance(kinds[c], T.StringType)).alias("value")) for c in columns]
    counted = df.select(F.inline(F.array(*cells))).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("column_name").agg(F.max(F.col("value").isNull() | (F.col("n") > 1)).alias("not_key")).where("not not_key").select("column_name")


def value_type(text: Column) -> Column:
    """What a text value looks like: INTEGER, DOUBLE, TIMESTAMP, JSON or STRING."""
    t = F.trim(text)
    return (
        F.when(t.rlike(r"^-?[0-9]+$"), "INTEGER")
        .when(t.rlike(r"^-?[0-9]+\.[0-9]+$"), "DOUBLE")
        .when(iso_timestamp(t).isNotNull(), "TIMESTAMP")
        .when(t.rlike(r"^[\[{]") & F.try_parse_json(t).isNotNull(), "JSON")
        .otherwise("STRING")
    )


def value_types(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """(column_name, data_type, nullable, sample_value): the type of each text column's first non-empty value.

    One pass: the first value per column is a minimum over (order, value), which combines map-side."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`")
        filled = v.isNotNull() & (v != "")
        aggs.append(F.min(F.when(filled, F.struct(F.col(order).alias("o"), v.alias("v"))))["v"].alias(f"v{i}"))
        aggs.append((F.count_if(filled) < F.count(F.lit(1))).alias(f"g{i}"))
    row = df.agg(*aggs)
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias("v"), F.col(f"g{i}").alias("nullable")) for i, c in enumerate(columns)]
    long = row.select(F.inline(F.array(*cells)))
    kind = F.when(F.col("v").isNull(), "STRING").otherwise(value_type(F.col("v")))
    return long.select("column_name", kind.alias("data_type"), "nullable", F.col("v").alias("sample_value"))


def timestamp_columns(profiles: DataFrame) -> DataFrame:
    is_date = F.col("data_type").isin("DATE", "TIMESTAMP")
    return profiles.where(is_date | is_timestamp_column(F.col("column_name"), F.col("data_type")))


def guesses(profiles: DataFrame) -> DataFrame:
    """Per dataset: guessed key (`id` or a uuid column), guessed watermark (first date column), personal data or not."""
    name = F.lower("column_name")
    at = F.struct("ordinal", "column_name")
    personal = name.rlike("|".join(PERSONAL_TOKENS))
    return profiles.groupBy("dataset_id").agg(
        F.min(F.when((name == "id") | name.contains("uuid"), at))["column_name"].alias("key_guess"),
        F.min(F.when(F.col("data_type") == "DATE", at))["column_name"].alias("watermark_guess"),
        F.bool_or(personal).alias("has_personal_data"),
    )
