"""Merging tables by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators.keyed import first_per_key


def upsert(
    existing: DataFrame | None,
    incoming: DataFrame,
    keys: Sequence[str],
    watermark: str | None = None,
    tie_break: Sequence[str] = (),
    null_watermark: str = "wins",
) -> DataFrame:
    """One row per key: a new row beats an old one, then the later watermark, then the larger tie-break values.

    A row without a watermark counts as the latest (`null_watermark="loses"` turns that round).  Null keys are one key.
    The first load is deduplicated as well.
    """
    rows = incoming.withColumn("_new", F.lit(1))
    if existing is not None:
        rows = existing.withColumn("_new", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    order: list[Column] = [F.desc("_new")]
    if watermark and watermark in incoming.columns:
        order.append(F.desc_nulls_first(watermark) if null_watermark == "wins" else F.desc_nulls_last(watermark))
    order += [F.desc_nulls_last(c) for c in tie_break]
    return first_per_key(rows, list(keys), order).drop("_new")


def newer_than(df: DataFrame, watermark: str, last) -> DataFrame:
    """Incremental load: rows at or past the stored watermark, all rows where none is stored.

    Late rows of the stored watermark itself come again, which a keyed merge takes without a change, and a row without a
    watermark is always new, as `upsert` counts it as the latest."""
    return df if last is None else df.where((F.col(watermark) >= F.lit(last)) | F.col(watermark).isNull())


def absent_from(df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not there yet."""
    return df.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def replace_by_key(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop every existing row whose key arrives again, then append all of the incoming rows."""
    return absent_from(existing, incoming, keys).unionByName(incoming, allowMissingColumns=True)


def last_by_id(df: DataFrame, key: str, order: str) -> DataFrame:
    return first_per_key(df, [key], [F.desc(order)])


def first_by_marker(df: DataFrame, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per marker: the first non-empty of `fields` (with its name), else the whole record."""
    marks = [F.when(F.col(f).cast("string") != "", F.concat(F.lit(f"{f}:"), F.col(f).cast("string"))) for f in fields]
    record = F.to_json(F.struct(*[F.col(c) for c in sorted(set(df.columns) - set(order))]))
    marked = df.withColumn("_marker", F.sha2(F.coalesce(*marks, record), 256))
    return first_per_key(marked, ["_marker"], [F.asc(c) for c in order]).drop("_marker")
