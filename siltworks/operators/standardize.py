"""Bringing raw tables into one shape: trimmed names, one column set, lineage columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INGEST_TS = "_ingest_ts"
BATCH_ID = "_batch_id"


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by trimmed name; columns in first-seen order, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [trim_names(f) for f in frames])


def tag(df: DataFrame, batch_id: str, ingest_ts: str) -> DataFrame:
    """Lineage columns; both values come from the caller so that a retried task writes the same rows."""
    return df.withColumn(INGEST_TS, F.lit(ingest_ts)).withColumn(BATCH_ID, F.lit(batch_id))


def standardize(frames: Sequence[DataFrame], batch_id: str, ingest_ts: str) -> DataFrame:
    return tag(union_all(frames), batch_id, ingest_ts)


def conform(df: DataFrame, columns: Sequence[str], types: dict[str, str] | None = None) -> DataFrame:
    """Exactly the given columns in the given order; absent ones are null."""
    have = set(df.columns)
    types = types or {}

    def pick(c: str) -> Column:
        return F.col(f"`{c}`") if c in have else F.lit(None).cast(types.get(c, "string")).alias(c)

    return df.select(*[pick(c) for c in columns])


def known_first(df: DataFrame, known: Sequence[str]) -> DataFrame:
    """Known columns first in their given order, then the others as they come."""
    first = [c for c in known if c in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in first + [c for c in df.columns if c not in first]])


def preview(df: DataFrame, rows: int) -> DataFrame:
    """The first rows as text, nulls as empty text."""
    return df.limit(rows).select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
