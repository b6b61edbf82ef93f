"""Rows from arrays and maps that are costly to compute.

Spark puts a `size(array) > 0` filter under an inner explode, which computes the array a second time for every row.
An outer explode followed by a filter on its result computes it once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_once(df: DataFrame, keep: Sequence[str | Column], array: Column, name: str) -> DataFrame:
    """The kept columns and one row per element of `array`; elements are never null."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def explode_map_once(df: DataFrame, keep: Sequence[str | Column], pairs: Column, key: str, value: str) -> DataFrame:
    return df.select(*keep, F.explode_outer(pairs).alias(key, value)).where(F.col(key).isNotNull())


def posexplode_once(df: DataFrame, keep: Sequence[str | Column], array: Column, pos: str, name: str) -> DataFrame:
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).where(F.col(pos).isNotNull())
