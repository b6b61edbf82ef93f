"""Small tables of values the driver knows, built inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows given by the caller (rules, catalogs, one run's metrics) without a Python worker."""
    fields = T.StructType.fromDDL(schema).fields
    one = spark.range(0, 1, 1, 1)
    if not rows:
        return one.where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, fields)]) for r in rows]
    return one.select(F.inline(F.array(*structs)))
