"""How a scan is spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Split a scan that leaves more than half of the cores idle, for work that costs more than moving the rows.

    A large table is scanned by many tasks as it is and is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
