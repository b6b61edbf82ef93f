"""Folders for tables a query writes and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from siltworks.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/siltworks/{name}-{uuid.uuid4().hex}"
