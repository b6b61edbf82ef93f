"""Runs of catalogued datasets by their id: catalog row, landed files, active rules, layers, and the catalog afterwards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from siltworks.operators import dq
from siltworks.operators.catalog import find_dataset
from siltworks.operators.literals import literal_table
from siltworks.plans.layers import Dataset, LayerStore, record_failure, run_dataset
from siltworks.sources.readers import raw_files, read_raw


def dataset_of(row: Row) -> Dataset:
    """A dataset as its catalog row describes it."""
    return Dataset(
        row["dataset_id"], row["client_name"], row["source_object"] or row["source_folder"] or row["dataset_id"], row["load_type"],
        row["upsert_key"], row["watermark_column"], row["partition_column"],
    )


def passed(files: DataFrame, log: DataFrame, batch_id: str) -> DataFrame:
    """The files of a batch that its landing checks let pass."""
    ok = log.where((F.col("batch_id") == batch_id) & (F.col("validation_status") == "PASS")).select(F.col("source_path").alias("file_path"))
    return files.join(ok.distinct(), "file_path", "left_semi")


def run_by_id(
    store: LayerStore,
    catalog: DataFrame,
    dq_rules: DataFrame,
    dataset_id: str,
    batch_id: str,
    ingest_ts: str,
    files: DataFrame,
    log: DataFrame | None = None,
    parents: Mapping[str, DataFrame] | None = None,
    **options,
) -> dict:
    """Run one dataset from its catalog row; returns the metrics of the run.

    files: the inventory; with `log` only files that passed the landing checks of the batch are read.  An unknown or
    inactive dataset, or one without files, is an error, which `run_all` records.
    """
    row = find_dataset(catalog, dataset_id).first()
    if row is None:
        raise LookupError(f"dataset {dataset_id!r} is not in the catalog")
    if not row["is_active"]:
        raise LookupError(f"dataset {dataset_id!r} is not active")
    found = raw_files(files, row["client_name"], row["source_folder"], row["source_object"] or "", batch_id)
    if log is not None:
        found = passed(found, log, batch_id)
    frames = read_raw(store.spark, row["raw_layer_path"], found)
    rules = dq.rules_from_catalog(dq_rules, dataset_id)
    return run_dataset(store, dataset_of(row), frames, rules, batch_id, ingest_ts, parents=parents, **options)


def run_all(store: LayerStore, catalog: DataFrame, dq_rules: DataFrame, dataset_ids: Sequence[str], batch_id: str, ingest_ts: str, files: DataFrame, **options) -> list[dict]:
    """Run several datasets; one that fails is recorded and the next one runs."""
    out = []
    for dataset_id in dataset_ids:
        try:
            out.append(run_by_id(store, catalog, dq_rules, dataset_id, batch_id, ingest_ts, files, **options))
        except Exception as e:
            record_failure(store, Dataset(dataset_id, "", dataset_id), batch_id, ingest_ts, str(e))
            out.append({"dataset_id": dataset_id, "status": "FAILURE", "reason": str(e)})
    return out


def catalog_after(catalog: DataFrame, results: Sequence[dict], batch_id: str, now) -> DataFrame:
    """The catalog with the batch of every successful run written back to its row."""
    ran = literal_table(catalog.sparkSession, [(r["dataset_id"],) for r in results if r["status"] == "SUCCESS"], "dataset_id string")
    hit = F.col("_ran").isNotNull()
    joined = catalog.join(F.broadcast(ran.withColumn("_ran", F.lit(True))), "dataset_id", "left")  # one row per run
    changed = {"last_seen_batch": F.when(hit, batch_id).otherwise(F.col("last_seen_batch")), "updated_at": F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))}
    return joined.withColumns(changed).select(*catalog.columns)
