"""The layered run of one dataset: raw -> bronze -> checked -> silver, rejected and gold.

Every layer but silver is a directory per batch that the batch overwrites, so a run repeated after a failure leaves the
same files.  Silver is versioned: every attempt of a run writes a snapshot of its own and then one row of the version
table, so nothing is overwritten while it is being read and a reader never sees half a merge.  A batch that runs again
after later ones is merged below them: their rows win.  Control rows (versions, history, reports)
are one small directory per run and dataset, overwritten by a repeated run.  A dataset with `rows_a_file` keeps silver
by files instead: a batch rewrites only those that hold its keys, and the versions lie beside them.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.rules import Rule
from siltworks.operators import dq
from siltworks.operators.literals import literal_table
from siltworks.operators.standardize import standardize
from siltworks.operators.upsert import newer_than, upsert
from siltworks.plans.file_silver import FileSilver
from siltworks.plans.schemas import DQ_DETAILS, RUN_HISTORY, VERSIONS, WATERMARKS


@dataclass(frozen=True)
class Dataset:
    dataset_id: str
    client: str
    name: str
    load_type: str | None = None
    upsert_key: str | None = None
    watermark_column: str | None = None
    partition_column: str | None = None
    tie_break: tuple[str, ...] = ()
    # rows a silver file holds when batches are merged by files (`plans/file_silver.py`); None writes a snapshot per run
    rows_a_file: int | None = None

    @property
    def by_files(self) -> bool:
        return self.incremental and self.rows_a_file is not None

    @property
    def keys(self) -> list[str]:
        return [k.strip() for k in (self.upsert_key or "").split(",") if k.strip()]

    @property
    def incremental(self) -> bool:
        return (self.load_type or "").upper() == "INCREMENTAL" and bool(self.keys)


@dataclass(frozen=True)
class Layers:
    """The lazy tables of a run."""

    bronze: DataFrame
    flagged: DataFrame
    valid: DataFrame
    rejected: DataFrame
    silver: DataFrame
    gold: DataFrame


def plan_layers(
    frames: Sequence[DataFrame],
    dataset: Dataset,
    rules: Sequence[Rule],
    batch_id: str,
    ingest_ts: str,
    current_silver: DataFrame | None = None,
    parents: Mapping[str, DataFrame] | None = None,
    gold_from: str = "batch",
) -> Layers:
    """The whole run as DataFrames, with nothing written."""
    bronze = standardize(frames, batch_id, ingest_ts)
    flagged = dq.flag(bronze, rules, parents)
    valid = dq.valid_rows(flagged)
    silver = merge_silver(valid, dataset, current_silver)
    gold = silver if gold_from == "silver" else valid
    return Layers(bronze, flagged, valid, dq.rejected_rows(flagged), silver, gold)


def merge_silver(valid: DataFrame, dataset: Dataset, current: DataFrame | None) -> DataFrame:
    if not dataset.incremental:
        return valid
    return upsert(current, valid, dataset.keys, dataset.watermark_column, dataset.tie_break)


class LayerStore:
    """Paths and version bookkeeping under one root of a shared file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def batch_path(self, layer: str, dataset: Dataset, batch_id: str) -> str:
        return f"{self.root}/{layer}/{dataset.client}/{dataset.name}/batch={batch_id}"

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/Control/{name}"
        literal_table(self.spark, [], schema).write.mode("ignore").parquet(f"{path}/empty")
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)

    def versions(self) -> DataFrame:
        return self._table("silver_versions", VERSIONS)

    def run_history(self) -> DataFrame:
        return self._table("run_history", RUN_HISTORY)

    def dq_details(self) -> DataFrame:
        return self._table("dq_details", DQ_DETAILS)

    def watermark(self, dataset: Dataset, dtype: T.DataType, before_batch: str | None = None):
        """The highest watermark of the dataset's earlier runs; kept as text, compared in the column's own type."""
        rows = self._table("watermarks", WATERMARKS).where(F.col("dataset_id") == dataset.dataset_id)
        if before_batch is not None:
            rows = rows.where(F.col("batch_id") != before_batch)
        return rows.agg(F.max(F.col("watermark").cast(dtype))).first()[0]

    def record(self, name: str, dataset: Dataset, batch_id: str, rows: DataFrame) -> None:
        """Control rows of one run; the same run again overwrites them."""
        run = re.sub(r"[^A-Za-z0-9._-]+", "_", f"{dataset.dataset_id}.{batch_id}")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/Control/{name}/{run}")

    def current_version(self, dataset: Dataset, before_batch: str | None = None):
        """Row (version, path, schema_json) of the current snapshot, or None; a repeated batch looks at the one
        before its own."""
        rows = self.versions().where(F.col("dataset_id") == dataset.dataset_id)
        if before_batch is not None:
            rows = rows.where(F.col("batch_id") != before_batch)
        return rows.agg(F.max(F.struct("version", "path", "schema_json")).alias("top")).first()["top"]

    def version_of(self, dataset: Dataset, batch_id: str) -> int | None:
        """The version that a batch has made, if it has run before."""
        rows = self.versions().where((F.col("dataset_id") == dataset.dataset_id) & (F.col("batch_id") == batch_id))
        return rows.agg(F.max("version")).first()[0]

    def read_snapshot(self, path: str, schema: T.StructType) -> DataFrame:
        """A silver snapshot with its own schema: types of partition columns are not guessed from directory names."""
        return self.spark.read.schema(schema).parquet(path)

    def file_silver(self, dataset: Dataset) -> FileSilver:
        path = f"{self.root}/Silver/{dataset.client}/{dataset.name}/by_files"
        return FileSilver(self.spark, path, dataset.keys, dataset.watermark_column, dataset.tie_break, dataset.rows_a_file)

    def silver(self, dataset: Dataset, before_batch: str | None = None) -> DataFrame | None:
        if dataset.by_files:
            silver = self.file_silver(dataset)
            top = silver.version(but=before_batch)
            return silver.read(top["version"]) if top else None
        top = self.current_version(dataset, before_batch)
        return self.read_snapshot(top["path"], T.StructType.fromJson(json.loads(top["schema_json"]))) if top else None


def write_counted(df: DataFrame, path: str, *metrics, partition_by: Sequence[str] = ()) -> dict:
    """Overwrite one batch directory; the row metrics come from the write itself, not from another scan."""
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics)
    if partition_by:
        # AQE evens this out: small partitions share a file, one that holds a third of the rows is split
        out = out.hint("rebalance", *partition_by)
    out.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return seen.get


def run_dataset(
    store: LayerStore,
    dataset: Dataset,
    frames: Sequence[DataFrame],
    rules: Sequence[Rule],
    batch_id: str,
    ingest_ts: str,
    parents: Mapping[str, DataFrame] | None = None,
    gold_from: str = "batch",
    newer_only: bool = False,
) -> dict:
    """Run all layers, write them and record the run's metrics in the run history; returns the metrics.

    With `newer_only`, rows up to the highest watermark of earlier runs are left out.
    """
    spark = store.spark
    paths = {layer: store.batch_path(layer, dataset, batch_id) for layer in ("Bronze", "Checked", "Silver", "Rejected", "Gold")}
    m = {
        "dataset_id": dataset.dataset_id, "dataset_name": dataset.name, "status": "SUCCESS", "reason": None,
        "bronze_path": paths["Bronze"], "silver_path": None, "gold_path": None, "rejected_path": None,
        "silver_rows": 0, "gold_rows": 0, "gold_status": "PENDING",
    }
    bronze = standardize(frames, batch_id, ingest_ts)
    wm = dataset.watermark_column
    has_wm = wm in bronze.columns
    if newer_only and has_wm:
        bronze = newer_than(bronze, wm, store.watermark(dataset, bronze.schema[wm].dataType, before_batch=batch_id))
    landed = write_counted(bronze, paths["Bronze"], *([F.max(wm).cast("string").alias("wm")] if has_wm else []))
    m["raw_rows"] = m["bronze_rows"] = landed["rows"]
    # the rules run once; silver, rejected, gold and the report read this table
    flagged = dq.flag(spark.read.schema(bronze.schema).parquet(paths["Bronze"]), rules, parents)
    counts = write_counted(
        flagged, paths["Checked"],
        F.count_if(F.col(dq.INVALID)).alias("failed"), F.coalesce(F.sum(dq.WARNINGS), F.lit(0)).alias("warnings"),
    )
    failed, m["dq_warnings"] = counts["failed"], counts["warnings"]
    checked = spark.read.schema(flagged.schema).parquet(paths["Checked"])
    report = dq.details(checked, rules).persist()
    bucket = F.col("bucket") == "violations"
    m["dq_violations"] = report.where(bucket).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    named = report.select(F.lit(batch_id).alias("run_id"), F.lit(dataset.dataset_id).alias("dataset_id"), "*")
    store.record("dq_details", dataset, batch_id, named)
    report.unpersist()
    valid = dq.valid_rows(checked)
    has_valid = counts["rows"] > failed
    if has_valid and dataset.by_files:
        # the files are cut by key; a partition column plays no part in them
        files = store.file_silver(dataset)
        m["silver_rows"], m["silver_path"] = files.merge(valid, batch_id)["rows"], files.path
        silver = files.read()
    elif has_valid:
        top = store.current_version(dataset, before_batch=batch_id)
        existing = store.silver(dataset, before_batch=batch_id) if dataset.incremental else None
        own = store.version_of(dataset, batch_id)
        late = existing is not None and own is not None and own < top["version"]
        silver = merge_silver(existing, dataset, valid) if late else merge_silver(valid, dataset, existing)
        paths["Silver"] += f"/attempt={uuid.uuid4().hex}"
        by = [dataset.partition_column] if dataset.partition_column in silver.columns else []
        m["silver_rows"] = write_counted(silver, paths["Silver"], partition_by=by)["rows"]
        m["silver_path"] = paths["Silver"]
        row = (dataset.dataset_id, top["version"] + 1 if top else 1, batch_id, paths["Silver"], silver.schema.json())
        store.record("silver_versions", dataset, batch_id, literal_table(spark, [row], VERSIONS))
    if failed:
        write_counted(dq.rejected_rows(checked), paths["Rejected"])
        m["rejected_path"] = paths["Rejected"]
    if has_valid:
        try:
            snapshot = silver if dataset.by_files else store.read_snapshot(paths["Silver"], silver.schema)
            gold = snapshot if gold_from == "silver" else valid
            m["gold_rows"] = write_counted(gold, paths["Gold"])["rows"]
            m["gold_status"], m["gold_path"] = "PASSED", paths["Gold"]
        except Exception as e:  # a failed publish is a status of the run, not its end
            m["gold_status"], m["reason"] = "FAILED", str(e)
    else:
        m["gold_status"], m["reason"] = "SKIPPED", "no clean rows"
    _record(store, dataset, batch_id, ingest_ts, m)
    if has_wm and landed["wm"] is not None:
        store.record("watermarks", dataset, batch_id, literal_table(spark, [(dataset.dataset_id, batch_id, landed["wm"])], WATERMARKS))
    return m


def record_failure(store: LayerStore, dataset: Dataset, batch_id: str, ingest_ts: str, reason: str) -> None:
    _record(store, dataset, batch_id, ingest_ts, {
        "dataset_id": dataset.dataset_id, "dataset_name": dataset.name, "status": "FAILURE", "reason": reason,
    })


def _record(store: LayerStore, dataset: Dataset, batch_id: str, ingest_ts: str, m: dict) -> None:
    row = {**m, "run_id": batch_id, "batch_id": batch_id, "client_name": dataset.client, "started": ingest_ts, "finished": None}
    names = T.StructType.fromDDL(RUN_HISTORY).names
    store.record("run_history", dataset, batch_id, literal_table(store.spark, [tuple(row.get(n) for n in names)], RUN_HISTORY))


def run_batch(store: LayerStore, jobs: Sequence[dict], batch_id: str, ingest_ts: str) -> list[dict]:
    """Run several datasets one after the other; a dataset that fails is recorded and the next one runs."""
    out = []
    for job in jobs:
        try:
            out.append(run_dataset(store, batch_id=batch_id, ingest_ts=ingest_ts, **job))
        except Exception as e:
            record_failure(store, job["dataset"], batch_id, ingest_ts, str(e))
            out.append({"dataset_id": job["dataset"].dataset_id, "status": "FAILURE", "reason": str(e)})
    return out
