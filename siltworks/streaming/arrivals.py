"""File arrivals as streams: every new file is seen once, and a repeated micro-batch writes the same files again."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltworks.functions.rules import Rule
from siltworks.operators.literals import literal_table
from siltworks.plans.layers import Dataset, LayerStore, run_dataset
from siltworks.sources import checks, inventory

# A failed micro-batch is tried three times, ten seconds apart.
RETRIES, DELAY = 3, 10.0
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def with_retries(fn: Callable[[DataFrame, int], None], retries: int = RETRIES, delay: float = DELAY):
    """A foreachBatch function that tries again before it lets the stream fail."""

    def run(batch: DataFrame, epoch: int) -> None:
        for attempt in range(retries):
            try:
                return fn(batch, epoch)
            except Exception:
                if attempt == retries - 1:
                    raise
                time.sleep(delay)

    return run


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str | None = None, files_per_batch: int | None = None, **options) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def ingest_arrivals(
    stream: DataFrame,
    store: LayerStore,
    dataset: Dataset,
    rules: Sequence[Rule],
    batch_prefix: str,
    ingest_ts: str,
    checkpoint: str,
    parents: Mapping[str, DataFrame] | None = None,
    retries: int = RETRIES,
    delay: float = DELAY,
) -> StreamingQuery:
    """Run the layers on every micro-batch of new files until all that have arrived are done.

    The batch id comes from the stream's epoch, so a micro-batch that is replayed after a failure overwrites its own
    directories and control rows.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        run_dataset(store, dataset, [batch], rules, f"{batch_prefix}{epoch:06d}", ingest_ts, parents)

    return (
        stream.writeStream.foreachBatch(with_retries(one, retries, delay))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def log_arrivals(spark: SparkSession, path: str, log_path: str, client: str, batch_prefix: str, ingest_ts: str, checkpoint: str, glob: str | None = None) -> StreamingQuery:
    """Landing checks of new files, one PASS/FAIL row per file; contents are not read."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", "length")

    def one(batch: DataFrame, epoch: int) -> None:
        rows = inventory.describe(batch, F.lit(client), F.lit("LOCAL"))
        failed = checks.failed_rules(F.col("file_size"), F.col("file_name"))
        log = checks.ingestion_log(rows, f"{batch_prefix}{epoch:06d}", ingest_ts, failed)
        log.write.mode("overwrite").parquet(f"{log_path}/batch={epoch:06d}")

    return (
        files.writeStream.foreachBatch(with_retries(one)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


ANNOUNCED = "path string, etag string, modified timestamp, size bigint"
NEWEST = "path string, at bigint, etag string, arrived bigint"
RETENTION = 7 * 24 * 3600 * 1000  # milliseconds without news after which an object's state is dropped


def new_versions(announcements: DataFrame, newest: DataFrame, now: int, retention: int = RETENTION) -> tuple[DataFrame, DataFrame]:
    """Of announcements (path, etag, modified, size), those that bring a new version of an object, and what is known after them.

    What is known of a path (`newest`) is the newest version seen, by its time of change and its etag, and when news of it last
    arrived.  An announcement passes when the path is new, or when it is of a later change with another etag; announced
    twice, announced late after a newer version, or touched without a change of the etag, it does not.  No announcement is too
    late for an object not seen yet, however old its version is: a path without news for `retention` milliseconds before
    `now` is forgotten, which bounds what is kept.  Of announcements with one time of change the largest etag counts; a null
    time is the earliest, a null etag is empty; a null path is one object.
    """
    rows = announcements.select(
        "path", F.coalesce("etag", F.lit("")).alias("etag"), F.coalesce(F.unix_micros("modified"), F.lit(-(2**62))).alias("at"), F.col("size").cast("bigint").alias("size")
    )
    # one version a time of change
    each = rows.groupBy("path", "at").agg(F.max(F.struct("etag", "size")).alias("_v")).select("path", "at", "_v.etag", "_v.size")
    last = newest.select(F.col("path").alias("_path"), F.col("at").alias("_at"), F.col("etag").alias("_etag"))
    later = each.join(last, F.col("path").eqNullSafe(F.col("_path")), "left").where("_at is null or at > _at")
    before = F.coalesce(F.lag("etag").over(Window.partitionBy("path").orderBy("at")), F.col("_etag"))
    kept = later.withColumn("_before", before).where("_before is null or etag <> _before")
    passed = kept.select("path", "etag", F.when(F.col("at") > -(2**62), F.timestamp_micros("at")).alias("modified"), "size")
    # of one time of change, the version seen first stays
    both = newest.select("path", "at", F.lit(1).alias("_old"), "etag", "arrived").unionByName(
        each.select("path", "at", F.lit(0).alias("_old"), "etag", F.lit(now).cast("bigint").alias("arrived"))
    )
    known = both.groupBy("path").agg(F.max(F.struct("at", "_old", "etag")).alias("_v"), F.max("arrived").alias("arrived"))
    return passed, known.select("path", "_v.at", "_v.etag", "arrived").where(F.col("arrived") + retention >= now)


def ingest_new_versions(announcements: DataFrame, out: str, checkpoint: str, retention: int = RETENTION) -> StreamingQuery:
    """Write each epoch's new versions to a directory of its own, which a replayed epoch overwrites.

    What is known of the objects lies beside the checkpoint as a table, the one before an epoch and the one after it: an
    epoch reads the one and writes the other, so it can be replayed, and costs two passes over the objects known."""
    spark = announcements.sparkSession

    def one(batch: DataFrame, epoch: int) -> None:
        state = spark.read.schema(NEWEST).parquet(f"{checkpoint}/newest/{(epoch - 1) % 2}") if epoch else literal_table(spark, [], NEWEST)
        passed, known = new_versions(batch, state, int(time.time() * 1000), retention)
        passed.write.mode("overwrite").parquet(f"{out}/epoch={epoch:06d}")
        known.write.mode("overwrite").parquet(f"{checkpoint}/newest/{epoch % 2}")

    stream = announcements.writeStream.foreachBatch(with_retries(one))
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
