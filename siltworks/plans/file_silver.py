"""Silver as a set of files: a batch rewrites the files that hold its keys and shares all others with the snapshot before.

A table is cut into slots of the leading key at its first load, and every key belongs to one slot for good.  A manifest per
version lists the live files with their slot, their span of leading keys and their number of rows; beside it lie the
files' Bloom filters, written once with the files themselves.  To merge a batch, its keys are joined with the files of
their slots on the span and the filter; the files that may hold one of them are read, merged and written anew, and the new
manifest is the old one without them.  Keys that no file holds make files of their own.

A version exists when its row stands in the control table, which is written last: an attempt that is lost before
leaves files nobody lists, and the version before stays as it is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.operators.literals import literal_table
from siltworks.operators.upsert import upsert

PAGE = 32_768  # bits of one page of a filter, as bitmap_construct_agg makes it
BITS_A_KEY = 16
PROBES = 4
MAX_SLOTS = 4096
FILE_VERSIONS = "version bigint, batch_id string, manifest string, filters array<string>, bounds string, schema_json string, files bigint, written bigint, rows bigint"
MANIFEST = "file string, slot int, lead_low string, lead_high string, rows bigint, pages bigint"


def _positions(keys: Sequence[str]) -> Column:
    """The places of a key in its page."""
    return F.array(*[F.pmod(F.xxhash64(*keys, F.lit(i)), F.lit(PAGE)) for i in range(1, PROBES + 1)])


def _page(keys: Sequence[str], pages: Column) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(0)), pages)


def _bit(bits: Column, at: Column) -> Column:
    """Whether a bit of a page is set."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (at % 8).cast("int")) == 1


class FileSilver:
    """One table under `path`: its versions, and merges into it."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], watermark: str | None = None, tie_break: Sequence[str] = (), rows_a_file: int = 1_000_000):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.watermark, self.tie_break, self.rows_a_file = watermark, tuple(tie_break), rows_a_file

    # versions

    def versions(self) -> DataFrame:
        path = f"{self.path}/versions"
        literal_table(self.spark, [], FILE_VERSIONS).write.mode("ignore").parquet(f"{path}/empty")
        return self.spark.read.schema(FILE_VERSIONS).option("recursiveFileLookup", True).parquet(path)

    def version(self, number: int | None = None, but: str | None = None):
        """The newest version (or the one of a number), or None; `but` leaves out those of a batch."""
        rows = self.versions() if number is None else self.versions().where(F.col("version") == number)
        if but is not None:
            rows = rows.where(F.col("batch_id") != but)
        names = [f.name for f in T.StructType.fromDDL(FILE_VERSIONS)]
        return rows.agg(F.max_by(F.struct(*names), "version").alias("top")).first()["top"]

    def manifest(self, number: int | None = None) -> DataFrame:
        top = self.version(number)
        return self.spark.read.schema(MANIFEST).parquet(top["manifest"]) if top else literal_table(self.spark, [], MANIFEST)

    def read(self, number: int | None = None) -> DataFrame | None:
        """A snapshot.  The driver holds the names of its files, as it does for any table it lists."""
        top = self.version(number)
        if top is None:
            return None
        return self._files([r["file"] for r in self.manifest(number).select("file").toLocalIterator()], T.StructType.fromJson(json.loads(top["schema_json"])))

    def _files(self, files: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    # merges

    def _slot(self, bounds: list) -> Column:
        """The slot of a leading key: how many bounds are at or below it; null comes first."""

        @F.pandas_udf("int")
        def place(lead: pd.Series) -> pd.Series:
            out = np.zeros(len(lead), dtype=np.int32)
            known = lead.notna().to_numpy()
            out[known] = np.searchsorted(np.asarray(bounds, dtype=object), lead[known].to_numpy(dtype=object), side="right")
            return pd.Series(out)

        return place(F.col(self.keys[0]).cast("string") if bounds and isinstance(bounds[0], str) else F.col(self.keys[0]))

    def _bounds(self, rows: DataFrame, count: int) -> list:
        """Leading keys that cut the rows into slots of about `rows_a_file`: a list of `MAX_SLOTS` at most."""
        slots = min(MAX_SLOTS, -(-count // self.rows_a_file))
        if slots < 2:
            return []
        cuts = [k / slots for k in range(1, slots)]
        lead = F.col(self.keys[0])
        if isinstance(rows.schema[self.keys[0]].dataType, T.NumericType):
            found = rows.agg(F.percentile_approx(lead, cuts, 10 * slots).alias("b")).first()["b"] or []
        else:
            # any other type is cut by where Spark's own range partitions begin
            firsts = rows.select(lead.alias("l")).repartitionByRange(slots, "l").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.col("l").cast("string")).alias("l"))
            found = sorted(r["l"] for r in firsts.collect() if r["l"] is not None)[1:]
        return sorted(set(found))

    def _touched(self, incoming: DataFrame, manifest: DataFrame, filters: list[str]) -> DataFrame:
        """(file): the files that may hold a key of the batch."""
        lead = F.col(self.keys[0])
        kind = incoming.schema[self.keys[0]].dataType
        keys = incoming.select("_slot", *self.keys).distinct()
        near = keys.join(manifest.select(F.col("slot").alias("_slot"), "file", "pages", "lead_low", "lead_high"), "_slot")
        near = near.where(lead.isNull() | lead.between(F.col("lead_low").cast(kind), F.col("lead_high").cast(kind)))
        pages = self.spark.read.schema("file string, page bigint, bits binary").parquet(*filters)
        asked = near.select("file", _page(self.keys, F.col("pages")).alias("page"), _positions(self.keys).alias("_at")).distinct()
        return asked.join(pages, ["file", "page"]).where(F.forall("_at", lambda a: _bit(F.col("bits"), a))).select("file").distinct()

    def merge(self, batch: DataFrame, batch_id: str) -> dict:
        """Merge a batch by key, as `upsert` does, and record a version; returns what was written and what was shared.

        A new row beats an old one, then the later watermark, then the larger tie-break values.  Null keys are one key.  A batch that
        runs again is merged into the version before its own; when others came after it, into theirs, and their rows win."""
        newest, top = self.version(), self.version(but=batch_id)
        late = newest is not None and top is not None and not self.versions().where((F.col("batch_id") == batch_id) & (F.col("version") < top["version"])).isEmpty()
        attempt = f"{self.path}/files/attempt={uuid.uuid4().hex}"
        incoming = upsert(None, batch, self.keys, self.watermark, self.tie_break)
        if top is None:
            staged = f"{attempt}/staged"
            incoming.write.parquet(staged)
            incoming = self.spark.read.schema(incoming.schema).parquet(staged)
            bounds, live, filters, touched = self._bounds(incoming, incoming.count()), None, [], []
            merged = incoming.withColumn("_slot", self._slot(bounds))
        else:
            bounds, filters = json.loads(top["bounds"]), list(top["filters"])
            live = self.manifest(top["version"])
            staged = f"{attempt}/staged"
            incoming.withColumn("_slot", self._slot(bounds)).write.parquet(staged)
            incoming = self.spark.read.schema(T.StructType([*incoming.schema.fields, T.StructField("_slot", T.IntegerType())])).parquet(staged)
            touched = [r["file"] for r in self._touched(incoming, live, filters).toLocalIterator()] if filters else []
            old = self._files(touched, T.StructType.fromJson(json.loads(top["schema_json"])))
            under, over = (incoming.drop("_slot"), old) if late else (old, incoming.drop("_slot"))
            merged = upsert(under, over, self.keys, self.watermark, self.tie_break).withColumn("_slot", self._slot(bounds))
        data = f"{attempt}/data"
        lead = self.keys[0]
        schema = merged.drop("_slot").schema
        # a file a slot; a slot of many rows is cut by Spark's limit of records a file
        ordered = merged.hint("rebalance", "_slot").sortWithinPartitions("_slot", lead) if not bounds else merged.repartition("_slot").sortWithinPartitions("_slot", lead)
        ordered.write.option("maxRecordsPerFile", 2 * self.rows_a_file).partitionBy("_slot").parquet(data)
        fresh = self._describe(data, schema)
        own_filters = f"{attempt}/filters"
        self._filters(data, schema, fresh).write.parquet(own_filters)
        if live is not None:
            gone = literal_table(self.spark, [(f,) for f in touched], "file string")
            fresh = fresh.unionByName(live.join(gone, "file", "left_anti"))
        listed = f"{attempt}/manifest"
        fresh.write.parquet(listed)
        now = self.spark.read.schema(MANIFEST).parquet(listed)
        total = now.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count_if(F.col("file").contains(attempt.rsplit("/", 1)[1])).alias("written")).first()
        row = (newest["version"] + 1 if newest else 1, batch_id, listed, [*filters, own_filters], json.dumps(bounds), schema.json(), total["files"], total["written"], total["rows"])
        literal_table(self.spark, [row], FILE_VERSIONS).coalesce(1).write.parquet(f"{self.path}/versions/v{row[0]:09d}")  # fails if another merge was first
        return {"version": row[0], "files": total["files"], "written": total["written"], "replaced": len(touched), "rows": total["rows"]}

    def _with_file(self, data: str, schema: T.StructType) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(data).select(*self.keys, F.col("_metadata.file_path").alias("file"))
        return rows.withColumn("slot", F.regexp_extract("file", r"/_slot=(-?\d+)/", 1).cast("int"))

    def _describe(self, data: str, schema: T.StructType) -> DataFrame:
        lead = F.col(self.keys[0])
        pages = F.ceil(F.count(F.lit(1)) * BITS_A_KEY / PAGE).cast("bigint")
        return self._with_file(data, schema).groupBy("file", "slot").agg(
            F.min(lead).cast("string").alias("lead_low"), F.max(lead).cast("string").alias("lead_high"), F.count(F.lit(1)).alias("rows"), pages.alias("pages"),
        )

    def _filters(self, data: str, schema: T.StructType, described: DataFrame) -> DataFrame:
        """(file, page, bits).  Pages are built by a sort, so a row of it is a key's few numbers and no file's name; a key's
        probes go to a bitmap each.  Files of one hash and number of pages would share their pages, which then let more pass."""
        named = described.select("file", F.xxhash64("file").alias("_f"), "pages")
        rows = self._with_file(data, schema).select(*self.keys, F.xxhash64("file").alias("_f")).join(named.select("_f", "pages").distinct(), "_f")
        at = _positions(self.keys)
        rows = rows.select("_f", "pages", _page(self.keys, F.col("pages")).alias("page"), *[at[i].alias(f"_at{i}") for i in range(PROBES)])
        each = [F.call_function("bitmap_construct_agg", F.col(f"_at{i}")) for i in range(PROBES)]
        bits = rows.groupBy("_f", "pages", "page").agg(F.array(*each).alias("_each")).select("_f", "pages", "page", F.explode("_each").alias("_bits"))
        bits = bits.groupBy("_f", "pages", "page").agg(F.call_function("bitmap_or_agg", F.col("_bits")).alias("bits"))
        return bits.join(named, ["_f", "pages"]).select("file", "page", "bits")
