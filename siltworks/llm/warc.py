"""WARC archives as a PySpark Python data source.

Writing: every task writes one file of gzip members, one member per record, under a name of its own attempt; the
driver writes a list of the committed files last, so what a lost or repeated attempt left behind is never read.

Reading: files are planned into partitions of about `partition_bytes`.  Predicates on the record type and other header
columns are pushed to the reader, which parses a record's headers first and passes over the block of a record that
they reject.  With option payloads=false no payload is decoded; with verify=true each payload is hashed against its
digest and a mismatch fails the read.

Paths go through pyarrow.fs, so any store that it knows will do (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

READ_SCHEMA = (
    "record_id string, record_type string, refers_to string, target_uri string, date string, content_type string, "
    "payload_digest string, payload_bytes long, payload binary"
)
# Fixed: names of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "refers_to": "warc-refers-to", "target_uri": "warc-target-uri",
    "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest",
}
MANIFEST = "_committed.json"
CHUNK = 1 << 20


def _filesystem(path: str):
    return pa.fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else (pa.fs.LocalFileSystem(), path)


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _line(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def record_bytes(r: dict) -> bytes:
    """One record.  A revisit keeps the HTTP header of its response but no payload."""
    payload = r["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {_line(r['content_type'] or 'text/html; charset=utf-8')}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = r["record_type"] == "revisit"
    block = http if revisit else http + payload
    head = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-Date", r["date"])]
    if r["target_uri"] is not None:
        head.append(("WARC-Target-URI", r["target_uri"]))
    head.append(("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{r['refers_to']}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {_line(v)}\r\n" for k, v in head).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


class _Committed(WriterCommitMessage):
    def __init__(self, files: list[str]) -> None:
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.level = options["path"], int(options.get("level", 6))
        self.roll = int(options.get("file_bytes", 1 << 30))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for i in range(batch.num_rows):
                if out is None or size >= self.roll:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                record = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                gz = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                member = gz.compress(record_bytes(record)) + gz.flush()
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
        return _Committed(files)

    def commit(self, messages) -> None:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages) -> None:
        """Files without a list are never read."""


class _Files(InputPartition):
    def __init__(self, files: list[str]) -> None:
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.partition_bytes = int(options.get("partition_bytes", 16 << 20))
        self.payloads = options.get("payloads", "true") == "true"
        self.verify = options.get("verify", "false") == "true"
        self.wanted: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters):
        for f in filters:
            known = not isinstance(f, (EqualTo, In, IsNotNull)) or len(f.attribute) != 1 or f.attribute[0] not in COLUMNS
            if known:
                yield f  # Spark applies what is not taken here
            else:
                values = None if isinstance(f, IsNotNull) else frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.wanted.append((f.attribute[0], values))

    def partitions(self):
        fs, root = _filesystem(self.path)
        infos = {i.base_name: i.size for i in fs.get_file_info(pa.fs.FileSelector(root)) if re.search(r"\.warc(\.gz)?$", i.base_name)}
        if fs.get_file_info(f"{root}/{MANIFEST}").type != pa.fs.FileType.NotFound:
            with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
                infos = {x: infos[x] for x in json.loads(f.read())}
        bins: list[list[str]] = []
        room = 0
        for name, size in sorted(infos.items(), key=lambda x: (-x[1], x[0])):
            if not bins or size > room:
                bins.append([])
                room = self.partition_bytes
            bins[-1].append(name)
            room -= size
        return [_Files(b) for b in bins] or [_Files([])]

    def _row(self, head: dict, values: dict, stream) -> tuple:
        left = int(head.get("content-length", 0))
        http = re.match(r"application/http\b", head.get("content-type", "")) is not None
        length, payload = (None, None) if http else (left, None)
        if http:
            while left:
                line = stream.readline(left)
                left -= len(line)
                if m := re.match(rb"(?i)content-length:\s*(\d+)", line):
                    length = int(m[1])
                if not line.strip():
                    break
        if values["record_type"] != "revisit" and (self.payloads or self.verify):
            digest, parts = hashlib.sha1(), []
            while left:
                part = stream.read(min(left, CHUNK))
                if not part:
                    raise ValueError(f"record {values['record_id']} ends early")
                left -= len(part)
                digest.update(part)
                if self.payloads:
                    parts.append(part)
            payload = b"".join(parts) if self.payloads else None
            found = base32_sha1(digest.hexdigest())
            if self.verify and found != values["payload_digest"]:
                raise ValueError(f"the payload of {values['record_id']} has digest {found}, not {values['payload_digest']}")
        _skip(stream, left)
        return (*values.values(), length, payload)

    def read(self, partition):
        fs, root = _filesystem(self.path)
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        kinds = [pa.binary() if n == "payload" else pa.int64() if n == "payload_bytes" else pa.string() for n in names]
        rows: list[tuple] = []
        held = 0

        def flush():
            nonlocal rows, held
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
            rows, held = [], 0
            return batch

        for name in partition.files:
            raw = fs.open_input_file(f"{root}/{name}")
            stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), CHUNK) if name.endswith(".gz") else io.BufferedReader(raw, CHUNK)
            while (head := _headers(stream)) is not None:
                values = {c: head.get(h) for c, h in COLUMNS.items()}
                for c in ("record_id", "refers_to"):
                    values[c] = values[c] and values[c].strip("<>")
                values["payload_digest"] = values["payload_digest"] and values["payload_digest"].removeprefix("sha1:")
                if all(values[c] is not None and (v is None or values[c] in v) for c, v in self.wanted):
                    rows.append(self._row(head, values, stream))
                    held += len(rows[-1][-1] or b"")
                else:
                    _skip(stream, int(head.get("content-length", 0)))
                if len(rows) >= 4096 or held >= 32 * CHUNK:
                    yield flush()
            raw.close()
        if rows:
            yield flush()


def _skip(stream, n: int) -> None:
    if n and not isinstance(stream.raw, gzip.GzipFile):
        stream.seek(n, 1)
        return
    while n:
        part = stream.read(min(n, CHUNK))
        if not part:
            raise ValueError("a record ends early")
        n -= len(part)


def _headers(stream) -> dict | None:
    """The next record's headers, names in lower case; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record starts at {line[:40]!r}")
    head: dict = {}
    while (line := stream.readline()).strip():
        k, _, v = line.decode("utf-8", "replace").partition(":")
        head[k.strip().lower()] = v.strip()
    return head


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, key: str, payload: str, uri: str, prefix: str = "urn:page:", date: str = "1970-01-01T00:00:00Z", revisit_bytes: int = 0) -> DataFrame:
    """The archive records of a table of pages, one for each row, in the columns the writer takes.

    Of rows with equal payloads of at least `revisit_bytes` bytes, those with the smallest key are responses and the
    others revisits of it; smaller payloads are all responses.  A null payload is empty, a null uri leaves its header
    out.  Rows with a null key revisit like others but are never referred to.  Repeated rows are repeated records.
    Digests of one payload are reduced map-side; the join back on the digest is one that Spark splits where it is hot.
    """
    body: Column = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.to_binary(F.lit(""), F.lit("utf-8")))
    base = pages.select(F.col(key).alias("_key"), F.col(uri).cast("string").alias("_uri"), body.alias("_body"), F.sha1(body).alias("_sha1"))
    large = base.where(F.octet_length("_body") >= revisit_bytes)
    repeated = large.groupBy(F.col("_sha1").alias("_digest")).agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _first is not null")
    joined = base.join(repeated, (F.col("_sha1") == F.col("_digest")), "left")
    revisit = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("_key"))
    identifier = lambda c: F.concat(F.lit(prefix), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    return joined.select(
        identifier("_key").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, identifier("_first")).alias("refers_to"), F.col("_uri").alias("target_uri"), F.lit(date).alias("date"),
        F.lit("text/html; charset=utf-8").alias("content_type"), base32_of_hex(F.col("_sha1")).alias("payload_digest"), F.col("_body").alias("payload"),
    )


def base32_of_hex(hex_digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits: eight groups of five digits are 20 bits, four letters each."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for k in range(0, 40, 5):
        bits = F.conv(F.substring(hex_digest, k + 1, 5), 16, 10).cast("int")
        parts += [F.substr(letters, F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def write_archive(rows: DataFrame, path: str, level: int = 6) -> None:
    register(rows.sparkSession)
    rows.write.format("warc").mode("append").option("path", path).option("level", level).save()


def read_archive(spark: SparkSession, path: str, payloads: bool = True, verify: bool = False, partition_bytes: int = 16 << 20) -> DataFrame:
    register(spark)
    flag = lambda x: "true" if x else "false"
    return spark.read.format("warc").option("path", path).option("payloads", flag(payloads)).option("verify", flag(verify)).option("partition_bytes", partition_bytes).load()
