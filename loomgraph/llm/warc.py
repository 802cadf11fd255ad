"""WARC as a PySpark data source: write archives, read them back with pushed-down filters.

Reading plans one partition per archive file.  Filters on ``record_type``,
``page_id`` and ``target_uri`` are decided from a record's header block alone;
the payload of a record that fails them, or that no asked-for column needs, is
passed over by its Content-Length without being read.

Archives of other writers are read too: ``.warc.gz`` with a member a record,
header names in any case, undecodable header bytes replaced.

Writing makes uncompressed WARC/1.1 files.  Payloads are HTTP-free
(``resource``-like bodies under ``response`` records).  Revisit records carry
the digest and length of the payload they repeat, and no body.

Defined cases: a null payload is empty; equal payloads of at least
``least_bytes`` bytes keep one response, that of the smallest page_id (a null
page_id counts as the largest), ties broken by url; others revisit it; an
empty table writes no record; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from loomgraph.llm import common, storage

SCHEMA = "page_id long, target_uri string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
#: A file is closed and the next begun beyond this size.
FILE_BYTES = 256_000_000
_BATCH_BYTES = 4_000_000
_FIELDS = {"WARC-Type": "record_type", "WARC-Target-URI": "target_uri", "WARC-Payload-Digest": "payload_digest", "X-Page-Id": "page_id", "X-Payload-Length": "payload_bytes", "X-Refers-To-Page": "refers_to"}
_BY_NAME = {k.lower(): v for k, v in _FIELDS.items()}
_NUMBERS = {"page_id", "payload_bytes", "refers_to"}


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n")


def record(row: dict[str, Any]) -> bytes:
    """The bytes of one record."""
    body = row["payload"] if row["record_type"] == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{row['page_id']}:{row['target_uri']}')}>"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_one_line(row['target_uri'])}")
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}"]
    if row["page_id"] is not None:
        lines.append(f"X-Page-Id: {row['page_id']}")
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if row["refers_to"] is not None:
            lines.append(f"X-Refers-To-Page: {row['refers_to']}")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode("utf-8") + body + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, file_bytes: int) -> None:
        self.folder, self.file_bytes, self.job = folder, file_bytes, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Each attempt writes under names of its own; the driver moves those of the attempts that count."""
        moves: list[tuple[str, str]] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size > self.file_bytes:
                        if out:
                            out.close()
                        name = uuid.uuid4().hex
                        moves.append((f"{self.folder}/_{self.job}/{name}", f"{self.folder}/{name}.warc"))
                        fs, path = storage.filesystem(moves[-1][0])
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                        out, size = fs.open_output_stream(path, buffer_size=1 << 20), 0
                    raw = record(row)
                    out.write(raw)
                    size += len(raw)
        finally:
            if out:
                out.close()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        for a, b in (m for x in messages if x for m in x.moves):
            fs, source = storage.filesystem(a)
            fs.move(source, storage.filesystem(b)[1])
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = storage.filesystem(f"{self.folder}/_{self.job}")
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_dir(path)


class Archive(InputPartition):
    def __init__(self, uri: str) -> None:
        super().__init__(uri)


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType) -> None:
        self.folder, self.columns = folder, schema.names
        self.arrow = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema])
        self.wanted: dict[str, set] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, membership and not-null of header fields are taken; the rest goes back to Spark."""
        headers = set(_FIELDS.values())
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if name not in headers:
                yield f
            elif isinstance(f, IsNotNull):
                self.present.add(name)
            else:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values

    def partitions(self) -> list[InputPartition]:
        fs, path = storage.filesystem(self.folder)
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return [Archive("")]
        prefix = "" if "://" not in self.folder else self.folder[: self.folder.index("://")] + "://"
        found = [x for x in fs.get_file_info(pafs.FileSelector(path)) if x.is_file and x.base_name.endswith((".warc", ".warc.gz"))]
        return [Archive(f"{self.folder.rstrip('/')}/{x.base_name}" if prefix else x.path) for x in sorted(found, key=lambda x: -x.size)] or [Archive("")]

    def _kept(self, head: dict[str, Any]) -> bool:
        return all(head[k] in v for k, v in self.wanted.items()) and all(head[k] is not None for k in self.present)

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.value:
            return
        fs, path = storage.filesystem(partition.value)
        with_body = "payload" in self.columns
        rows: list[dict[str, Any]] = []
        held = 0
        with fs.open_input_file(path) as raw:
            f = io.BufferedReader(raw, 1 << 20) if hasattr(raw, "readinto") else raw
            if partition.value.endswith(".gz"):  # one member a record, read as one stream
                f = io.BufferedReader(gzip.GzipFile(fileobj=f), 1 << 20)
            while line := f.readline():
                if not line.startswith(b"WARC/"):
                    continue
                head: dict[str, Any] = dict.fromkeys(self.columns) | dict.fromkeys(_FIELDS.values())
                length = 0
                while (line := f.readline()) not in (b"\r\n", b""):
                    name, _, value = line.decode("utf-8", "replace").partition(":")
                    name, value = name.strip().lower(), value.rstrip("\r\n").removeprefix(" ")
                    if name == "content-length":
                        length = int(value)
                    elif field := _BY_NAME.get(name):
                        head[field] = (int(value) if value.lstrip("-").isdigit() else None) if field in _NUMBERS else value.strip() if field == "record_type" else value.removeprefix("sha1:") if field == "payload_digest" else value
                own = head["payload_bytes"] is not None  # archives of other writers do not state it, nor do they escape their URIs
                if not own:
                    head["payload_bytes"] = length
                if with_body and self._kept(head):
                    head["payload"] = f.read(length)
                    held += length
                    keep = True
                else:
                    f.seek(length, io.SEEK_CUR)
                    keep = not with_body and self._kept(head)
                if keep:
                    if own and head.get("target_uri"):
                        head["target_uri"] = re.sub(r"\\(.)", lambda m: {"r": "\r", "n": "\n"}.get(m[1], m[1]), head["target_uri"])
                    rows.append({c: head[c] for c in self.columns})
                if held > _BATCH_BYTES or len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist(rows, self.arrow)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.arrow)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").mode("append").save(folder)``; a user schema without ``payload`` reads headers only."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("fileBytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """A WARC record per page, repeated payloads as revisits.

    Digests are worked out in the scan; only (digest, page_id, url) is
    shuffled to find the first of each, as partial minima.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("_sha", F.sha1("payload"))
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("target_uri").alias("uri"))
    long_enough = F.col("payload_bytes") >= least_bytes
    heads = base.where(long_enough).groupBy("_sha").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
    # a digest seen once needs no partner; the written table tells the planner its size, which broadcasts it
    # while small and otherwise joins by shuffle, splitting a hot digest
    heads = common.written(heads.where("_n > 1").select("_sha", "_first"), "repeated-payloads")
    rows = base.join(heads.withColumnRenamed("_sha", "_of"), (F.col("_sha") == F.col("_of")) & long_enough, "left")
    again = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(place)
    return rows.select(
        "page_id", "target_uri", F.when(again, "revisit").otherwise("response").alias("record_type"),
        _base32(F.col("_sha")).alias("payload_digest"), "payload_bytes", F.when(again, F.col("_first.page_id")).alias("refers_to"), "payload",
    )


def _base32(sha_hex):
    """Base32 of a 40-digit hexadecimal digest, eight groups of 20 bits."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    letters = F.array(*[F.lit(c) for c in alphabet])
    groups = [F.conv(F.substring(sha_hex, 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.element_at(letters, (F.shiftright(g, s).bitwiseAND(F.lit(31)) + 1)) for g in groups for s in (15, 10, 5, 0)])


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    register(pages.sparkSession)
    common.small_batches(pages.sparkSession)
    rows = records(pages, least_bytes)
    # revisits drop their payload before it leaves the JVM
    rows = rows.withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")))
    rows.write.format("warc").mode("append").save(folder)


def read(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Records of the archives; leaving ``payload`` out of ``columns`` skips every body."""
    register(spark)
    full = StructType.fromDDL(SCHEMA)
    schema = StructType([full[c] for c in columns]) if columns else full
    return spark.read.format("warc").schema(schema).load(folder)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` and describe them from what is read back; responses from their payload, revisits from their header."""
    spark = pages.sparkSession
    folder = common.shared_path(spark, "warc")
    write(pages, folder)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    bodies = read(spark, folder).where(F.col("record_type") == "response")
    bodies = bodies.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), _base32(F.sha1("payload")).alias("payload_digest"), "record_type", "refers_to")
    repeats = read(spark, folder, names).where(F.col("record_type") == "revisit")
    return bodies.unionByName(repeats)
