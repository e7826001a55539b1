"""Operator 13: WARC archives whose records are Zstandard frames with a shared dictionary.

Every record is a frame of its own, so that a reader can start at any of them. An archive begins with a skippable frame that
holds the dictionary of its other frames. The dictionary is trained on the archive's own first records (TRAIN_BYTES of
them at most, so that a writer holds no more than that and one record); the rest of the archive follows as it comes. An
archive that passes ARCHIVE_BYTES is closed, and its task begins another.

Which capture is the response and which revisits it is decided in the JVM from digests: equal payloads are grouped by SHA-1, a
second hash and length, so that a group is one row before it meets its captures again, however many it has.

Archives are a Spark data source in both directions. A task writes under a name of its own attempt; the manifest that commit()
writes names the archives that count, so what a lost executor leaves is never read. Archives are read as streams, a task
each, and payloads are checked against their digests. Paths go through Arrow's file systems, so that any store it knows will do.

Defined cases: a null html is an empty payload, a null url is about:blank, a null page_id is the smallest; rows that repeat a page
and its payload are captures of their own, of which one, the last scanned, is the response; an empty table gives no archives and
no rows; other columns are not read. Rows are told apart by their place in the scan, which has to be repeatable, as a table's is.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import posixpath
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import staged, table, unstage
from ..staging import remove, shared_path

#: Equal payloads of at least so many bytes are written once.
REVISIT_BYTES = 1000
#: Of an archive: record bytes that train its dictionary, the dictionary's size, compressed bytes after which it is closed.
TRAIN_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES, LEVEL = 4 << 20, 64 << 10, 256 << 20, 3
#: Bytes of payload after which a reader hands on what it has.
BATCH_BYTES = 4 << 20
#: Frame that decoders skip, and the manifest's name. Fixed values.
SKIPPABLE, MANIFEST = 0x184D2A5D, "archives.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("page_id", T.StringType()), T.StructField("target_uri", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType()),
])
_ARROW = pa.schema([(f.name, {T.LongType: pa.int64(), T.BinaryType: pa.binary()}.get(type(f.dataType), pa.string())) for f in SCHEMA.fields])


def store(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it."""
    local = re.match(r"file:/*(/.*)", path)
    return fs.FileSystem.from_uri(local[1] if local else path)


def record(of: dict, date: str) -> bytes:
    """A WARC record: header fields, then an HTTP response whose body a revisit leaves out."""
    body = of["payload"] or b""
    length = len(body) if of["record_type"] == "response" else of["payload_bytes"] or 0
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block += body if of["record_type"] == "response" else b""
    fields = {"WARC-Type": of["record_type"], "WARC-Record-ID": f"<{of['record_id']}>", "WARC-Date": date, "WARC-Target-URI": urllib.parse.quote(of["target_uri"] or "about:blank", safe="%/:=&?~#+!$,;'@()*[]")}
    if of["page_id"] is not None:
        fields["WARC-Page-ID"] = of["page_id"]
    if of["record_type"] == "revisit":
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{of['refers_to']}>"}
    fields |= {"WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(of["payload_digest"])).decode(), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """Trained on the records; where they are too few for that, the bytes of the last ones, which serve as well."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-DICTIONARY_BYTES:]


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int, int]] = field(default_factory=list)


class Archive:
    """One archive as it is written: held back until the dictionary is known."""

    def __init__(self, files: fs.FileSystem, path: str, train_bytes: int) -> None:
        self.out, self.train_bytes = files.open_output_stream(path, compression=None), train_bytes  # else Arrow compresses what ends on .zst once more
        self.held, self.held_bytes, self.records, self.coder = [], 0, 0, None

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.coder:
            self.out.write(self.coder.compress(data))
            return
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= self.train_bytes:
            self._begin()

    def _begin(self) -> None:
        raw = dictionary(self.held)
        self.out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        self.coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw))
        for data in self.held:
            self.out.write(self.coder.compress(data))
        self.held = []

    def close(self) -> int:
        """Its size."""
        if not self.coder:
            self._begin()
        size = self.out.tell()
        self.out.close()
        return size


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.date = options["path"], overwrite, options.get("date", "1970-01-01T00:00:00Z")
        self.archive_bytes, self.train_bytes = int(options.get("archive_bytes", ARCHIVE_BYTES)), int(options.get("train_bytes", TRAIN_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, folder = store(self.path)
        files.create_dir(folder, recursive=True)
        done, archive, name = Written(), None, ""
        for batch in iterator:
            for k in range(batch.num_rows):
                of = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if archive is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    archive = Archive(files, posixpath.join(folder, name), self.train_bytes)
                archive.add(record(of, self.date))
                if archive.coder and archive.out.tell() >= self.archive_bytes:
                    done.archives.append((name, archive.records, archive.close()))
                    archive = None
        if archive:
            done.archives.append((name, archive.records, archive.close()))
        return done

    def commit(self, messages: list) -> None:
        files, folder = store(self.path)
        files.create_dir(folder, recursive=True)
        manifest = posixpath.join(folder, MANIFEST)
        before = [] if self.overwrite else manifest_of(self.path)
        with files.open_output_stream(manifest + ".new") as out:
            out.write(json.dumps(before + [list(a) for m in messages if m for a in m.archives]).encode())
        files.move(manifest + ".new", manifest)

    def abort(self, messages: list) -> None:
        files, folder = store(self.path)
        for m in filter(None, messages):
            for name, _, _ in m.archives:
                files.delete_file(posixpath.join(folder, name))


def manifest_of(path: str) -> list:
    """(name, records, bytes) of the archives that were committed."""
    files, folder = store(path)
    manifest = posixpath.join(folder, MANIFEST)
    if files.get_file_info(manifest).type == fs.FileType.NotFound:
        return []
    with files.open_input_stream(manifest) as f:
        return json.loads(f.read())


def records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an archive."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("an archive begins with the frame of its dictionary")
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    text = io.BufferedReader(decoder.stream_reader(stream, read_across_frames=True), 1 << 18)
    while line := text.readline():
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        fields = {}
        while (line := text.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        block = text.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]) or text.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield fields, block


@dataclass
class ArchiveFile(InputPartition):
    name: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"

    def partitions(self) -> Sequence[InputPartition]:
        return [ArchiveFile(name) for name, _, _ in manifest_of(self.path)]

    def read(self, partition: ArchiveFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one partition of none
            return
        files, folder = store(self.path)
        bare = lambda x: x and x.strip("<>")
        rows, size = [], 0
        with files.open_input_stream(posixpath.join(folder, partition.name), compression=None) as f:
            for of, block in records(f):
                kind, said = of["warc-type"], base64.b32decode(of["warc-payload-digest"].removeprefix("sha1:")).hex()
                payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
                if payload is not None and hashlib.sha1(payload).hexdigest() != said:
                    raise ValueError(f"{of['warc-record-id']}: the payload isn't the one that its digest names")
                rows.append((bare(of["warc-record-id"]), kind, of.get("warc-page-id"), of.get("warc-target-uri"), bare(of.get("warc-refers-to")), said, None if payload is None else len(payload), payload if self.payload else None))
                size += len(payload or b"") if self.payload else 0
                if size >= BATCH_BYTES or len(rows) >= 4096:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class WarcSource(DataSource):
    """options: path; to write: date, archive_bytes, train_bytes; to read: payload (false leaves payloads out once checked)."""

    @classmethod
    def name(cls) -> str:
        return "loomspark_warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options, overwrite)


def write_archives(captures: DataFrame, path: str, **options: object) -> None:
    """`captures` has the columns of SCHEMA."""
    captures.sparkSession.dataSource.register(WarcSource)
    captures.select(*SCHEMA.names).write.format("loomspark_warc").options(path=path, **options).mode("append").save()


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("loomspark_warc").options(path=path, payload=str(payload).lower()).load()


def _record_id(page: Column, row: Column) -> Column:
    digest = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("")), row.cast("string")))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(digest, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"))


def captures(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", least: int = REVISIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """A capture for each page, of equal payloads all but one revisits; and the staged groups that it reads."""
    payload = F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("page"), F.col(url).cast("string").alias("target_uri"), payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "check": F.xxhash64("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    same = ["payload_digest", "check", "payload_bytes"]
    groups = rows.where(F.col("payload_bytes") >= least).groupBy(*[F.col(c).alias(f"g_{c}") for c in same]).agg(F.max(F.struct("page", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
    groups = staged(groups.where("n > 1").drop("n"), "payloads")
    on = [F.col(c) == F.col(f"g_{c}") for c in same]
    met = rows.join(groups, on[0] & on[1] & on[2], "left").withColumn("again", F.coalesce(F.col("best.row") != F.col("row"), F.lit(False)))
    out = met.select(
        _record_id(F.col("page"), F.col("row")).alias("record_id"), F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), F.col("page").cast("string").alias("page_id"), "target_uri",
        F.when(F.col("again"), _record_id(F.col("best.page"), F.col("best.row"))).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~F.col("again"), F.col("payload")).alias("payload"),
    )
    return out, groups


def resolved(found: DataFrame, key_type: str) -> DataFrame:
    """Records as read, with the size of what a revisit refers to and the page of it."""
    base = found.select(F.col("page_id").cast(key_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", "record_id", F.col("refers_to").alias("to"))
    responses = base.where("record_type = 'response'").select(*base.columns[:4], F.lit(None).cast(key_type).alias("refers_to"))
    first = base.where("record_type = 'response'").select(F.col("record_id").alias("at"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("size"))
    revisits = base.where("record_type = 'revisit'").join(first, F.col("to") == F.col("at"))
    return responses.unionByName(revisits.select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archives in the shared folder, read back; the archives go once their records are known."""
    pages = table(spark, sf_dir, "pages")
    rows, groups = captures(pages)
    path = shared_path(spark, "warc")
    write_archives(rows, path)
    found = staged(read_archives(spark, path, payload=False).drop("payload"), "records")
    unstage(groups)
    remove(spark, path)
    return resolved(found, pages.schema["page_id"].dataType.simpleString())


SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS best FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes < {REVISIT_BYTES} OR page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> best THEN best END AS refers_to
FROM g
"""
