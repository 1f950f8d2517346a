"""WARC archives as a Spark data source (format "warc"), for writing and reading.

Archives are WARC/1.1 with one gzip member per record. A member's header carries its lengths (the
"sl" extra field), so a reader seeks past a record it does not want. The writer leaves one
archive per task and, when all tasks are done, a list of them with places to cut large ones at;
files of failed attempts are not on the list. The reader plans a partition for each piece,
takes predicates on the record type and on headers, parses headers first, and inflates and
checks a payload only for a record that passes them.

A folder that has no such list is one of ordinary archives (``.warc.gz``, whose members need not carry lengths, or ``.warc``),
which are read one file at a time.

Files are opened through pyarrow's file systems, by URI: local and mounted folders, HDFS, S3, GCS.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from corpusloom.llm import bloom
from corpusloom.llm.common import cut, skew_join, text_or_empty

READ_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
WRITE_COLUMNS = ("record_id", "record_type", "target_uri", "refers_to", "payload")
#: Columns whose values stand in the record's headers, and their names there.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LIST = "_archives.json"
PIECE = 8 << 20
START = 64 << 10


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    import pyarrow.fs

    if re.match(r"file:/(?!/)", uri):
        uri = f"file://{uri[5:]}"
    return pyarrow.fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header's value on one line; control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member with its compressed and plain length in the extra field (0 where they need over 32 bits)."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    whole = 24 + len(body) + 8
    lengths = (whole, len(data)) if max(whole, len(data)) < 1 << 32 else (0, 0)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, *lengths) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(record_id: str, record_type: str, target_uri: str | None, refers_to: str | None, payload: bytes, date: str) -> bytes:
    """An HTTP response record, or a revisit whose block ends with the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if record_type == "response" else http
    values = {"WARC-Type": record_type, "WARC-Record-ID": record_id, "WARC-Date": date, "WARC-Target-URI": target_uri, "WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-Refers-To": refers_to}
    values |= {"WARC-Profile": PROFILE} if record_type == "revisit" else {}
    values |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    head = "".join(f"{k}: {_line(v)}\r\n" for k, v in values.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Archive(WriterCommitMessage):
    name: str
    size: int
    pieces: list[int]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str, overwrite: bool):
        self.path, self.date, self.overwrite = path, date, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archive:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        size, pieces = 0, [0]
        with fs.open_output_stream(posixpath.join(root, name), compression=None) as out:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in WRITE_COLUMNS]
                for i in range(batch.num_rows):
                    rid, kind, uri, refers, payload = (c[i].as_py() for c in columns)
                    data = member(record(rid, kind, uri, refers, payload or b"", self.date))
                    if size - pieces[-1] >= PIECE:
                        pieces.append(size)
                    out.write(data)
                    size += len(data)
        return Archive(name, size, pieces)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        listed, at = [], posixpath.join(root, LIST)
        if not self.overwrite and fs.get_file_info(at).is_file:
            with fs.open_input_stream(at) as f:
                listed = json.loads(f.read())
        listed += [[m.name, m.size, m.pieces] for m in messages if m is not None and m.size]
        with fs.open_output_stream(at) as f:
            f.write(json.dumps(listed).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(posixpath.join(root, m.name))


class Piece(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.wanted: dict[str, set] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted[column] & values if column in self.wanted else values
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.present.add(column)
            else:
                yield f

    def partitions(self) -> list[Piece]:
        import pyarrow.fs

        fs, root = filesystem(self.path)
        at = posixpath.join(root, LIST)
        if fs.get_file_info(at).is_file:
            with fs.open_input_stream(at) as f:
                listed = json.loads(f.read())
        else:
            found = fs.get_file_info(root)
            files = [found] if found.is_file else fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
            listed = sorted([posixpath.relpath(x.path, root) if x.path != root else "", x.size, [0]] for x in files if x.is_file and x.path.endswith((".warc.gz", ".warc")))
        return [Piece(name, a, b) for name, size, pieces in listed for a, b in zip(pieces, [*pieces[1:], size], strict=True)] or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        if partition.start == partition.end:
            return
        fs, root = filesystem(self.path)
        with fs.open_input_file(posixpath.join(root, partition.name) if partition.name else root) as f:
            at = partition.start
            while at < partition.end:
                row, at = (self._plain if partition.name.endswith(".warc") or root.endswith(".warc") else self._member)(f, at, partition.end)
                if row:
                    yield row

    def _plain(self, f, at: int, end: int) -> tuple[tuple | None, int]:
        """A record that is not compressed: the headers say how long its block is."""
        f.seek(at)
        data = b""
        while b"\r\n\r\n" not in data and f.tell() < end:
            data += f.read(min(4096, end - f.tell()))
        head, _, block = data.partition(b"\r\n\r\n")
        values, named, wanted = self._headers(head)
        length = int(named.get("content-length", 0))
        after = at + len(head) + 4 + length
        if wanted:
            block = block[:length] if len(block) >= length else block + f.read(length - len(block))
        f.seek(after)
        while after < end and f.read(1) in (b"\r", b"\n"):
            after += 1
        return (self._row(values, block) if wanted else None), after

    def _headers(self, head: bytes) -> tuple[dict, dict, bool]:
        """The columns' values, all headers by lower-case name, and whether the record is wanted."""
        named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
        values = {c: named.get(h.lower()) for c, h in HEADERS.items()}
        values["payload_digest"] = (values["payload_digest"] or "").removeprefix("sha1:") or None
        return values, named, all(values[c] in v for c, v in self.wanted.items()) and all(values[c] is not None for c in self.present)

    def _row(self, values: dict, block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?mi)^Content-Length: *(\d+)", http)
        if values["record_type"] != "response" or not self.payload:
            payload = None
        elif re.fullmatch("[A-Z2-7]{32}", values["payload_digest"] or "") and values["payload_digest"] != digest(payload):
            raise ValueError(f"{values['record_id']}: the payload does not match its digest")
        return (*values.values(), int(length[1]) if length else None, payload)

    def _member(self, f, at: int, end: int) -> tuple[tuple | None, int]:
        """A record in a gzip member of its own."""
        f.seek(at)
        inflate, data, raw = zlib.decompressobj(31), b"", f.read(min(4096, end - at))
        whole = struct.unpack_from("<I", raw, 16)[0] if raw[3:4] == b"\x04" and raw[12:14] == b"sl" else 0
        while b"\r\n\r\n" not in data and not inflate.eof and raw:  # the headers, and little more
            data += inflate.decompress(raw, START)
            raw = inflate.unconsumed_tail or (b"" if inflate.eof else f.read(4096))
        head, _, block = data.partition(b"\r\n\r\n")
        values, named, wanted = self._headers(head)
        if not wanted and whole:
            return None, at + whole
        parts = [block]
        while not inflate.eof and raw:
            chunk = inflate.decompress(raw, 1 << 20)
            parts += [chunk] if wanted else []
            raw = inflate.unconsumed_tail or (b"" if inflate.eof else f.read(1 << 20))
        if not inflate.eof:
            raise ValueError(f"{values['record_id']}: the member at {at} breaks off")
        after = at + (whole or f.tell() - at - len(inflate.unused_data))
        return (self._row(values, b"".join(parts)[: int(named.get("content-length", 0))]) if wanted else None), after


class WarcSource(DataSource):
    """Options: path, payload ("false" leaves payloads alone), date (of the records written)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "2024-01-01T00:00:00Z"), overwrite)


def register(spark: SparkSession) -> None:
    """Make format "warc" known to the session, with predicates pushed to its reader."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Columns to write, one record per page: of equal payloads of ``least_bytes`` or more, that with the smallest id is the response and the others revisit it.

    A null page counts as an empty payload, a null url is left out, a null id comes after all others. Rows that repeat the smallest id are
    responses too. Malformed UTF-8 is replaced. Other columns are not looked at. An empty table gives no record. Only rows
    whose payload a bitmap may hold twice are shuffled with it.
    """
    payload = F.encode(F.make_valid_utf8(text_or_empty(html_col)), "UTF-8")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("target_uri"), payload.alias("payload"), F.sha2(payload, 256).alias("key"))
    first = cut(rows.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first"))
    alone, maybe = bloom.parted(rows, "key", first.select("key"))
    found = skew_join(maybe, first, ["key"], "left")
    one = alone.withColumn("first", F.col("id")).unionByName(found.withColumn("first", F.coalesce("first", "id")))
    revisit = (F.octet_length("payload") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return one.select(name("id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.when(revisit, name("first")).alias("refers_to"), "payload")


def write_archives(rows: DataFrame, path: str) -> None:
    """Write records (WRITE_COLUMNS; others are left out) to archives below ``path``, one per task, beside those that are there.

    A null payload counts as empty, null headers are left out. An empty table leaves an empty list.
    """
    register(rows.sparkSession)
    rows.select(*WRITE_COLUMNS).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records (READ_SCHEMA) of a folder of archives, or of one file; payloads of responses only, and none at all without ``payload``.

    Filters on the record type and the headers are applied before payloads are inflated.
    """
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
