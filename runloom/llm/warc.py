"""WARC archives as a PySpark data source, and the split into response and revisit records.

Writing: each task writes files of about `ROLL_BYTES`, one gzip member per record,
under names that no other attempt uses; the commit writes a manifest with the files
of the successful attempts, so what a lost or repeated task left behind is never read.

Reading: files (from the manifest, or all `*.warc` and `*.warc.gz`) are packed into
partitions. Filters on the header columns `record_type`, `page_id`, `url`,
`payload_digest` and `refers_to` are pushed into the source. A record's headers are
parsed first; records that fail a filter, and payloads that are not among the
`columns` option, are passed over without being decoded or kept.

Paths are opened through `pyarrow.fs`, so any store it knows will do.

Defined results: null html is an empty payload; a null page id is written as an empty
one and read as null; a null url has no header line; line breaks in a url are written
percent-encoded; repeated rows with equal id and payload are all responses if their id
is the group's smallest; rows without id are revisits if another row of the group has
one; an empty table writes no records; other columns are left out.
"""

from __future__ import annotations

import gzip
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
    IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)

from runloom.session import park

ROLL_BYTES = 64 << 20
PACK_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
MANIFEST = "_manifest"
#: Characters of base 32 as Spark's `conv` writes them, and as RFC 4648 does.
CONV32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType()),
])


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it."""
    return pafs.FileSystem.from_uri(path if urlsplit(path).scheme else os.path.abspath(path))


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: four groups of ten hex digits, eight characters each."""
    digits = F.sha1(payload)
    group = lambda i: F.lpad(F.conv(F.substring(digits, 10 * i + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[group(i) for i in range(4)]), CONV32, BASE32)


def records(pages: DataFrame, min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row per page as it is to be written: what is a revisit, and of which page."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    base = pages.select(
        F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), base32_sha1(payload).alias("payload_digest"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"), payload.alias("payload"),
    )
    # only digests that occur twice; written, so that Spark knows how few they are when it picks the join
    repeated = park(
        base.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").drop("n"),
        "warc",
    )
    own = F.col("first").isNull() | F.col("first").eqNullSafe(F.col("page_id"))
    return base.join(repeated, ["payload_digest", "payload_bytes"], "left").select(
        "page_id", "url", F.when(own, "response").otherwise("revisit").alias("record_type"), "payload_digest", "payload_bytes",
        F.when(~own, F.col("first")).alias("refers_to"), F.when(own, F.col("payload")).alias("payload"),
    )


def write(rows: DataFrame, path: str) -> None:
    """Rows as `records` gives them, into a new archive folder."""
    rows.sparkSession.dataSource.register(WarcSource)
    rows.select(*SCHEMA.names).write.format("warc").option("path", path).mode("append").save()


def read(spark: SparkSession, path: str, columns: Sequence[str] = SCHEMA.names) -> DataFrame:
    """An archive folder; only `columns` are filled, and filters on headers reach the files."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("path", path).option("columns", ",".join(columns)).load().select(*columns)


class WarcSource(DataSource):
    """`spark.read.format("warc")` and `df.write.format("warc")`."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, self.options.get("columns"))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


class Written(WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = store(self.path)
        fs.create_dir(folder, recursive=True)
        files: list[dict] = []
        out, held = None, 0
        try:
            for batch in iterator:
                columns = [batch.column(n).to_pylist() for n in SCHEMA.names]
                for row in zip(*columns, strict=True):
                    if out is None or held > ROLL_BYTES:
                        if out is not None:
                            out.close()
                        files.append({"file": f"{uuid.uuid4().hex}.warc.gz", "records": 0})
                        out, held = fs.open_output_stream(f"{folder}/{files[-1]['file']}", compression=None), 0
                    record = compose(*row)
                    held += len(record)
                    files[-1]["records"] += 1
                    out.write(gzip.compress(record, 3, mtime=0))
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = store(self.path)
        fs.create_dir(folder, recursive=True)
        lines = "".join(json.dumps(f) + "\n" for m in messages if m for f in m.files)
        with fs.open_output_stream(f"{folder}/{MANIFEST}-{uuid.uuid4().hex}.jsonl", compression=None) as out:
            out.write(lines.encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = store(self.path)
        for m in messages:
            for f in m.files if m else ():
                fs.delete_file(f"{folder}/{f['file']}")


def compose(page_id, url, record_type, digest, size, refers_to, payload) -> bytes:
    """A WARC record; a revisit holds the response's HTTP headers without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if record_type == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


#: Header filters that can be decided from one record's headers.
TESTS = {
    EqualTo: lambda f, v: v is not None and v == f.value, In: lambda f, v: v is not None and v in f.value,
    GreaterThan: lambda f, v: v is not None and v > f.value, GreaterThanOrEqual: lambda f, v: v is not None and v >= f.value,
    LessThan: lambda f, v: v is not None and v < f.value, LessThanOrEqual: lambda f, v: v is not None and v <= f.value,
    StringStartsWith: lambda f, v: v is not None and v.startswith(f.value), IsNull: lambda f, v: v is None,
    IsNotNull: lambda f, v: v is not None,
}
HEADERS = ("page_id", "url", "record_type", "payload_digest", "refers_to")


class Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, columns: str | None):
        self.path, self.schema, self.filters = path, schema, []
        self.columns = set(columns.split(",")) if columns else set(SCHEMA.names)

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, folder = store(self.path)
        there = {i.base_name: i for i in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if i.is_file}
        manifests = [i for n, i in there.items() if n.startswith(MANIFEST)]
        names = [n for n in there if re.search(r"\.warc(\.gz)?$", n)]
        if manifests:
            names = []
            for m in manifests:
                with fs.open_input_stream(m.path, compression=None) as f:
                    names += [json.loads(line)["file"] for line in f.read().decode().splitlines()]
        packs, held = [], 0
        for n in sorted(names):
            if not packs or held + there[n].size > PACK_BYTES:
                packs.append([])
                held = 0
            packs[-1].append(n)
            held += there[n].size
        return [Files(p) for p in packs] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, folder = store(self.path)
        rows, held = [], 0
        for name in partition.files:
            with fs.open_input_stream(f"{folder}/{name}", compression=None) as f:
                data = memoryview(f.read())  # files are rolled at a bounded size
            for row in parsed(data, name.endswith(".gz"), self.filters, "payload" in self.columns):
                rows.append(row)
                held += 200 + len(row[-1] or b"")
                if held > BATCH_BYTES:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        found = dict(zip(SCHEMA.names, zip(*rows, strict=True), strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(found[f.name], kinds[f.dataType.simpleString()]) for f in self.schema.fields], names=self.schema.names
        )


def parsed(data: memoryview, packed: bool, filters: Sequence, wanted: bool) -> Iterator[tuple]:
    """Records of a file that pass the filters, in the order of `SCHEMA`."""
    for member in members(data) if packed else blocks(data):
        head = member.head()
        if head is None:
            continue
        fields = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        digest = fields.get("warc-payload-digest")
        row = {
            "page_id": number(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": fields.get("warc-type"),
            "payload_digest": digest.removeprefix("sha1:") if digest else None, "refers_to": number(fields.get("warc-refers-to")),
        }
        if not all(TESTS[type(f)](f, row[f.attribute[0]]) for f in filters):
            member.skip()
            continue
        http, size = member.http(int(fields["content-length"]))
        payload = member.rest(wanted and row["record_type"] == "response")
        yield (*(row[n] for n in SCHEMA.names[:4]), size, row["refers_to"], payload)


def number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


class Member:
    """One record, read from the front as far as it is asked for."""

    def __init__(self, more):
        self.more, self.seen, self.at, self.body = more, bytearray(), 0, 0

    def upto(self, mark: bytes, start: int) -> int:
        while (end := self.seen.find(mark, start)) < 0:
            got = self.more()
            if not got:
                return -1
            self.seen += got
        return end

    def head(self) -> bytes | None:
        end = self.upto(b"\r\n\r\n", 0)
        if end < 0:
            return None
        self.at = end + 4
        return bytes(self.seen[:end])

    def http(self, length: int) -> tuple[bytes, int]:
        """HTTP headers of the block, and the payload length they state."""
        self.body = self.at + length
        end = self.upto(b"\r\n\r\n", self.at)
        head = bytes(self.seen[self.at : end])
        self.at = end + 4
        found = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
        return head, int(found[1]) if found else self.body - self.at

    def rest(self, wanted: bool) -> bytes | None:
        if not wanted:
            self.skip()
            return None
        while len(self.seen) < self.body:
            got = self.more()
            if not got:
                break
            self.seen += got
        payload = bytes(self.seen[self.at : self.body])
        self.skip()
        return payload

    def skip(self) -> None:
        while self.more():
            pass


def members(data: memoryview) -> Iterator[Member]:
    """gzip members of a file; each is inflated only as far as it is read, the rest is dropped unseen."""
    at, step = 0, 1 << 14
    while at < len(data):
        state = {"at": at, "z": zlib.decompressobj(31)}

        def more(state=state) -> bytes:
            while not state["z"].eof and state["at"] < len(data):
                chunk = data[state["at"] : state["at"] + step]
                got = state["z"].decompress(chunk)
                state["at"] += len(chunk) - len(state["z"].unused_data)
                if got:
                    return got
            return b""

        member = Member(more)
        yield member
        member.skip()
        at = state["at"]


def blocks(data: memoryview) -> Iterator[Member]:
    """Records of a plain file; `Content-Length` leads over what is not wanted."""
    at = 0
    while at < len(data):
        step = 1 << 16
        while (end := bytes(data[at : at + step]).find(b"\r\n\r\n")) < 0 and at + step < len(data):
            step *= 4
        if end < 0:
            if bytes(data[at:]).strip():
                raise ValueError(f"record at byte {at} has headers without end")
            return
        length = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", bytes(data[at : at + end]))[1])
        stop = at + end + 4 + length
        state = {"given": False}

        def more(state=state, part=data[at:stop]) -> bytes:
            given, state["given"] = state["given"], True
            return b"" if given else bytes(part)

        yield Member(more)
        at = stop + 4
