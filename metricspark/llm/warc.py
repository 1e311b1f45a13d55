"""WARC archives with a two-level capture index.

Tasks write their rows as WARC records, each a gzip member of its own, into archive files in the shared
folder. A payload that was seen before is a revisit record that names the first one. The index lists the
captures by reversed host (com,example,www)/path), sorted over all archives: level one are blocks of index
lines, compressed one by one; level two is a sparse directory with the first and last key of every block.
A look-up searches the directory by halving, reads the blocks it needs by their byte ranges, searches
their lines the same way, and reads records by theirs.

Files are named by the attempt that wrote them, and count only if the table of what was written names
them; that table is committed by Spark. So a task that runs again after an executor was lost leaves
at most a file that nothing refers to. A block grows with the number of captures so that the directory
keeps to `directory` rows, which is what is broadcast.

Defined results: null html is an empty payload, null and empty URLs have an empty key; rows that repeat
an id are captures of their own, and of equal payloads under the same smallest id all are responses; a null
id is never a smallest id unless all are null; line ends and other control characters in URLs are written
percent-encoded; other columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark.llm import frames
from metricspark.session import new_work_path

LEAST_BYTES = 100  # smaller payloads are never revisits
ARCHIVE_BYTES = 1 << 30
LINES = 2000
DIRECTORY = 500_000
RANGE = 4 << 20  # records of one such stretch of an archive are read by one task
TASK_BYTES = 64 << 20  # compressed, on average
DATE = "2024-01-01T00:00:00Z"  # the tables have no capture time
ID = "urn:x-page:"

_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that Spark names, and the path there."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(re.sub(r"^s3a://", "s3://", uri))


def clean(url: str | None) -> str:
    return _CONTROL.sub(lambda m: quote(m[0], safe=""), url or "")


def key_of(url: str | None) -> str:
    """The sort key of a URL: its host's labels from the last to the first, then the rest."""
    scheme, found, rest = clean(url).partition("://")
    if not found:
        return scheme
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:end].lower().split("."))) + ")" + rest[end:]


def record(page, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to) -> bytes:
    """One WARC record, compressed. A revisit has the response's head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_urn(page)}>",
        f"WARC-Target-URI: {clean(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{_urn(refers_to)}>")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def _urn(page) -> str:
    return ID + ("" if page is None else quote(str(page), safe=""))


def parse(member: bytes) -> dict:
    """The fields of a compressed record, its payload, and the length that its HTTP head states."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    return {"fields": fields, "payload": payload, "stated": stated}


def _page(urn: str | None) -> str | None:
    return unquote(urn.strip("<>").removeprefix(ID)) or None if urn else None


class _Writer:
    """Appends to files of one folder; a file that is large enough is followed by a new one."""

    def __init__(self, folder: str, kind: str):
        self.fs, self.path = opened(folder)
        self.folder, self.kind, self.stream, self.name, self.at = folder, kind, None, "", 0
        self.fs.create_dir(self.path, recursive=True)

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.stream is None or self.at >= ARCHIVE_BYTES:
            self.close()
            task = TaskContext.get()
            self.name = f"{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}.{self.kind}"
            self.stream, self.at = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None), 0
        self.stream.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def _table(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _archive(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder, "warc.gz")
        for batch in frames.slices(batches, 2):
            rows = []
            for r in batch.to_pylist():
                data = record(r["page"], r["url"], r["payload"], r["digest"], r["revisit"], r["refers_to"])
                rows.append((key_of(r["url"]), *writer.add(data)))
            yield _table(
                ["key", "file", "at", "size"], [pa.string(), pa.string(), pa.int64(), pa.int64()], rows
            )
        writer.close()

    return run


def _blocks(folder: str, lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder, "idx.z")
        waiting: list[list] = []

        def pack() -> pa.RecordBatch:
            data = "\n".join(json.dumps(r, ensure_ascii=False) for r in waiting).encode()
            row = (waiting[0][0], waiting[-1][0], *writer.add(zlib.compress(data, 6)))
            return _table(
                ["first", "last", "file", "at", "size"],
                [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()],
                [row],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                waiting.append(list(row))
                if len(waiting) >= lines:
                    yield pack()
                    waiting.clear()
        if waiting:
            yield pack()
        writer.close()

    return run


def _find_blocks(held):
    """(file, at, size, key) for every block that may list a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts, places = held.value
        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                key = key_of(url)
                at = bisect.bisect_left(lasts, key.encode())  # the first block that does not end before the key
                while at < len(firsts) and firsts[at] <= key.encode():
                    rows.append((*places[at], key))
                    at += 1
            yield _table(
                ["file", "at", "size", "key"], [pa.string(), pa.int64(), pa.int64(), pa.string()], rows
            )

    return run


def _read_blocks(folder: str):
    """The captures of the keys asked for; rows come with each block's together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        held, lines, keys = None, [], []
        for batch in batches:
            rows = []
            for file, at, size, key in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, at) != held:
                    with fs.open_input_file(f"{path}/{file}") as f:
                        data = zlib.decompress(f.read_at(size, at))
                    lines, held = [json.loads(x) for x in data.decode().split("\n")], (file, at)
                    keys = [x[0].encode() for x in lines]
                i = bisect.bisect_left(keys, key.encode())
                while i < len(keys) and keys[i] == key.encode():
                    rows.append(tuple(lines[i]))
                    i += 1
            yield _table(["key", "file", "at", "size"], [pa.string(), pa.string(), pa.int64(), pa.int64()], rows)

    return run


def _fetch(folder: str):
    names = ["page", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        name, stream = None, None
        for batch in batches:
            rows, held = [], 0
            for file, at, size in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if file != name:
                    if stream is not None:
                        stream.close()
                    name, stream = file, fs.open_input_file(f"{path}/{file}")
                found = parse(stream.read_at(size, at))
                fields, payload = found["fields"], found["payload"]
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                kind = fields["WARC-Type"]
                if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != found["stated"]):
                    raise ValueError(f"damaged record at {at} of {file}")
                refers = _page(fields.get("WARC-Refers-To"))
                body = payload if kind == "response" else None
                rows.append((_page(fields["WARC-Record-ID"]), found["stated"], digest, kind, refers, body))
                held += len(payload)
                if held > 8 << 20:
                    yield _table(names, kinds, rows)
                    rows, held = [], 0
            yield _table(names, kinds, rows)
        if stream is not None:
            stream.close()

    return run


class Archive:
    """Archive files, their index and its directory, in one folder."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str, directory: DataFrame, size: int):
        self.spark, self.folder, self.id_type, self.directory = spark, folder, id_type, directory
        # keys are small beside what they make tasks read, so the number of tasks follows the archives
        self.tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))

    def look_up(self, urls: DataFrame, url_col: str = "url") -> DataFrame:
        """Where the captures of these URLs are: key, file, at, size. Each URL counts once."""
        rows = self.directory.orderBy("first", "last", "file", "at").collect()
        found = (
            [r["first"].encode() for r in rows],
            [r["last"].encode() for r in rows],
            [(r["file"], r["at"], r["size"]) for r in rows],
        )
        held = self.spark.sparkContext.broadcast(found)
        kinds = "file string, at bigint, size bigint, key string"
        wanted = urls.select(F.col(url_col).cast("string")).distinct().mapInArrow(_find_blocks(held), kinds).distinct()
        return (
            wanted.repartition(self.tasks, "file", "at")
            .sortWithinPartitions("file", "at", "key")
            .mapInArrow(_read_blocks(f"{self.folder}/index"), "key string, file string, at bigint, size bigint")
        )

    def fetch(self, captures: DataFrame) -> DataFrame:
        """The records: page id, payload_bytes and payload_digest of the full payload, record_type (response
        or revisit), refers_to (a revisit's response), payload (null for revisits)."""
        stretch = F.floor(F.col("at") / RANGE)
        records = (
            captures.repartition(self.tasks, "file", stretch)
            .sortWithinPartitions("file", "at")
            .mapInArrow(
                _fetch(f"{self.folder}/archive"),
                "page string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, "
                "payload binary",
            )
        )
        ids = {c: F.col(c).cast(self.id_type) for c in ("page", "refers_to")}
        return records.withColumns(ids)


def write(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = LEAST_BYTES,
    lines: int = LINES,
    directory: int = DIRECTORY,
) -> Archive:
    """Write all rows into archives in a new folder, and their index."""
    spark = pages.sparkSession
    folder = new_work_path(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    id_type = rows.schema["page"].dataType.simpleString()
    digested = rows.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least_bytes
    first = frames.stage(
        digested.where(large)
        .groupBy("digest")
        .agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("__digest"), "first"),
        "first_captures",
    )
    revisit = F.col("__digest").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    marked = digested.join(first, (F.col("digest") == F.col("__digest")) & large, "left").select(
        "page", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to")
    )
    captures = frames.stage(
        marked.mapInArrow(_archive(f"{folder}/archive"), "key string, file string, at bigint, size bigint"), "captures"
    )
    total = captures.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    per_block = max(lines, -(-total.n // directory))
    blocks = (
        captures.repartitionByRange("key", "file", "at")
        .sortWithinPartitions("key", "file", "at")
        .mapInArrow(
            _blocks(f"{folder}/index", per_block), "first string, last string, file string, at bigint, size bigint"
        )
    )
    return Archive(spark, folder, id_type, frames.stage(blocks, "index_directory"), total.bytes or 0)
