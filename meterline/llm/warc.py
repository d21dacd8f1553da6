"""WARC archives as a Spark data source: `spark.read.format("warc")`, `df.write.format("warc")`.

Reading plans one partition per file or per group of small files. Predicates on the
record type and on the other header columns are pushed into the reader: a record's
header is parsed first, and where it fails, or where no payload is asked for, its block is
skipped by its length, unread and undecoded. A payload is asked for by having
`payload` in the schema.

Writing rolls a file at `rollBytes`, so that no file outgrows a partition. A task writes
below a folder of its job; the commit moves the files of the tasks that counted, so a
lost or repeated task leaves nothing behind. Payloads are gzipped HTTP bodies
(`Content-Encoding`), headers stay plain, so a block can be passed over.

Paths are resolved by pyarrow's file systems: a path with a scheme that it knows, or a
path that every executor has.

Defined cases. A null html is an empty payload. A record with a null page id carries none. A file
that ends inside a record, plain or gzipped, does not start with a WARC version, or has a record without a length, is
an error that names it, whatever is read of it.
Empty folders give no records. Extra columns are neither written nor read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds

SCHEMA = ("page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, "
          "refers_to long, payload binary")
#: Least size of a payload that is stored once for all its pages.
REVISIT_BYTES = 1000
VERSION = b"WARC/1.1"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _escaped(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, record_type, target_uri, payload_bytes, payload_digest, refers_to, payload) -> bytes:
    body = b""
    if record_type == "response":
        squeezed = zlib.compressobj(1, zlib.DEFLATED, 31)
        body = squeezed.compress(payload or b"") + squeezed.flush()
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Encoding: gzip\r\n"
            b"Content-Length: %d\r\n\r\n" % len(body))
    head = [VERSION.decode(), f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
            "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {payload_bytes}"]
    if target_uri is not None:
        head.append(f"WARC-Target-URI: {_escaped(target_uri)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if record_type == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page: {refers_to}")
    head.append(f"Content-Length: {len(http) + len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def _header(file, path: str) -> dict[str, str] | None:
    """The next record's header fields, lower-cased names; None at the end of the file."""
    line = file.readline()
    while line in (b"\r\n", b"\n"):
        line = file.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"{path}: no WARC record where one should start")
    fields: dict[str, str] = {}
    while True:
        line = file.readline()
        if not line:
            raise ValueError(f"{path}: ends inside a record")
        if line in (b"\r\n", b"\n"):
            return fields
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()


def _skip(file, length: int, path: str) -> None:
    """Pass over a block. A seek past the end is none, so its last byte is read."""
    if length:
        file.seek(length - 1, io.SEEK_CUR)
        if not file.read(1):
            raise ValueError(f"{path}: ends inside a record")


def _number(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch(r"-?\d+", value) else None


def _whole(step, *args, path: str = ""):
    """`step(*args)`, where a compressed file that breaks off is named."""
    try:
        return step(*args)
    except (EOFError, zlib.error, gzip.BadGzipFile) as broken:
        raise ValueError(f"{path or args[-1]}: ends inside a record") from broken


def _values(fields: dict[str, str]) -> dict:
    digest = fields.get("warc-payload-digest")
    return {"page_id": _number(fields.get("x-page-id")), "record_type": fields.get("warc-type"),
            "target_uri": fields.get("warc-target-uri"), "payload_bytes": _number(fields.get("x-payload-length")),
            "payload_digest": digest and digest.partition(":")[2], "refers_to": _number(fields.get("x-refers-to-page"))}


def _payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return gzip.decompress(body) if re.search(rb"(?im)^content-encoding:\s*gzip", head) else body


_TESTS = {
    ds.EqualTo: lambda v, w: v == w, ds.GreaterThan: lambda v, w: v > w, ds.LessThan: lambda v, w: v < w,
    ds.GreaterThanOrEqual: lambda v, w: v >= w, ds.LessThanOrEqual: lambda v, w: v <= w, ds.In: lambda v, w: v in w,
}


def _test(f):
    """(column, test) of a filter on a header column; None for one that Spark has to apply."""
    if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] == "payload":
        return None
    name = f.attribute[0]
    if isinstance(f, ds.IsNull):
        return name, lambda v: v is None
    if isinstance(f, ds.IsNotNull):
        return name, lambda v: v is not None
    if type(f) in _TESTS and f.value is not None:
        test, wanted = _TESTS[type(f)], f.value
        return name, lambda v: v is not None and test(v, wanted)
    return None


class Files(ds.InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(ds.DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.path = schema, options["path"]
        self.bytes = int(options.get("partitionBytes", 32 << 20))
        self.batch = int(options.get("batchBytes", 4 << 20))
        self.tests: list = []

    def pushFilters(self, filters):
        for f in filters:
            made = _test(f)
            if made is None:
                yield f
            else:
                self.tests.append(made)

    def partitions(self):
        system, path = _filesystem(self.path)
        found = system.get_file_info(pafs.FileSelector(path, recursive=False))
        files = sorted((f.path, f.size) for f in found if f.is_file and re.search(r"\.warc(\.gz)?$", f.path))
        groups: list[list[str]] = []
        room = 0
        for name, size in files:
            if not groups or size > room:
                groups.append([])
                room = self.bytes
            groups[-1].append(name)
            room -= size
        return [Files(g) for g in groups]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = _filesystem(self.path)
        arrow = to_arrow_schema(self.schema)
        names = arrow.names
        rows: list[dict] = []
        held = 0
        for path in partition.paths if partition else []:  # Spark plans one empty partition where there is none
            with system.open_input_file(path) as raw:
                file = gzip.open(raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
                while (fields := _whole(_header, file, path)) is not None:
                    length = _number(fields.get("content-length"))
                    if length is None or length < 0:
                        raise ValueError(f"{path}: a record without its length")
                    values = _values(fields)
                    if not all(test(values[name]) for name, test in self.tests):
                        _whole(_skip, file, length, path)
                        continue
                    if "payload" in names:
                        if values["record_type"] == "revisit":
                            _whole(_skip, file, length, path)
                            values["payload"] = None
                        else:
                            block = _whole(lambda: file.read(length), path=path)  # noqa: B023
                            if len(block) < length:
                                raise ValueError(f"{path}: ends inside a record")
                            values["payload"] = _payload(block)
                            held += len(values["payload"])
                    else:
                        _whole(_skip, file, length, path)
                    held += 200
                    rows.append(values)
                    if held >= self.batch:
                        yield pa.RecordBatch.from_pydict({n: [r[n] for r in rows] for n in names}, arrow)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict({n: [r[n] for r in rows] for n in names}, arrow)


class Written(ds.WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.roll = int(options.get("rollBytes", 32 << 20))
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, path = _filesystem(self.path)
        folder = f"{path}/_job-{self.job}"
        system.create_dir(folder, recursive=True)
        task = TaskContext.get()
        stem = f"{folder}/part-{task.partitionId():05d}-{uuid.uuid4().hex[:8]}"
        files, file, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if file is None or size >= self.roll:
                        if file is not None:
                            file.close()
                        files.append(f"{stem}-{len(files):03d}.warc")
                        file, size = system.open_output_stream(files[-1]), 0
                    size += file.write(record(*(row[n] for n in (
                        "page_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "refers_to", "payload"))))
        finally:
            if file is not None:
                file.close()
        return Written(files)

    def commit(self, messages) -> None:
        system, path = _filesystem(self.path)
        system.create_dir(path, recursive=True)
        if self.overwrite:
            old = system.get_file_info(pafs.FileSelector(path, recursive=False))
            for f in old:
                if f.is_file and f.path.endswith(".warc"):
                    system.delete_file(f.path)
        for message in messages:
            for name in message.files if message else []:
                system.move(name, f"{path}/{name.rpartition('/')[2]}")
        self._clear(system, path)

    def abort(self, messages) -> None:
        self._clear(*_filesystem(self.path))

    def _clear(self, system, path) -> None:
        folder = f"{path}/_job-{self.job}"
        if system.get_file_info(folder).type == pafs.FileType.Directory:
            system.delete_dir(folder)


class WarcSource(ds.DataSource):
    """Options: path, partitionBytes and batchBytes for reading, rollBytes for writing."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame, least: int = REVISIT_BYTES, salts: int = 8) -> DataFrame:
    """A WARC record per page: of equal payloads of `least` bytes or more, the largest page id holds the payload.

    Payloads are equal when length, SHA-1 and a second hash agree. Rows that share the
    largest page id each hold it. The list of repeated payloads meets the pages under a
    salt, so a payload of a third of all pages is many tasks.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", F.col("url").alias("target_uri"), html.alias("payload")).withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload"),
        "_h": F.xxhash64("payload"), "_salt": F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")})
    same = ["payload_digest", "_h", "payload_bytes"]
    firsts = own.where(F.col("payload_bytes") >= least).groupBy(*same).agg(
        F.count(F.lit(1)).alias("_n"), F.max("page_id").alias("_first")).where("_n > 1").drop("_n")
    firsts = firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = own.join(firsts, [*same, "_salt"], "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return met.select(
        "page_id", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        "payload_bytes", "payload_digest", F.when(revisit, F.col("_first")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def digest(payload: bytes) -> str:
    return hashlib.sha1(payload).hexdigest()
