"""WARC archives: written with Spark's text writer, read by a Python data source.

Archives are written by the cluster's own file writer, so lost tasks leave nothing behind and any file
system will do. The reader plans partitions of whole files, parses a record's headers first, tests pushed
filters on them and passes over the payloads of records that no one asked for.
"""
from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull

from marketloom.sources.shared import materialize, shared_dir

#: Payloads of at least so many bytes are stored once; equal ones revisit it.
LEAST_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARTITION_BYTES = 64 << 20
#: Columns from headers; a filter on any of them is decided before a payload is read.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to",
           "payload_digest": "warc-payload-digest", "content_type": "content-type"}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_length long, payload binary"


def record_name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``value``: a WARC record per row of ``page_id, url, html``, without the blank lines that end it.

    Of rows with equal payloads of LEAST_BYTES or more the one with the largest page_id is a response and
    the others revisit it. A null html is an empty payload. Rows repeated with their id are responses
    together if theirs is the largest id. Line ends in a url are percent-encoded; a null url has no header.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    # digests and ids only; html is not moved to find out what repeats
    stored = materialize(rows.filter(F.col("size") >= LEAST_BYTES).groupBy("digest").agg(F.max("page_id").alias("stored"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "warc-stored")
    rows = rows.join(stored.withColumnRenamed("digest", "same"), (F.col("digest") == F.col("same")) & (F.col("size") >= LEAST_BYTES), "left")
    revisit = F.col("stored").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("stored"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))

    def header(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value)

    lines = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), header("WARC-Type", F.when(revisit, "revisit").otherwise("response")), header("WARC-Record-ID", record_name(F.col("page_id"))),
        header("WARC-Date", date), header("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        F.when(revisit, header("WARC-Refers-To", record_name(F.col("stored")))), F.when(revisit, header("WARC-Profile", PROFILE)),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), header("WARC-Payload-Length", F.col("size").cast("string")),
        header("Content-Type", "application/http; msgtype=response"), header("Content-Length", F.octet_length(block).cast("string")))
    return rows.select(F.concat(lines, F.lit("\r\n\r\n"), block).alias("value"))


def write_warc(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """One archive per partition; the writer puts the two line ends behind each record."""
    records(pages).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.filters: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, IN and IS NOT NULL on header columns are decided here; Spark decides the others."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in HEADERS:
                yield f
            elif isinstance(f, EqualTo | EqualNullSafe) and f.value is not None:
                self.filters.append((name, frozenset([f.value])))
            elif isinstance(f, In):
                self.filters.append((name, frozenset(f.value)))
            elif isinstance(f, IsNotNull):
                self.filters.append((name, None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Whole files, small ones together up to PARTITION_BYTES: a compressed archive can't be entered in the middle."""
        system, root = filesystem(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out, size = [], PARTITION_BYTES
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            if size + f.size > PARTITION_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out or [Files([])]

    def wanted(self, head: dict[str, str]) -> bool:
        return all((v := head.get(HEADERS[name])) is not None and (values is None or v in values) for name, values in self.filters)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(self.path)
        names, rows, size = [*HEADERS, "payload_length", "payload"], [], 0
        schema = pa.schema([(c, pa.string()) for c in HEADERS] + [("payload_length", pa.int64()), ("payload", pa.binary())])

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, zip(*rows, strict=True), strict=True)], schema=schema)

        for path in partition.paths:
            with system.open_input_stream(path, compression=None) as raw:
                stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
                for head, payload in archive(io.BufferedReader(stream, 1 << 20), self.wanted, self.payload):
                    length = head.get("warc-payload-length")
                    rows.append((*(head.get(h) for h in HEADERS.values()), int(length) if length else None, payload))
                    size += len(payload or b"")
                    if size > 8 << 20 or len(rows) >= 2000:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)``; option ``payload`` = ``false`` leaves all payloads unread."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def headers(stream: io.BufferedReader) -> dict[str, str]:
    """Header lines to the blank line, names in lower case; lines that begin with white space continue the one before."""
    out: dict[str, str] = {}
    last = ""
    while line := stream.readline().rstrip(b"\r\n"):
        if line[:1] in b" \t" and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, _, value = line.partition(b":")
        last = name.strip().lower().decode("latin-1")
        out[last] = value.strip().decode("utf-8", "replace")
    return out


def skip(stream: io.BufferedReader, n: int) -> None:
    while n > 0:
        n -= len(stream.read(min(n, 1 << 20))) or n


def archive(stream: io.BufferedReader, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and payload of each wanted record. The payload is what follows the HTTP headers; revisits have none."""
    while version := stream.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        head = headers(stream)
        n = int(head.get("content-length", "0"))
        if not wanted(head):
            skip(stream, n)
        elif not payload or head.get("warc-type") == "revisit":
            skip(stream, n)
            yield head, None
        else:
            block = stream.read(n)
            if head.get("content-type", "").startswith("application/http"):
                block = block.partition(b"\r\n\r\n")[2]
            yield head, block


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url`` of the archives of ``pages``, read back.

    Length and digest of a response are taken from the payload that was read, those of a revisit from its
    headers. One row per row of ``pages``; extra columns are ignored; an empty table gives an empty result.
    """
    path = shared_dir(pages.sparkSession, "warc")
    write_warc(pages, path)
    found = read_warc(pages.sparkSession, path)

    def page(name: str) -> Column:
        return F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")

    response = F.col("record_type") == "response"
    return found.select(
        page("record_id").alias("page_id"), F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"), F.col("target_uri").alias("url"))
