"""WARC archives: written as whole-file gzip streams, normalised to a member per record with an index, read back.

Spark's own text writer puts the bytes down, so archives go to whatever store the paths
name, appear only when their task has succeeded, and survive lost executors. It writes a
separator after each row; rows leave out their last byte, which the separator then is.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.batches import BATCH_BYTES, rows_to_rows, ship
from driftline.llm.components import written

# Fixed values of the format.
VERSION, BREAK = "WARC/1.0", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records of an archive at most; Spark's shuffle bounds its bytes.
ARCHIVE_RECORDS = 50_000
FEED = 1 << 16


def base32(hex_digest: Column) -> Column:
    """A SHA-1 in hexadecimal as bare upper-case base32: ten digits at a time are eight characters."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    parts = [F.lpad(F.conv(F.substring(hex_digest, i, 10), 16, 32), 8, "0") for i in range(1, 41, 10)]
    return F.translate(F.concat(*parts), digits, BASE32)


def header(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(BREAK))


def record_texts(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int, date: str) -> DataFrame:
    """value: a WARC record per page, without its last line feed. Equal payloads meet by digest, length and a second hash."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    base = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"), base32(F.sha1(payload.cast("binary"))).alias("digest"),
        F.xxhash64(payload).alias("check"),
    )
    same = ["digest", "bytes", "check"]
    firsts = written(base.where(F.col("bytes") >= least_bytes).groupBy(*same).agg(F.min("id").alias("first")), "payloads")
    found = base.join(firsts, same, "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(F.col(c).cast("string")), F.lit("")), F.lit(">"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}"), header("Content-Length", F.col("bytes").cast("string")), F.lit(BREAK)
    )
    url = F.coalesce(F.regexp_replace("url", r"[\r\n]+", " "), F.lit("urn:none"))
    common = F.concat(
        header("WARC-Record-ID", name("id")), header("WARC-Target-URI", url), header("WARC-Date", date),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), header("Content-Type", "application/http;msgtype=response"),
    )
    again = F.concat(header("WARC-Type", "revisit"), header("WARC-Refers-To", name("first")), header("WARC-Profile", PROFILE))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    return found.select(F.concat(
        F.lit(f"{VERSION}{BREAK}"), F.when(revisit, again).otherwise(header("WARC-Type", "response")), common,
        header("Content-Length", length.cast("string")), F.lit(BREAK), http, F.when(revisit, F.lit("")).otherwise(F.col("payload")), F.lit("\r\n\r"),
    ).alias("value"))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", records: int = ARCHIVE_RECORDS,
) -> None:
    """Write a record per page to ``folder``, as archives of one gzip stream each.

    Of pages with equal payloads of ``least_bytes`` at least, that with the least id is a response and the
    others revisit it; a page without id revisits if any equal one has an id, and rows that repeat the least
    id are all responses. Null html is the empty payload, a null address urn:none; line breaks in addresses become spaces.
    """
    texts = record_texts(pages, id_col, url_col, html_col, least_bytes, date)
    texts.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", records).text(folder)


def inflated(data: bytes) -> Iterator[bytes]:
    """The content of gzip ``data``, of one or many members, in pieces of bounded size."""
    view, at = memoryview(data), 0
    while at < len(view):
        if view[at] == 0:  # padding between members
            at += 1
            continue
        stream = zlib.decompressobj(31)
        while not stream.eof and at < len(view):
            rest = view[at : at + FEED]
            at += len(rest)
            while rest:
                piece = stream.decompress(rest, 1 << 20)
                if piece:
                    yield piece
                rest = stream.unconsumed_tail
        at -= len(stream.unused_data)
        if not stream.eof:
            raise ValueError("a gzip stream is cut short")


def record_bytes(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The records of a WARC stream, each with its closing blank lines; one record is held at a time."""
    buffer, need = bytearray(), -1
    for piece in pieces:
        buffer += piece
        start = 0
        while True:
            if need < 0:
                end = buffer.find(b"\r\n\r\n", start)
                if end < 0:
                    break
                need = end + 8 - start + int(fields(bytes(buffer[start:end])).get("content-length", 0))
            if len(buffer) - start < need:
                break
            yield bytes(buffer[start : start + need])
            start, need = start + need, -1
        del buffer[:start]
    if bytes(buffer).strip():
        raise ValueError("a record is cut short")


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a header block, names in lower case."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split(BREAK)[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def member(record: bytes) -> bytes:
    """``record`` as a gzip member whose last byte is 0.

    That byte is the highest of the size, 0 below 16 MB; a longer record is followed by an empty member.
    """
    data = deflated(record)
    return data if data[-1] == 0 else data + deflated(b"")


def deflated(data: bytes) -> bytes:
    stream = zlib.compressobj(6, zlib.DEFLATED, 31)
    return stream.compress(data) + stream.flush()


def normalise_archives(spark: SparkSession, source: str, folder: str) -> None:
    """Rewrite the archives in ``source`` with a gzip member per record, and write their index beside them.

    Each file is inflated once, as a stream. ``folder``/kind=warc has the archives and ``folder``/kind=index
    JSON texts, divided by zero bytes: part (the number in the names of archive and index file), offset, length, id,
    type, digest. Records of one task make one archive, in the order read.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, offset, seq, held, rows = TaskContext.get().partitionId(), 0, 0, 0, []

        def sent():
            kinds, numbers, values = zip(*rows, strict=True)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(numbers, pa.int64()), pa.array(values, pa.binary())], ["kind", "seq", "value"])

        for batch in batches:
            for content in batch.column(0):
                for record in record_bytes(inflated(content.as_py())):
                    data, head = member(record), fields(record[: record.find(b"\r\n\r\n")])
                    entry = {
                        "part": part, "offset": offset, "length": len(data), "id": head.get("warc-record-id"),
                        "type": head.get("warc-type"), "digest": head.get("warc-payload-digest"),
                    }
                    rows.append(("warc", seq, data[:-1]))
                    rows.append(("index", seq, json.dumps(entry).encode()))
                    offset, seq, held = offset + len(data), seq + 1, held + len(data) + 300
                    if held >= BATCH_BYTES:
                        yield sent()
                        held = 0
        if rows:
            yield sent()

    files = archive_files(spark, source).select("content")
    made = files.mapInArrow(run, "kind string, seq bigint, value binary").sortWithinPartitions("kind", "seq")
    out = made.select("kind", F.col("value").cast("string").alias("value"))
    out.write.partitionBy("kind").option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 0).text(folder)


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """The archives in ``folder``: all its files, or those beside an index."""
    files = spark.read.format("binaryFile").load(folder)
    return files.where("kind = 'warc'") if "kind" in files.columns else files


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """part, offset, length, id, type, digest of each record of normalised archives."""
    lines = spark.read.option("lineSep", "\0").text(folder)
    # Without a record there is no folder for either kind.
    lines = lines.where("kind = 'index'") if "kind" in lines.columns else lines
    schema = "part int, offset bigint, length bigint, id string, type string, digest string"
    return lines.select(F.from_json("value", schema).alias("e")).select("e.*")


def read_records(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """id, type, record: the records that ``wanted`` names, rows of ``read_index``; a row that is there twice gives two.

    Of an archive only the bytes of these members are read, in the order of their places; other columns of
    ``wanted`` play no part, and rows with a null place or of no archive in ``folder`` give nothing.
    """
    files = archive_files(spark, folder).select("path", F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("int").alias("part"))
    placed = wanted.select("part", "offset", "length", "id", "type").dropna(subset=["offset", "length"]).join(files, "part")
    placed = placed.select("path", "offset", "length", "id", "type").sortWithinPartitions("path", "offset")

    def make():
        from pyarrow.fs import FileSystem

        path, file = None, None

        def read(place, offset, length, name, kind):
            nonlocal path, file
            if place != path:
                if file is not None:
                    file.close()
                system, inside = FileSystem.from_uri(re.sub("^file:/+", "file:///", place))
                path, file = place, system.open_input_file(inside)
            return ((name, kind, zlib.decompressobj(31).decompress(file.read_at(length, offset))),)

        return read

    return rows_to_rows(placed, "id string, type string, record binary", make)


def parsed(record: bytes) -> tuple[str | None, str | None, int, str, str | None]:
    """id, type, payload length and digest, referred id; a response's are taken from its payload."""
    split = record.find(b"\r\n\r\n")
    head = fields(record[:split])
    body = split + 4
    inner = record.find(b"\r\n\r\n", body)
    kind = head.get("warc-type")
    if kind == "response":
        payload = memoryview(record)[inner + 4 : body + int(head["content-length"])]
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    else:
        # What a revisit does not store its HTTP header still says.
        size = int(fields(record[body:inner]).get("content-length", 0))
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    return named(head.get("warc-record-id")), kind, size, digest, named(head.get("warc-refers-to"))


def named(uri: str | None) -> str | None:
    return unquote_plus(uri[len("<urn:page:") : -1]) or None if uri else None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """id, record_type, payload_bytes, payload_digest, refers_to: a row per record of archives of any gzip form."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [parsed(r) for r in record_bytes(inflated(content.as_py()))]
                if rows:
                    columns = zip(*rows, strict=True)
                    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "record_type", "payload_bytes", "payload_digest", "refers_to"]
                    )

    files = archive_files(spark, folder).select("content")
    return files.mapInArrow(run, "id string, record_type string, payload_bytes bigint, payload_digest string, refers_to string")


def archive_round_trip(pages: DataFrame, folder: str, id_col: str = "page_id", **options) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: a row per row of ``pages``, read from
    the normalised archives that are written below ``folder``; see write_archives for nulls and ties."""
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType
    write_archives(pages, f"{folder}/stream", id_col, **options)
    normalise_archives(spark, f"{folder}/stream", f"{folder}/members")
    rows = read_archives(spark, f"{folder}/members")
    return rows.select(
        F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
