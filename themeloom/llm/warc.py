"""WARC archives: writing, normalising monolithic gzip to one member a record, a sidecar offset index, reading back."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import table, text_bytes, tidy
from themeloom.session import work_folder

LEAST_REVISIT = 100
"""Payload bytes from which a repeated payload is written as a revisit."""
RECORDS = 50_000
"""Records of an archive at most, so that a file stays readable as a whole."""
PIECE = 1 << 20
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# Spark's text writer ends each row by a separator. An empty gzip member is one that any gzip reader passes over.
EMPTY_MEMBER = _member(b"")


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, digest, bytes, refers_to of every page; ``refers_to`` is null for responses.

    Of equal payloads of at least ``least`` bytes the one of smallest page_id is the response and the others, null ids
    included, refer to it; if all their ids are null, all are responses. Rows that repeat a page_id and a payload are
    both responses. Other columns of ``pages`` are not looked at.
    """
    payload = text_bytes("html")
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.length(payload).cast("long").alias("bytes"))
    firsts = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("__first"), F.count("*").alias("__copies"))
    firsts = firsts.where("__copies > 1").drop("__copies")  # few, and no hot digest is more than one row here
    other = F.col("page_id").isNull() | (F.col("page_id") > F.col("__first"))
    return rows.join(firsts, "digest", "left").withColumn("refers_to", F.when(other, F.col("__first"))).drop("__first")


def records(planned: DataFrame) -> DataFrame:
    """The WARC record of every planned page without its closing blank lines, as ``record``."""
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    html = F.coalesce("html", F.lit(""))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"), html)
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(block)
    url = F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\r\\n]", " "), F.lit("\r\n"))
    return planned.withColumn("block", block).select(F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name("page_id"),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n"), F.coalesce(url, F.lit("")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name("refers_to"), F.lit("\r\n"))).otherwise(""),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.lit("\r\nContent-Type: "), F.when(revisit, "message/http").otherwise("application/http; msgtype=response"),
        F.lit("\r\nContent-Length: "), F.length(F.col("block").cast("binary")).cast("string"), F.lit("\r\n\r\n"), F.col("block"),
    ).alias("record"))


def write_monolithic(planned: DataFrame, folder: str) -> None:
    """Writes archives, each one gzip stream over all its records, as many harvesters leave them."""
    records(planned).write.option("compression", "gzip").option("lineSep", END.decode()).option("maxRecordsPerFile", RECORDS).text(folder)


def inflated(content: bytes) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, a piece at a time."""
    view, at = memoryview(content), 0
    while at < len(view):
        machine = zlib.decompressobj(31)
        while at < len(view) and not machine.eof:
            data = view[at:at + PIECE]
            while data and not machine.eof:
                yield machine.decompress(data, PIECE)
                at += len(data) - len(machine.unconsumed_tail) - len(machine.unused_data)
                data = b"" if machine.eof else machine.unconsumed_tail
        if not machine.eof:
            raise ValueError("the gzip stream ends early")


def split_records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and raw bytes, header included, of every record of an inflated stream."""
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            piece = next(stream, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        while not (end := held.find(END) + 4) > 3:
            if not need(len(held) + 1):
                if held.strip():
                    raise ValueError("a record ends early")
                return
        head = bytes(held[:end])
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}
        size = end + int(fields["content-length"])
        if not need(size + len(END)) or held[size:size + 4] != END:
            raise ValueError("a record is not closed")
        yield fields, bytes(held[:size])
        del held[:size + 4]


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Rewrites every record of the archives of a folder as its own gzip member; each task inflates whole files, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                members, size = [], 0
                for _, record in split_records(inflated(content.as_py())):
                    members.append(_member(record + END))
                    size += len(members[-1])
                    if size > PIECE:
                        yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])
                        members, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("content")
    members = files.mapInArrow(tidy(run), "member binary").select(F.col("member").cast("string"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", RECORDS).text(target)


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and inflated bytes of the members of an archive that hold something."""
    view, at = memoryview(content), 0
    while at < len(view):
        machine, start, out = zlib.decompressobj(31), at, []
        while not machine.eof:
            data = view[at:at + PIECE]
            if not data:
                raise ValueError("the gzip stream ends early")
            out.append(machine.decompress(data))
            at += len(data) - len(machine.unused_data)
        if record := b"".join(out):
            yield start, at - start, record


def parse(record: bytes) -> dict:
    """What one record says: its payload is none for a revisit, whose digest and length come from its header."""
    fields, raw = next(split_records(iter([record])))
    block = raw[raw.index(END) + 4:]
    payload = None if fields["warc-type"] == "revisit" else block[block.index(END) + 4:]
    number = lambda name: None if fields.get(name, "<urn:x-page:none>") == "<urn:x-page:none>" else int(fields[name][len("<urn:x-page:"):-1])
    return {
        "page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
        "refers_to": number("warc-refers-to"), "payload": payload,
        "payload_bytes": int(fields["x-payload-length"]) if payload is None else len(payload),
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:") if payload is None else hashlib.sha256(payload).hexdigest(),
    }


READ = "archive string, offset long, length long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of normalised archives: where it lies, and what it says. Digest and length are those of the bytes read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, size = [], 0
                for offset, length, record in members(content.as_py()):
                    rows.append({"archive": path.rsplit("/", 1)[1], "offset": offset, "length": length} | parse(record))
                    size += len(record)
                    if size > 4 * PIECE:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, kind)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(tidy(run), READ)


def archive(pages: DataFrame, folder: str) -> tuple[str, str]:
    """Writes pages below ``folder`` as normalised archives with their offset index; returns both places.

    An empty table gives archives without records. Null html is an empty payload, a null url leaves its field out.
    """
    spark = pages.sparkSession
    write_monolithic(plan_records(pages), f"{folder}/monolithic")
    normalise(spark, f"{folder}/monolithic", f"{folder}/archives")
    index = read(spark, f"{folder}/archives").select("archive", "offset", "length", "page_id", "url", "record_type", "payload_digest")
    index.write.parquet(f"{folder}/index")
    return f"{folder}/archives", f"{folder}/index"


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of ``pages`` as it is read back from the archives; null html is an empty payload (see ``archive``)."""
    archives, _ = archive(table(spark, sf_dir, "pages", "page_id", "url", "html"), work_folder(spark))
    return read(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 100) END AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM f
"""
