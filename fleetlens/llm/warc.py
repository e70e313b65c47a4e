"""WARC archives: segmented records written by Spark, reassembled on reading.

A page becomes one WARC record whose block is an HTTP response with its payload in
chunked transfer framing. Blocks longer than ``segment_bytes`` are cut into a first
segment and ``continuation`` records. Of records with equal payloads of at least
``revisit_bytes`` bytes the one with the smallest id keeps the payload; the others
are ``revisit`` records that refer to it and hold no payload.

Reading groups continuation records by the id of their origin, orders them by
segment number, verifies the total length and the payload digest, and decodes the
framing. Only records that were cut are shuffled with their blocks.

Edge cases: a null body is an empty payload; a null id is written as such, comes
after all other ids, and is the response only if no equal payload has an id; rows that
repeat the id and the payload of a response are responses too, each gives one row;
an empty table gives no rows; other columns of the input are not read. A record
with a missing segment, a wrong length, broken framing or a digest that does not
match has ``valid`` false and a null payload; it stays in the result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import map_batches, staged
from fleetlens.session import scratch_dir

SEGMENT_BYTES = 4096
CHUNK_BYTES = 1024
REVISIT_BYTES = 100
RECORDS_PER_FILE = 4000

# The text sink ends each row with this, which is how a WARC record ends.
RECORD_END = "\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "record_id string, warc_type string, page_id long, target string, payload_digest string, "
    "refers_to string, refers_to_page long, segment int, origin string, total_length long, block binary"
)


def frame(payload: bytes, chunk_bytes: int) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for start in range(0, len(payload), chunk_bytes):
        chunk = payload[start : start + chunk_bytes]
        parts += [b"%x\r\n" % len(chunk), chunk, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframe(body: bytes) -> bytes:
    """Inverse of ``frame``; also accepts chunk extensions and trailers. Raises ValueError."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is cut off")
        size, at = int(body[at:end].split(b";")[0], 16), end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        parts.append(body[at : at + size])
        at += size + 2


def header(fields: list[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in fields if value is not None), "", ""]
    return "\r\n".join(lines).encode()


def one_line(value: str | None) -> str | None:
    return None if value is None else re.sub(r"[\x00-\x1f\x7f]+", " ", value)


def page_records(page: dict, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page, without their final blank lines."""
    named = [
        ("WARC-Target-URI", one_line(page["target"])),
        ("X-Page-ID", page["page_id"]),
        ("WARC-Payload-Digest", f"sha256:{page['digest']}"),
    ]
    if page["refers_to"] is not None:
        fields = [
            ("WARC-Type", "revisit"),
            ("WARC-Record-ID", f"<{page['record_id']}>"),
            *named,
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", f"<{page['refers_to']}>"),
            ("X-Refers-To-Page-ID", page["refers_to_page"]),
            ("Content-Length", len(REVISIT_HEAD)),
        ]
        yield header(fields) + REVISIT_HEAD
        return
    block = HTTP_HEAD + frame(page["payload"], chunk_bytes)
    cuts = range(0, len(block), segment_bytes)
    for number, start in enumerate(cuts, 1):
        piece = block[start : start + segment_bytes]
        if number == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{page['record_id']}>"), *named]
        else:
            fields = [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", f"<{page['record_id']}-{number}>"),
                ("WARC-Segment-Origin-ID", f"<{page['record_id']}>"),
            ]
        if len(cuts) > 1:
            fields.append(("WARC-Segment-Number", number))
            if number == len(cuts):
                fields.append(("WARC-Segment-Total-Length", len(block)))
        yield header([*fields, ("Content-Length", len(piece))]) + piece


def record_id(page_id: Column, digest: Column) -> Column:
    """The same for rows that repeat id and payload, else distinct."""
    return F.concat(F.lit("urn:md5:"), F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("none")), digest)))


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    revisit_bytes: int = REVISIT_BYTES,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Gzipped WARC files under ``path``, any file system that Spark writes to."""
    payload = F.coalesce(F.encode(F.col(body_col), "UTF-8"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("target"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    # Grouped by two columns and joined on one, so that the join has shuffles of its
    # own on both sides, which adaptive execution can split where a digest is hot.
    firsts = (
        rows.select("digest", F.length("payload").alias("size"), "page_id")
        .where(F.col("size") >= revisit_bytes)
        .groupBy("digest", "size")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("digest", "first_id", F.lit(True).alias("shared"))
    )
    later = F.col("shared").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    decided = rows.join(firsts, "digest", "left").select(
        record_id(F.col("page_id"), F.col("digest")).alias("record_id"),
        "page_id",
        "target",
        "digest",
        F.when(later, record_id(F.col("first_id"), F.col("digest"))).alias("refers_to"),
        F.when(later, F.col("first_id")).alias("refers_to_page"),
        F.when(~later, F.col("payload")).alias("payload"),
    )

    def records(batch: pa.RecordBatch) -> dict:
        names = batch.schema.names
        out = []
        for row in range(batch.num_rows):
            page = {name: batch.column(at)[row].as_py() for at, name in enumerate(names)}
            out += page_records(page, segment_bytes, chunk_bytes)
        return {"record": out}

    (
        map_batches(decided, records, "record binary")
        .select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", RECORD_END)
        .option("maxRecordsPerFile", records_per_file)
        .option("compression", "gzip")
        .text(path)
    )


def stream_records(raw: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields and block of each record of one (gzipped) archive."""
    buffer, feed = bytearray(), inflate(raw)

    def fill(size: int) -> bool:
        while len(buffer) < size:
            more = next(feed, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while True:
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not fill(seen + 1):
                if bytes(buffer).strip():
                    raise ValueError("archive ends inside a header")
                return
        lines = bytes(buffer[:end]).decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start, size = end + 4, int(fields["Content-Length"])
        if not fill(start + size + 4):
            raise ValueError("archive ends inside a record")
        yield fields, bytes(buffer[start : start + size])
        del buffer[: start + size + 4]


def inflate(raw: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Plain bytes of a file of any number of gzip members, or of a plain file."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    while raw:
        member, at = zlib.decompressobj(31), 0
        while not member.eof and at < len(raw):
            yield member.decompress(raw[at : at + step])
            at += step
        raw = member.unused_data + raw[at:]


def parse_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema(
        [
            ("record_id", pa.string()),
            ("warc_type", pa.string()),
            ("page_id", pa.int64()),
            ("target", pa.string()),
            ("payload_digest", pa.string()),
            ("refers_to", pa.string()),
            ("refers_to_page", pa.int64()),
            ("segment", pa.int32()),
            ("origin", pa.string()),
            ("total_length", pa.int64()),
            ("block", pa.binary()),
        ]
    )

    def number(value):
        return None if value is None else int(value)

    def bare(value):
        return None if value is None else value.strip("<>")

    for batch in batches:
        for content in batch.column("content"):
            out, held = [], 0
            for fields, block in stream_records(content.as_py()):
                out.append(
                    (
                        bare(fields["WARC-Record-ID"]),
                        fields["WARC-Type"],
                        number(fields.get("X-Page-ID")),
                        fields.get("WARC-Target-URI"),
                        fields.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None,
                        bare(fields.get("WARC-Refers-To")),
                        number(fields.get("X-Refers-To-Page-ID")),
                        number(fields.get("WARC-Segment-Number")),
                        bare(fields.get("WARC-Segment-Origin-ID")),
                        number(fields.get("WARC-Segment-Total-Length")),
                        block,
                    )
                )
                held += len(block)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), kinds)], schema=kinds)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), kinds)], schema=kinds)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record, continuation records included."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(parse_archives, RECORD)


def payload_of(batch: pa.RecordBatch) -> dict:
    """Decode the HTTP block of each reassembled response."""
    payloads, sizes, digests, valid = [], [], [], []
    for whole, block, claimed in zip(
        batch.column("whole").to_pylist(), batch.column("block"), batch.column("payload_digest").to_pylist()
    ):
        payload = None
        if whole:
            head, _, body = block.as_py().partition(b"\r\n\r\n")
            try:
                payload = unframe(body) if b"transfer-encoding: chunked" in head.lower() else body
            except ValueError:
                payload = None
        digest = None if payload is None else hashlib.sha256(payload).hexdigest()
        if claimed is not None and digest != claimed:
            payload, digest = None, None
        payloads.append(payload)
        sizes.append(None if payload is None else len(payload))
        digests.append(digest)
        valid.append(payload is not None)
    kept = {name: batch.column(name) for name in ("record_id", "page_id", "target")}
    return kept | {"payload": payloads, "payload_bytes": sizes, "payload_digest": digests, "valid": valid}


def reassemble(records: DataFrame) -> DataFrame:
    """One row per response: its continuation records joined, verified and decoded."""
    plain = records.where("segment IS NULL AND warc_type = 'response'").select(
        "record_id", "page_id", "target", "payload_digest", F.lit(True).alias("whole"), "block"
    )
    cut = records.where("segment IS NOT NULL").select(
        F.coalesce("origin", "record_id").alias("record_id"),
        "page_id",
        "target",
        "payload_digest",
        "total_length",
        "segment",
        "block",
    )
    # A record's segments fit in memory as the record does; a set, as rows that
    # repeat a page have equal segments.
    joined = (
        cut.groupBy("record_id")
        .agg(
            F.max("page_id").alias("page_id"),
            F.max("target").alias("target"),
            F.max("payload_digest").alias("payload_digest"),
            F.max("total_length").alias("total_length"),
            F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("parts"),
            F.count_if(F.col("segment") == 1).alias("copies"),
        )
        # Joined as strings, byte by byte and in one pass, however many segments there are.
        .withColumn("whole_block", F.expr("cast(array_join(transform(parts, p -> cast(p.block as string)), '') as binary)"))
        .withColumn(
            "whole",
            F.expr(
                "transform(parts, p -> p.segment) = sequence(1, size(parts)) "
                "AND coalesce(length(whole_block) = total_length, false)"
            ),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)).cast("int"))))
        .select("record_id", "page_id", "target", "payload_digest", "whole", F.col("whole_block").alias("block"))
    )
    schema = (
        "record_id string, page_id long, target string, payload binary, payload_bytes long, "
        "payload_digest string, valid boolean"
    )
    return map_batches(plain.unionByName(joined), payload_of, schema)


def pages_of(records: DataFrame) -> DataFrame:
    """One row per page: responses as they are, revisits with what they refer to."""
    responses = staged(
        reassemble(records).select("record_id", "page_id", "payload_bytes", "payload_digest", "valid"), "warc-responses"
    )
    held = responses.where("valid").select("record_id", "payload_bytes", "payload_digest").distinct()
    revisits = records.where("warc_type = 'revisit'").select(
        "page_id", F.col("refers_to").alias("record_id"), "refers_to_page", F.col("payload_digest").alias("claimed")
    )
    resolved = revisits.join(held, "record_id", "left").select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        F.lit("revisit").alias("record_type"),
        F.col("refers_to_page").alias("refers_to"),
        F.coalesce(F.col("claimed") == F.col("payload_digest"), F.lit(False)).alias("valid"),
    )
    plain = responses.select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"),
        "valid",
    )
    return plain.unionByName(resolved)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    path = scratch_dir(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return pages_of(read_records(pages.sparkSession, path))
