"""WARC archives with segmented records: write, read, reassemble, decode.

A record larger than ``segment_bytes`` becomes a first segment and continuation records. Reading
groups continuations by the identifier of their origin, orders them by segment number, checks the
total length and then decodes the chunked transfer framing of the HTTP message inside. Archives are
written with Spark's text writer (the line separator is the end mark of a WARC record, so the files
are plain gzipped WARC) and read with its binary file reader, so any storage that Spark reaches
will do. ``RECORDS_PER_FILE`` segments of bounded size bound the size of a file.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.llm.encoding import slices, tidy
from askgrid.plans.shared import written

VERSION = b"WARC/1.1"
END = "\r\n\r\n"
SEGMENT_BYTES = 64 << 10
TRANSFER_CHUNK = 8 << 10
RECORDS_PER_FILE = 2_000
LEAST_SHARED_BYTES = 1_000
RECORD = ("record_id string, origin_id string, segment bigint, total_length bigint, "
          "warc_type string, page_id bigint, url string, payload_bytes bigint, "
          "payload_digest string, refers_to bigint, block binary")
_RECORD_ARROW = pa.schema([
    ("record_id", pa.string()), ("origin_id", pa.string()), ("segment", pa.int64()),
    ("total_length", pa.int64()), ("warc_type", pa.string()), ("page_id", pa.int64()),
    ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("refers_to", pa.int64()), ("block", pa.binary())])


#: The type of what is no whole record.
DAMAGED = "damaged"

# --- framing ------------------------------------------------------------------------------------

_SIZE = re.compile(rb"[0-9A-Fa-f]+")


def chunk_body(body: bytes, size: int = TRANSFER_CHUNK) -> bytes:
    """``body`` in chunked transfer framing."""
    out = []
    for lo in range(0, len(body), size):
        part = body[lo:lo + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def decode_chunked(framed: bytes) -> bytes | None:
    """The body inside chunked framing; None if the framing is damaged."""
    out, at = [], 0
    while True:
        line = framed.find(b"\r\n", at)
        if line < 0:
            return None
        digits = framed[at:line].split(b";")[0].strip()
        if not _SIZE.fullmatch(digits):  # no sign, so that reading always moves on
            return None
        size, at = int(digits, 16), line + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size:at + size + 2] != b"\r\n":
            return None
        out.append(framed[at:at + size])
        at += size + 2


def http_payload(message: bytes) -> bytes | None:
    """The body of an HTTP response, transfer framing removed."""
    head, found, body = message.partition(b"\r\n\r\n")
    if not found:
        return None
    if b"transfer-encoding: chunked" in head.lower():
        return decode_chunked(body)
    return body


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in headers if v is not None]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode("utf-8")
    return b"".join([VERSION, b"\r\n", head, b"\r\n\r\n", block])


def _header_text(value: str | None) -> str | None:
    """A header value cannot hold a line break."""
    return None if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


# --- writing ------------------------------------------------------------------------------------

def _records(segment_bytes: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, size in slices(batch.column(2)):
                out: list[bytes] = []
                for page, url, body, digest, keeper in zip(
                        *(batch.column(i).slice(first, size).to_pylist() for i in range(5))):
                    number += 1
                    name = f"<urn:record:{part}-{number}>"
                    revisit = keeper is not None and keeper != page
                    common = [("WARC-Target-URI", _header_text(url)), ("Page-Id", page),
                              ("WARC-Payload-Digest", f"sha1:{digest}"),
                              ("Payload-Length", len(body))]
                    if revisit:
                        out.append(_record([
                            ("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common,
                            ("WARC-Profile",
                             "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                            ("WARC-Refers-To", f"<urn:page:{keeper}>")], b""))
                        continue
                    message = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                               b"Transfer-Encoding: chunked\r\n\r\n" + chunk_body(body))
                    if len(message) <= segment_bytes:
                        out.append(_record([
                            ("WARC-Type", "response"), ("WARC-Record-ID", name), *common],
                            message))
                        continue
                    for i, lo in enumerate(range(0, len(message), segment_bytes), 1):
                        last = lo + segment_bytes >= len(message)
                        out.append(_record([
                            ("WARC-Type", "response" if i == 1 else "continuation"),
                            ("WARC-Record-ID", name if i == 1 else f"{name[:-1]}/{i}>"),
                            ("WARC-Segment-Number", i),
                            ("WARC-Segment-Origin-ID", name if i > 1 else None),
                            ("WARC-Segment-Total-Length", len(message) if last else None),
                            *(common if i == 1 else ())],
                            message[lo:lo + segment_bytes]))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return run


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    segment_bytes: int = SEGMENT_BYTES,
    least_shared: int = LEAST_SHARED_BYTES,
) -> None:
    """Write one record per row; payload is the text in UTF-8.

    Among equal payloads of at least ``least_shared`` bytes the row with the largest id is written
    as a response and the others as revisits of it; rows repeated with that id are all responses.
    Null html counts as empty; a null id never wins and its row is a response only if no other
    row of the group has an id. Other columns are not read.
    """
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"),
        body.alias("body"), F.sha1(body).alias("digest"))
    # One row per payload that occurs more than once. It is a written table, so that its true size
    # decides between sending it to all tasks and a join that splits a hot digest.
    shared = written(
        rows.where(F.octet_length("body") >= least_shared)
        .groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("digest", "keeper"))
    records = rows.join(shared, "digest", "left").select(
        "page_id", "url", "body", "digest", "keeper").mapInArrow(
        _records(segment_bytes), "value binary")
    (
        records.select(F.col("value").cast("string").alias("value"))
        .write.mode("overwrite")
        .option("lineSep", END).option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


# --- reading ------------------------------------------------------------------------------------

_FIELDS = ("record_id", "origin_id", "segment", "total_length", "warc_type", "page_id", "url",
           "payload_bytes", "payload_digest", "refers_to")
_START = b"\r\n\r\nWARC/"


def _record_at(archive: bytes, at: int) -> tuple[dict, int] | None:
    """The record that starts at a byte and the byte behind it; None if it is damaged."""
    stop = archive.find(b"\r\n\r\n", at)
    if stop < 0 or not archive.startswith(b"WARC/", at):
        return None
    head = {}
    for line in archive[at:stop].split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        head[key.decode("utf-8", "replace").strip().lower()] = value.decode(
            "utf-8", "replace").strip()

    def number(key: str) -> int | None:
        return int(head[key]) if key in head else None

    refers = head.get("warc-refers-to")
    try:
        size = int(head["content-length"])
        record = {
            "record_id": head.get("warc-record-id"),
            "origin_id": head.get("warc-segment-origin-id"),
            "segment": number("warc-segment-number"),
            "total_length": number("warc-segment-total-length"),
            "warc_type": head.get("warc-type"),
            "page_id": number("page-id"),
            "url": head.get("warc-target-uri"),
            "payload_bytes": number("payload-length"),
            "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "refers_to": int(refers.rpartition(":")[2].rstrip(">")) if refers else None,
        }
    except (KeyError, ValueError):
        return None
    lo, hi = stop + 4, stop + 4 + size
    if size < 0 or hi > len(archive):
        return None
    return {**record, "block": archive[lo:hi]}, hi


def parse_records(archive: bytes) -> Iterator[dict]:
    """The records of one unpacked archive, by their declared lengths.

    Bytes that are no whole record (a head without length or with odd numbers, a record cut off,
    anything between records) are one record of type ``damaged`` up to the next record start.
    """
    at, end = 0, len(archive)
    while at < end:
        found = _record_at(archive, at)
        if found is None:
            following = archive.find(_START, at)
            stop = end if following < 0 else following + 4
            yield {**dict.fromkeys(_FIELDS), "warc_type": DAMAGED, "block": archive[at:stop]}
            at = stop
            continue
        record, at = found
        yield record
        while archive[at:at + 2] == b"\r\n":
            at += 2


@tidy
def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            packed, unpacked = content.as_py(), []
            while packed:  # an archive may hold one gzip member or one for each record
                member = zlib.decompressobj(31)
                try:
                    unpacked.append(member.decompress(packed))
                except zlib.error:  # what cannot be unpacked is a damaged record as it stands
                    unpacked.append(packed)
                    break
                packed = member.unused_data
            held, size = [], 0
            for record in parse_records(b"".join(unpacked)):
                held.append(record)
                size += len(record["block"])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(held, _RECORD_ARROW)
                    held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, _RECORD_ARROW)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives, segments still apart."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(_parse, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: segments of one origin in order, ``blocks`` as an array, ``complete``.

    A record is complete if its segments are 1, 2, ... without gap or repeat, only the last states
    a total length, and that equals the sum of the lengths. Only segmented records are shuffled;
    a group is one record.
    """
    facts = ["warc_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to"]
    single = records.where("segment is null").select(
        "record_id", *facts, F.array("block").alias("blocks"),
        (~F.col("warc_type").eqNullSafe(DAMAGED)).alias("complete"))
    grouped = (
        records.where("segment is not null")
        .groupBy(F.coalesce("origin_id", "record_id").alias("record_id"))
        .agg(F.min_by(F.struct(*facts), "segment").alias("f"),
             F.array_sort(F.collect_list(F.struct("segment", "total_length", "block"))).alias("s"))
    )
    joined = grouped.select(
        "record_id", *[F.col(f"f.{c}").alias(c) for c in facts],
        F.col("s.block").alias("blocks"),
        (
            (F.col("s.segment") == F.sequence(F.lit(1).cast("bigint"),
                                              F.size("s").cast("bigint")))
            & (F.coalesce(F.element_at("s", -1)["total_length"], F.lit(-1).cast("bigint"))
               == F.aggregate("s", F.lit(0).cast("bigint"),
                              lambda a, x: a + F.octet_length(x["block"])))
        ).alias("complete"))
    return single.unionByName(joined)


def _decode(keep_payload: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                valid, payload = r["complete"], None
                size, digest = r["payload_bytes"], r["payload_digest"]
                if r["warc_type"] != "revisit":
                    payload = http_payload(b"".join(r["blocks"])) if valid else None
                    valid = payload is not None and hashlib.sha1(payload).hexdigest() == digest
                    size = None if payload is None else len(payload)
                    digest = None if payload is None else hashlib.sha1(payload).hexdigest()
                rows.append({
                    "page_id": r["page_id"], "url": r["url"], "payload_bytes": size,
                    "payload_digest": digest, "record_type": r["warc_type"],
                    "refers_to": r["refers_to"], "valid": valid,
                    **({"payload": payload} if keep_payload else {})})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()), ("record_type", pa.string()),
                ("refers_to", pa.int64()), ("valid", pa.bool_()),
                *([("payload", pa.binary())] if keep_payload else ())]))

    return run


def read_warc(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """One row per record: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    valid`` (and ``payload``).

    Size and digest of a response are measured on its decoded payload, and ``valid`` says whether
    it is whole and agrees with the digest in its head; a revisit has those of its head. A record
    that is not whole keeps its row, with null size and digest and ``valid`` false; so does a damaged
    stretch of an archive, as a record of type ``damaged``.
    """
    schema = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, "
              "record_type string, refers_to bigint, valid boolean"
              + (", payload binary" if keep_payload else ""))
    return reassemble(read_records(spark, path)).mapInArrow(_decode(keep_payload), schema)
