"""Operator 5: WARC archives, read back by boundary-chain verification.

Writing: one record per page; a page whose payload of at least 100 bytes equals that of a page
with a smaller id becomes a revisit record that refers to it. Spark's text writer puts the
records into files: its line separator is the record terminator, CRLF CRLF. Pages are written by
size class, each with its own number of records for a file, so that files are bounded in records
and in bytes without a shuffle of the pages.

Reading: a task finds the record magic anywhere in its files and reads the header there, which
gives a candidate record and the offset of its successor. A candidate must end within the file,
with the record terminator, where the file ends too or where another magic stands. Magic inside
payloads makes candidates too. Pointer jumping from offset 0 of
each file then keeps the reachable ones, and candidates that overlapped are hashed only after that,
so each byte is hashed once at most: in each round the reached set grows by the candidates
that lie 2^r records further, and every pointer doubles its length. The joins are never
broadcast: candidates grow with the pages.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stored

LEAST_REVISIT = 100
MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
#: Records and bytes of pages of a file at most (a page of more bytes has a file of its own).
FILE_RECORDS, FILE_BYTES = 4096, 256 << 20
#: Pages up to so many bytes are one size class; each further class doubles it.
SMALL_PAGE = 1 << 16
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def with_records(pages: DataFrame) -> DataFrame:
    """``page_id, html, digest, bytes, refers_to`` of the records to write (null html: empty)."""
    pages = pages.select(F.col("page_id").cast("long"), F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    first = pages.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = stored(first.where("n > 1").drop("n"), "warc-first")
    joined = pages.join(first, "digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("first") < F.col("page_id"), F.col("first"))).drop("first")


def record_text(r: DataFrame) -> DataFrame:
    """One string column: a whole record but for its terminator."""
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda *c: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in c), F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    body = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(END), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        line(MAGIC.decode().strip()),
        line("WARC-Type: ", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID: ", uri(F.col("page_id"))),
        line("WARC-Date: 1970-01-01T00:00:00Z"),
        line("WARC-Payload-Digest: sha256:", F.col("digest")),
        F.when(revisit, line("WARC-Refers-To: ", uri(F.col("refers_to")))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")).otherwise(F.lit("")),
        line("Content-Type: application/http; msgtype=response"),
        line("Content-Length: ", F.octet_length(body).cast("string")),
    )
    return r.select(F.concat(head, F.lit("\r\n"), body).alias("value"))


def write_archives(pages: DataFrame, out: str) -> None:
    """Write the pages' records to files in folders of ``out``, one for each size class."""
    records = with_records(pages)
    size = F.octet_length("html").cast("double")
    of = lambda c: F.greatest(F.ceil(F.log2(F.greatest(c, F.lit(1.0)) / SMALL_PAGE)), F.lit(0)).cast("int")
    classes = sorted(r[0] for r in pages.where("html is not null").select(of(size).alias("k")).union(pages.sparkSession.range(1).select(F.lit(0).alias("k"))).distinct().collect())  # 16 at most: a string has under 2^31 bytes
    for k in classes:
        part = record_text(records.where(of(F.col("bytes").cast("double")) == k))
        part.write.option("lineSep", END).option("maxRecordsPerFile", max(1, min(FILE_RECORDS, FILE_BYTES // (SMALL_PAGE << k)))).text(f"{out}/size={k}")


_FIELD = re.compile(rb"([A-Za-z-]+):[ \t]*([^\r\n]*)\r\n")
_LENGTH, _ID = re.compile(rb"0*([0-9]{1,18})"), re.compile(rb"-?0*[0-9]{1,19}")


def parse_header(data: bytes, at: int) -> tuple[dict[bytes, bytes], int] | None:
    """Fields of the header that starts at ``at`` and the offset of its block; None if there is no
    header or its length doesn't fit 64 bits. It ends at the first empty line; any other line that
    is no field (such as another magic) breaks it off, so headers of a text never overlap."""
    fields, pos = {}, at + len(MAGIC)
    while m := _FIELD.match(data, pos):
        fields[m[1].lower()] = m[2]
        pos = m.end()
    whole = data.startswith(b"\r\n", pos) and _LENGTH.fullmatch(fields.get(b"content-length", b""))
    return (fields, pos + 2) if whole else None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of a file. ``next`` is where the successor starts."""
    end = END.encode()
    for b in batches:
        for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            data = data.as_py() or b""
            rows, at = [], data.find(MAGIC)
            while at >= 0:
                if got := parse_header(data, at):
                    fields, block = got
                    after = block + int(fields[b"content-length"]) + len(END)
                    if after <= len(data) and data.startswith(end, after - len(END)) and (after == len(data) or data.startswith(MAGIC, after)):
                        rows.append((at, after, block, fields))
                at = data.find(MAGIC, at + 1)
            yield from _rows(file, data, rows)


def overlapping(spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Groups of spans, sorted by start, that overlap in a chain: (first, end of the group, its reach)."""
    out: list[tuple[int, int, int]] = []
    for i, (at, after) in enumerate(spans):
        if out and at < out[-1][2]:
            out[-1] = (out[-1][0], i + 1, max(out[-1][2], after))
        else:
            out.append((i, i + 1, after))
    return out


def _page(uri: bytes) -> int | None:
    """The id at the end of a record's URI; None if there is none or it doesn't fit 64 bits."""
    tail = uri.strip(b"<>").rpartition(b":")[2]
    page = int(tail) if _ID.fullmatch(tail) else None
    return page if page is not None and -(2**63) <= page < 2**63 else None


def _rows(file: int, data: bytes, rows: list) -> Iterator[pa.RecordBatch]:
    """The file's candidates, and the bytes of places where several overlap, as rows of their own.

    A candidate that no other overlaps is hashed here. Of those that overlap at most some are real,
    so they wait until that is known: their payload is ``start`` bytes into the ``region``.
    """
    if not rows:
        return
    out: list[list] = [[] for _ in CANDIDATES]
    for lo, hi, reach in overlapping([(at, after) for at, after, *_ in rows]):
        region = rows[lo][0] if hi - lo > 1 else None
        for at, after, block, fields in rows[lo:hi]:
            kind = fields.get(b"warc-type", b"").decode("latin-1")
            split = data.find(b"\r\n\r\n", block, after)
            length = re.search(rb"content-length:[ \t]*0*([0-9]{1,18})(?![0-9])", data[block:split].lower()) if split >= 0 else None
            payload, ends = (split + 4, after - len(END)) if split >= 0 else (0, 0)
            digest, refers, start = fields.get(b"warc-payload-digest", b"").rpartition(b":")[2].decode("latin-1"), None, None
            if kind == "response":
                n = max(ends - payload, 0)
                digest, start = (hashlib.sha256(data[payload:ends]).hexdigest(), None) if region is None else (None, payload - region if n else 0)
            else:
                n, refers = int(length[1]) if length else None, _page(fields.get(b"warc-refers-to", b""))
            for col, v in zip(out, (file, at, after, _page(fields.get(b"warc-record-id", b"")), n, digest, kind, refers, region, start, None), strict=True):
                col.append(v)
        if region is not None:
            for col, v in zip(out, (file, region, reach, None, None, None, REGION, None, region, None, data[region:reach]), strict=True):
                col.append(v)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, CANDIDATES.values(), strict=True)], names=list(CANDIDATES))


#: The kind of a row that is no candidate but the bytes of several.
REGION = " region"
CANDIDATES = {
    "file": pa.int64(), "at": pa.int64(), "next": pa.int64(), "page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
    "record_type": pa.string(), "refers_to": pa.int64(), "region": pa.int64(), "start": pa.int64(), "bytes": pa.binary(),
}
SCHEMA = "file long, at long, next long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, region long, start long, bytes binary"


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, at, digest`` of the records that turned out to be real, from ``file, bytes, real``."""
    for b in batches:
        for file, data, real in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            view = memoryview(data.as_buffer())
            rows = [(r["at"], hashlib.sha256(view[r["start"] : r["start"] + r["n"]]).hexdigest()) for r in real]
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], names=["file", "at", "digest"])


def reachable(links: DataFrame) -> DataFrame:
    """``file, at`` of the candidates on the chain from offset 0, from ``file, at, next``.

    Round r: reached candidates reach those 2^r records further; jump pointers double. The
    number of rounds is the logarithm of the longest file's records. Files are bounded, so a
    chain is; all joins are on (file, offset).
    """
    key = ["file", "at"]
    nodes = links.select(*key).hint("merge")
    jump = links.select(*key, "next")
    reached = jump.where("at = 0").select(*key)
    while True:
        more = reached.join(jump.hint("merge"), key).select("file", F.col("next").alias("at"))
        more = stored(more.join(nodes, key, "left_semi"), "warc-more")
        if more.isEmpty():
            return reached
        reached = stored(reached.unionByName(more), "warc-reached")
        ahead = jump.select("file", F.col("at").alias("next"), F.col("next").alias("further"))
        jump = stored(jump.join(ahead.hint("merge"), ["file", "next"]).select(*key, F.col("further").alias("next")), "warc-jump")


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every real record."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(out).select(F.xxhash64("path").alias("file"), "content")
    every = stored(files.mapInArrow(_candidates, SCHEMA), "warc-candidates")
    found = every.where(F.col("record_type") != REGION).drop("bytes")
    real = found.join(reachable(found).hint("merge"), ["file", "at"], "left_semi")
    out = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    if every.where(F.col("record_type") == REGION).isEmpty():
        return real.select(*out)
    # Real records among overlapping candidates: a list for each region, of FILE_RECORDS at most.
    real = stored(real, "warc-real")
    waiting = real.where("region is not null and payload_digest is null").groupBy("file", "region").agg(F.collect_list(F.struct("at", "start", F.col("payload_bytes").alias("n"))).alias("real"))
    regions = every.where(F.col("record_type") == REGION).select("file", "region", "bytes")
    hashed = regions.join(waiting.hint("merge"), ["file", "region"]).select("file", "bytes", "real").mapInArrow(_hash, "file long, at long, digest string")
    whole = real.join(hashed.hint("merge"), ["file", "at"], "left").withColumn("payload_digest", F.coalesce("payload_digest", "digest"))
    return whole.select(*out)


def archive_table(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read these back.

    One row per row of ``pages (page_id, html, ...)``. Null html is an empty payload; payloads
    under 100 bytes are never revisits; rows that share page_id and payload are all responses if
    that id is the payload's smallest; a null page_id is written as ``none``, read back as null,
    and never referred to before others. Page text may hold anything, whole records or headers
    with numbers of any length too. A page over FILE_BYTES has a file of its own. Empty tables and
    extra columns are fine.
    """
    spark = pages.sparkSession
    out = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, out)
    return read_archives(spark, out)
