"""WARC archives: one record per page, and a global index merged from sorted runs.

Writing.  Pages with the payload of an earlier page (smallest page id first) become revisit
records that refer to it; all others are responses with their payload.  A task writes its
records one after the other and begins a new archive when ``archive_bytes`` are reached.
Archives are plain WARC 1.1 files, written by Spark's text writer whose line separator is the
record separator, so any store Spark writes to will do.

Reading.  Archives come back as whole files, bounded by ``archive_bytes`` and one record, and
are walked by Content-Length.  Each task sorts the captures of its archives by URL key, time
and page: a run.  Runs are written, cut at common key boundaries into ranges, and every range
merges its slices of all runs with a loser tree.  Ranges are by URL key, time and page, so a
URL with a third of all captures is cut too, and the result is ordered within and across
ranges.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stratalog.llm.common import bounded_batches, new_path, spread, written
from stratalog.llm.losertree import merge

CRLF, BREAK = b"\r\n", b"\r\n\r\n"
ARCHIVE_BYTES = 32 << 20
CAPTURE = ("url_key string, captured string, page_id long, url string, record_type string, "
           "payload_bytes long, payload_digest string, refers_to long, intact boolean, "
           "archive string, offset long, length long")
_COLUMNS = [c.split()[0] for c in CAPTURE.split(", ")]
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def digest(payload: bytes) -> str:
    """Bare base32 of SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@F.arrow_udf(T.StringType())
def payload_digest(html: pa.Array) -> pa.Array:
    return pa.array([digest((h or "").encode()) for h in html.to_pylist()], pa.string())


def url_key(url: str) -> str:
    """Sort-friendly key: host labels reversed, then path and query, A-Z lower-cased in the host."""
    scheme, mark, rest = url.partition("://")
    host, path = re.match(r"([^/?#]*)([^#]*)", rest if mark else scheme, re.S).groups()
    return ",".join(reversed(host.lower().split("."))) + ")" + path


def _line(value: str) -> bytes:
    """A header value on one line: controls, space and non-ASCII are percent-encoded."""
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode())
                   for c in value).encode()


def _record_id(page_id: int | None, copy: int) -> bytes:
    name = "none" if page_id is None else str(page_id)
    return f"<urn:page:{name}:{copy}>".encode()


def record(page_id: int | None, url: str | None, captured: datetime | None, payload: bytes,
           sha1: str, refers_to: int | None, copy: int = 0) -> bytes:
    """One record without its closing separator."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % (
        len(payload)) + BREAK
    block = http if refers_to is not None else http + payload
    stamp = (captured or _EPOCH).strftime("%Y-%m-%dT%H:%M:%SZ").encode()
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
            b"WARC-Record-ID: " + _record_id(page_id, copy), b"WARC-Date: " + stamp,
            b"WARC-Target-URI: " + _line(url or ""),
            b"WARC-Payload-Digest: sha1:" + sha1.encode(),
            b"Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 b"WARC-Refers-To: " + _record_id(refers_to, 0)]
    head.append(b"Content-Length: %d" % len(block))
    return CRLF.join(head) + BREAK + block


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _page_of(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+):\d+>", record_id or "")
    return int(found[1]) if found else None


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """headers, block, offset, length of every record of an archive, by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(BREAK, at)
        head = _headers(data[at:end])
        start = end + len(BREAK)
        stop = start + int(head["content-length"])
        if data[stop:stop + len(BREAK)] != BREAK:
            raise ValueError(f"a record at {at} does not end where its length says")
        yield head, data[start:stop], at, stop - at
        at = stop + len(BREAK)


def write_archives(pages: DataFrame, path: str, captured: Column | None = None,
                   archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write page_id, url, html as archives below ``path``; null html is an empty payload.

    Of equal payloads the smallest page id is the response; rows that repeat it are responses
    too.  A page without id is a revisit where a page with one has its payload.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                        (captured if captured is not None else F.lit(None)).cast("timestamp")
                        .alias("captured"), payload_digest("html").alias("sha1"))
    firsts = (pages.select(F.col("page_id").cast("long").alias("page_id"),
                           payload_digest("html").alias("sha1"))
              .groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1 AND first IS NOT NULL").select("sha1", "first"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    told = rows.join(written(firsts, "firsts", True), "sha1", "left").select(
        "page_id", "url", "captured", "html", "sha1", refers.alias("refers_to"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, size, copy = 0, 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            out, archives = [], []
            for page_id, url, at, html, sha1, refers_to in zip(
                    *(batch.column(i).to_pylist() for i in range(6))):
                value = record(page_id, url, at, (html or "").encode(), sha1, refers_to, copy)
                copy += 1
                out.append(value.decode())
                archives.append(archive)
                size += len(value) + len(BREAK)
                if size >= archive_bytes:
                    archive, size = archive + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()),
                                              pa.array(archives, pa.int32())],
                                             names=["value", "archive"])

    (told.mapInArrow(records, "value string, archive int").write.partitionBy("archive")
     .option("lineSep", "\r\n\r\n").text(path))
    return path


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives below ``path``, each task's as a sorted run, written once.

    Columns of a capture, and run and seq, its place.  ``intact`` says that a response's
    payload has the digest of its header.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, rows = TaskContext.get().partitionId(), []
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for head, block, offset, length in read_records(data.as_buffer().to_pybytes()):
                    rows.append(_capture(name, head, block, offset, length))
        rows.sort(key=_order)
        for at in range(0, len(rows), 4096):
            part = [{**r, "run": run, "seq": at + i} for i, r in enumerate(rows[at:at + 4096])]
            yield pa.RecordBatch.from_pylist(part, _SCHEMA)

    return written(files.select("path", "content").mapInArrow(
        captures, CAPTURE + ", run long, seq long"), "runs")


_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(n, _ARROW[t]) for n, t in
                     (c.split() for c in (CAPTURE + ", run long, seq long").split(", "))])
_MERGED = pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in CAPTURE.split(", "))])


def _capture(name: str, head: dict[str, str], block: bytes, offset: int, length: int) -> dict:
    http, _, payload = block.partition(BREAK)
    kind, sha1 = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
    size = int(_headers(http)["content-length"])
    whole = kind == "response"
    return {"url_key": url_key(head["warc-target-uri"]), "captured": head["warc-date"],
            "page_id": _page_of(head["warc-record-id"]), "url": head["warc-target-uri"],
            "record_type": kind, "payload_bytes": len(payload) if whole else size,
            "payload_digest": digest(payload) if whole else sha1,
            "refers_to": _page_of(head.get("warc-refers-to")),
            "intact": not whole or (digest(payload) == sha1 and len(payload) == size),
            "archive": name, "offset": offset, "length": length}


def _order(row: dict) -> tuple:
    page = row["page_id"]
    return row["url_key"], row["captured"], page is not None, page or 0, row["offset"]


def merge_index(runs: DataFrame, rows_per_range: int = 100_000) -> DataFrame:
    """Captures in the order of URL key, time and page, from written sorted runs.

    The number of ranges follows the number of captures, so a task merges a bounded share.
    """
    keys = ["url_key", "captured", F.col("page_id").asc_nulls_first()]

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        slices = [list(part) for _, part in groupby(rows, key=lambda r: r["run"])]
        ordered = merge([((_order(r), n, r["seq"]), r) for r in part]
                        for n, part in enumerate(slices))
        held = []
        for _, row in ordered:
            held.append(row)
            if len(held) == 4096:
                yield pa.RecordBatch.from_pylist(held, _MERGED)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, _MERGED)

    ranges = max(spread(runs), -(-runs.count() // rows_per_range))
    dealt = runs.repartitionByRange(ranges, *keys)
    return dealt.sortWithinPartitions("run", "seq").mapInArrow(merged, CAPTURE)


def capture_index(pages: DataFrame, captured: Column | None = None, path: str | None = None,
                  archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages as archives, read them back, merge the index; one row per page.

    Null html is an empty payload, a null url an empty one, a null page id stays null, a null
    time is the epoch; repeated rows have a record each; an empty table gives an empty index.
    Other columns of the input are not archived.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    at = write_archives(pages, path or new_path(spark, "archives"), captured, archive_bytes)
    return merge_index(read_captures(spark, at))
