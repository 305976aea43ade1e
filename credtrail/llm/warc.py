"""WARC archives: records in segments, written and put together again.

A record is written as an HTTP response in chunked transfer framing. If its block is
longer than ``segment_bytes`` it continues in records of type ``continuation``, which
name the first one (``WARC-Segment-Origin-ID``) and count up; the last has the total
length. Of equal payloads only one is stored, the others are ``revisit`` records.

The archives are plain text output of Spark: the ``text`` format with the end of a record
as line separator. Reading splits files at the version line, so archives of any size
are read in parallel. The writer cuts chunks and segments so that no version line arises inside
a block, neither from the payload alone nor from it and the framing behind it;
archives of other writers in which one does are refused, not misread.

Defined cases: a null payload is empty; a null URL is left out; control characters in
URLs are percent-encoded; repeated rows are records of their own; rows with a null id
never are the response that others refer to, unless all have one; a missing
segment, a wrong number or a wrong length is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credtrail.llm.common import batches, written
from credtrail.plans.sizing import broadcast_if_small

VERSION = b"WARC/1.1\r\n"
BARE_VERSION = VERSION.rstrip()
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
CHUNKED = b"Transfer-Encoding: chunked\r\n"

RECORDS = (
    "record_id string, record_type string, page_id bigint, url string, refers_to bigint, "
    "digest string, origin_id string, segment int, total_length bigint, block binary"
)
PAGES = (
    "record_id string, record_type string, page_id bigint, url string, refers_to bigint, "
    "digest string, payload_bytes bigint, payload binary"
)


def bare_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def deduplicated(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to``: the page that holds the same payload, for
    all but the largest id of each group of equal payloads of ``min_bytes`` or more."""
    rows = pages.select(
        F.col("page_id").cast("bigint"), F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("same", F.sha2("payload", 256))
    groups = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy("same")
        .agg(F.max("page_id").alias("best"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("same").alias("group"), "best")
    )
    # Few payloads are there twice, mostly: pages then stay where they are. Else a hot payload
    # is one row on the right, and adaptive execution splits the left side.
    groups = broadcast_if_small(written(groups, "copies"))
    joined = rows.join(groups, F.col("same") == F.col("group"), "left")
    other = ~F.col("page_id").eqNullSafe(F.col("best"))
    return joined.select("page_id", "url", "payload", F.when(other, F.col("best")).alias("refers_to"))


def write_archive(
    pages: DataFrame,
    path: str,
    segment_bytes: int = 16_384,
    chunk_bytes: int = 4_096,
    date: str = "2030-01-01T00:00:00Z",
) -> None:
    """Write ``page_id, url, payload, refers_to`` as WARC files below ``path``; ``date`` is
    the time of capture that every record carries."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for p in parts for x in p.to_pylist() for r in _records(x, segment_bytes, chunk_bytes, date))
        yield from batches(((r,) for r in rows), pa.schema([("record", pa.binary())]), lambda r: len(r[0]))

    records = pages.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    records.write.option("lineSep", RECORD_END).text(path)


def _records(page: dict, segment_bytes: int, chunk_bytes: int, date: str) -> Iterator[bytes]:
    payload, record_id = page["payload"], f"<urn:uuid:{uuid.uuid4()}>"
    revisit = page["refers_to"] is not None
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id)]
    fields += [("WARC-Date", date), ("Content-Type", "application/http; msgtype=response")]
    fields.append(("WARC-Payload-Digest", f"sha1:{bare_sha1(payload)}"))
    if page["page_id"] is not None:
        fields.append(("WARC-Page-ID", str(page["page_id"])))
    if page["url"] is not None:
        fields.append(("WARC-Target-URI", _clean(page["url"])))
    if revisit:
        fields.append(("WARC-Profile", SAME_PAYLOAD))
        fields.append(("WARC-Refers-To-Page", str(page["refers_to"])))
        yield _record(fields, HTTP_HEAD + b"\r\n")
        return
    block = HTTP_HEAD + CHUNKED + b"\r\n" + chunked(payload, chunk_bytes)
    edges = _clear_of_version(block, range(0, len(block), segment_bytes))
    pieces = [block[a:b] for a, b in zip(edges, edges[1:])]
    if len(pieces) > 1:
        fields.append(("WARC-Segment-Number", "1"))
    yield _record(fields, pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date)]
        fields += [("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", str(n))]
        if n == len(pieces):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(fields, piece)


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20%]", lambda m: f"%{ord(m[0]):02X}", url)


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return VERSION + head.encode() + b"\r\n" + block


def _clear_of_version(data: bytes, cuts: Iterable[int]) -> list[int]:
    """Where to cut: at ``cuts`` and the end, and once more inside each version that would
    stand right before a cut, as line ends follow there."""
    edges = {*cuts, len(data)}
    edges |= {c - 4 for c in edges if data[max(0, c - len(BARE_VERSION)) : c] == BARE_VERSION}
    return sorted(edges)


def chunked(payload: bytes, chunk_bytes: int) -> bytes:
    """Chunked transfer framing; a chunk also ends inside each version line."""
    cuts = {m.start() + 4 for m in re.finditer(re.escape(VERSION), payload)}
    edges = _clear_of_version(payload, cuts | {*range(0, len(payload), chunk_bytes)})
    chunks = [payload[a:b] for a, b in zip(edges, edges[1:])]
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in chunks) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        parts.append(body[at : at + size])
        if len(parts[-1]) < size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at += size + 2


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record below ``path``, as it stands in the files."""
    lines = spark.read.option("lineSep", VERSION.decode()).text(path)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (_parsed(x) for p in parts for x in p.column(0).to_pylist() if x)
        yield from batches(rows, _arrow(RECORDS), lambda r: 400 + len(r[-1]))

    # As bytes: a segment may end inside a character.
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, RECORDS)


def _parsed(record: bytes) -> tuple:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
    length = int(fields["Content-Length"])
    if len(block) - len(RECORD_END) != length:
        raise ValueError(f"{fields['WARC-Record-ID']}: {len(block)} bytes do not fit its length {length}")
    get = lambda name, kind=str: kind(fields[name]) if name in fields else None
    return (
        get("WARC-Record-ID"), get("WARC-Type"), get("WARC-Page-ID", int), get("WARC-Target-URI"),
        get("WARC-Refers-To-Page", int), get("WARC-Payload-Digest", lambda x: x.removeprefix("sha1:")),
        get("WARC-Segment-Origin-ID"), get("WARC-Segment-Number", int),
        get("WARC-Segment-Total-Length", int), block[:length],
    )


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records with their decoded payload, null for revisits. Only records in
    segments are shuffled; a group is one record."""
    whole = records.where(F.col("segment").isNull())
    first = records.where("segment = 1").select("*", F.col("record_id").alias("group"))
    more = records.where("segment > 1").select("*", F.col("origin_id").alias("group"))
    heads = [c for c in records.columns if c not in ("segment", "total_length", "block", "origin_id")]
    pieces = F.array_sort(F.collect_list(F.struct("segment", "block")))
    groups = (
        first.unionByName(more)
        .groupBy("group")
        .agg(
            *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in heads),
            F.max("total_length").alias("total_length"),
            pieces.alias("pieces"),
        )
    )
    size = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda n, p: n + F.octet_length(p["block"]))
    gapless = _all_true(F.expr("pieces.segment = sequence(1, size(pieces))"), "gap in the segments")
    length = _all_true(size == F.col("total_length"), "wrong total length")
    groups = groups.where(gapless).where(length).select(*heads, F.col("pieces.block").alias("blocks"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (_payload(x) for p in parts for x in p.to_pylist())
        yield from batches(rows, _arrow(PAGES), lambda r: 300 + len(r[-1] or b""))

    together = whole.select(*heads, F.array("block").alias("blocks")).unionByName(groups)
    return together.mapInArrow(run, PAGES)


def _all_true(test: Column, message: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit(f"{message}: "), F.coalesce("record_id", F.lit("no first segment"))))
    )


def _payload(record: dict) -> tuple:
    head, _, body = b"".join(record["blocks"]).partition(b"\r\n\r\n")
    if record["record_type"] == "revisit":
        payload = None
    else:
        payload = unchunked(body) if CHUNKED.strip() in head else body
        if record["digest"] and bare_sha1(payload) != record["digest"]:
            raise ValueError(f"{record['record_id']}: the payload does not fit its digest")
    size = None if payload is None else len(payload)
    return (*(record[c] for c in _arrow(PAGES).names[:-2]), size, payload)


def payload_facts(read: DataFrame) -> DataFrame:
    """Length and digest of the full payload for every record; a revisit has the length of
    the response with the same digest."""
    facts = read.select("page_id", "record_type", "refers_to", "digest", F.col("payload_bytes").alias("bytes"))
    lengths = (
        facts.where("record_type = 'response'")
        .groupBy(F.col("digest").alias("of"))
        .agg(F.max("bytes").alias("full"))
    )
    revisits = facts.where("record_type = 'revisit'").drop("bytes")
    revisits = revisits.join(lengths, F.col("digest") == F.col("of"), "left").withColumnRenamed("full", "bytes")
    both = facts.where("record_type = 'response'").unionByName(revisits.select(*facts.columns))
    return both.select(
        "page_id", F.col("bytes").cast("bigint").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), "record_type", "refers_to",
    )


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])
