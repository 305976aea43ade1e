"""Repeated byte strings, found by prefix doubling on the places that can repeat.

A byte is removed if it is covered by a string of ``length`` bytes (a *window*) that also
starts elsewhere. Doubling over every byte of a corpus would sort each of them in
every round, so two exact steps come first. Every window has an anchor: of its runs of
``length / 2`` bytes, the one of least hash, the leftmost of equals. Equal windows have equal anchors at
the same place, so

* windows whose anchor occurs once cannot repeat, and
* neighbouring windows with one anchor form a block, and blocks of equal content
  repeat as a whole; one of them stands for all.

What is left are blocks with a common anchor and unequal content. Their windows go
through the doubling: each has the names of its parts of ``length / 2 ** rounds`` bytes; Spark
sorts them by the pair of names of the first two parts, which is the rank of twice that length,
drops those that are alone with it and goes on with doubled offset, until the
whole window is named. Names are 64-bit hashes of content, so equal content has an equal name
wherever it stands, and the name at an offset is at hand in the row.

Texts are known by two 64-bit hashes; copies share one entry, and a task passes on a
text at most twice, which is enough to know that it repeats.

Defined cases: null text is empty; texts shorter than a window keep all; matches never cross
texts; a string may repeat inside its own text, overlapping itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credtrail.llm.common import mixed, written

#: Bytes of texts that one numpy pass takes, unless a single one is longer.
PASS = 512 << 10
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the map of texts to read again; fixed, whatever the data.
MAP_BITS = 1 << 26
SEEN = 100_000
KEY = ["t1", "t2"]


def named(raw: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit name for every run of ``length`` bytes."""
    runs = len(raw) - length + 1
    if runs <= 0:
        return np.empty(0, np.uint64)
    part = mixed(raw.astype(np.uint64) + np.uint64(1))
    total, done, width, scale = np.zeros(runs, np.uint64), 0, 1, np.array([STEP])
    while width <= length:
        if length & width:
            total = total * scale + part[done : done + runs]
            done += width
        if width * 2 <= length:
            part = part[: len(part) - width] * scale + part[width:]
        scale = scale * scale
        width *= 2
    return mixed(total)


def least_places(names: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of every ``width`` names in a row, the leftmost of equals."""
    places = np.arange(len(names), dtype=np.int32)

    def less(a, b):
        return np.where(names[b] < names[a], b, a)

    done = 1
    while done * 2 <= width:
        places = less(places[:-done], places[done:])
        done *= 2
    rest = width - done
    return less(places[: len(places) - rest], places[rest:]) if rest else places


def blocks_of(texts: list[bytes], length: int) -> Iterator[tuple]:
    """``text, start, windows, anchor, content`` of the blocks of each text, in arrays."""
    gram = length // 2
    joined = b"".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    names = named(raw, gram)
    if len(raw) < length:
        return
    anchor = least_places(names, length - gram + 1)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= ends[owner]
    place = np.flatnonzero(valid)
    if not len(place):
        return
    a, o = anchor[place], owner[place]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (o[1:] != o[:-1])))
    count = np.diff(np.append(first, len(place)))
    begin, text = place[first], o[first]
    content = [
        xxhash.xxh3_64_intdigest(joined[s : s + n + length - 1])
        for s, n in zip(begin.tolist(), count.tolist(), strict=True)
    ]
    yield text, begin - starts[text], count, names[a[first]], np.array(content, np.uint64)


def found_blocks(docs: DataFrame, length: int) -> DataFrame:
    """One row for each block of ``docs (t1, t2, text)``, copies at most twice a task."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: dict[tuple, int] = {}

        def flushed(keys, texts):
            for text, start, count, anchor, content in blocks_of(texts, length):
                t1, t2 = (np.array(k, np.int64)[text] for k in zip(*keys, strict=True))
                columns = [t1, t2, start.astype(np.int32), count.astype(np.int32), anchor.view(np.int64), content.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["t1", "t2", "start", "n", "anchor", "content"])

        for part in parts:
            keys, texts, size = [], [], 0
            for t1, t2, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if (times := passed.get((t1, t2), 0)) == 2:
                    continue
                if times or len(passed) < SEEN:
                    passed[t1, t2] = times + 1
                raw = text.encode()
                if size and size + len(raw) > PASS:
                    yield from flushed(keys, texts)
                    keys, texts, size = [], [], 0
                keys.append((t1, t2))
                texts.append(raw)
                size += len(raw)
            if texts:
                yield from flushed(keys, texts)

    kinds = "t1 bigint, t2 bigint, start int, n int, anchor bigint, content bigint"
    return docs.mapInArrow(run, kinds)


def judged_blocks(found: DataFrame) -> DataFrame:
    """Blocks that repeat as a whole (``whole``) and those to look into (``fine``: one of
    each content whose anchor also has other content, if any content there is alone)."""
    place = F.struct("t1", "t2", "start")
    contents = found.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.min(place).alias("first"))
    anchors = contents.groupBy(F.col("anchor").alias("of")).agg(
        (F.min("content") != F.max("content")).alias("others"),
        F.max((F.col("times") == 1).cast("int")).alias("alone"),
    )
    # A hot anchor is few rows in the sums, and adaptive execution splits it in the joins.
    known = contents.join(anchors, F.col("anchor") == F.col("of"))
    open_ = F.col("others") & (F.col("alone") == 1)
    known = known.where((F.col("times") > 1) | open_).select(
        F.col("anchor").alias("_a"), F.col("content").alias("_c"), "times", "first", open_.alias("open")
    )
    rows = found.join(known, (F.col("anchor") == F.col("_a")) & (F.col("content") == F.col("_c")))
    fine = F.col("open") & (place == F.col("first"))
    rows = rows.select(*KEY, "start", "n", (F.col("times") > 1).alias("whole"), fine.alias("fine"))
    return rows.where("whole or fine").distinct()


def text_map(rows: DataFrame) -> np.ndarray:
    """Bits of the texts in ``rows (t1)``; others may share a bit, which costs time only."""
    bit = F.pmod(F.col("t1"), F.lit(MAP_BITS))
    words = rows.groupBy((bit / 64).cast("int").alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(pmod(t1, 64) AS int)))").alias("bits")
    )
    found = words.toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def in_map(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """``docs (t1, …)`` with a flag ``listed`` from the map."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for part in parts:
            bit = part.column("t1").to_numpy() % MAP_BITS
            listed = (bits[bit // 64] >> (bit % 64) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(listed)], [*part.schema.names, "listed"])

    return docs.mapInArrow(run, docs.withColumn("listed", F.lit(True)).schema)


def doubled(docs: DataFrame, fine: DataFrame, length: int, rounds: int) -> DataFrame:
    """Windows of the fine blocks (that are alone) whose whole content has another place."""
    step = length // 2**rounds
    per_text = fine.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n", "whole")).alias("blocks"))
    texts = docs.dropDuplicates(KEY).join(per_text, KEY)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                raw = np.frombuffer(r["text"].encode(), np.uint8)
                for b in r["blocks"]:
                    names = named(raw[b["start"] : b["start"] + b["n"] + length - 1], step)
                    n = b["n"]
                    parts_of = [names[i * step : i * step + n].view(np.int64) for i in range(2**rounds)]
                    columns = [np.full(n, r["t1"]), np.full(n, r["t2"]), np.arange(b["start"], b["start"] + n, dtype=np.int32)]
                    columns = [pa.array(c) for c in (*columns, np.full(n, b["whole"]), *parts_of)]
                    yield pa.RecordBatch.from_arrays(columns, [*KEY, "place", "known", *(f"r{i}" for i in range(2**rounds))])

    kinds = "t1 bigint, t2 bigint, place int, known boolean"
    kinds += "".join(f", r{i} bigint" for i in range(2**rounds))
    rows = texts.select(*KEY, "text", "blocks").mapInArrow(run, kinds)
    names = [f"r{i}" for i in range(2**rounds)]
    while len(names) > 1:
        pair = Window.partitionBy(names[0], names[1])
        rows = rows.withColumn("times", F.count("*").over(pair)).where("times > 1").drop("times")
        longer = [F.xxhash64(a, b).alias(a) for a, b in zip(names[::2], names[1::2])]
        names = names[::2]
        rows = rows.select(*KEY, "place", "known", *longer)
    return rows.where("not known").select(*KEY, "place")


def removed(docs: DataFrame, length: int = 400, rounds: int = 1) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs (doc_id, text)``.
    ``length`` must be a multiple of ``2 ** rounds``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint"), text.alias("text"),
        F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(length), text).alias("t2"),
    )
    long_enough = rows.where(F.octet_length("text") >= length).select(*KEY, "text")
    found = written(found_blocks(long_enough, length), "found")
    blocks = written(judged_blocks(found), "blocks")
    fine = blocks.where("fine")
    again = in_map(long_enough, text_map(fine)).where("listed").drop("listed")
    windows = doubled(again, fine, length, rounds)
    spans = blocks.where("whole").select(*KEY, "start", "n")
    places = windows.groupBy(*KEY).agg(F.sort_array(F.collect_set("place")).alias("places"))
    wholes = spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    # Bounded by the length of a text.
    cuts = written(wholes.join(places, KEY, "full_outer"), "cuts")
    listed = in_map(rows, text_map(cuts))
    joined = listed.where("listed").join(cuts, KEY, "left").select("doc_id", "text", "spans", "places")
    kinds = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = [_kept(r, length) for r in part.to_pylist()]
            if out:
                n, gone, runs, digest = zip(*out, strict=True)
                columns = [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(digest)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in kinds.split(", ")])

    zero = F.lit(0).cast("bigint")
    untouched = listed.where("not listed").select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), zero.alias("n_removed"),
        zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"),
    )
    return joined.mapInArrow(cut, kinds).unionByName(untouched)


def _kept(row: dict, length: int) -> tuple[int, int, int, str]:
    raw = row["text"].encode()
    edge = np.zeros(len(raw) + 1, np.int64)
    for s in row["spans"] or ():
        edge[s["start"]] += 1
        edge[s["start"] + s["n"] - 1 + length] -= 1
    places = np.array(row["places"] or [], np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()
