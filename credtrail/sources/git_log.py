"""Commit logs with patches (``log -p`` text) as a line table.

The text is read line by line, so a commit or a file of any size spreads over
many tasks. Each line belongs to the last commit header and the last file header
before it. Within a split of the input these are carried along as Arrow batches
pass by, and the result is written once, with one more row per split: the headers that
it ends with. Lines before the first header of a split take theirs from these rows. Both
come from the same read, so they agree on the splits whatever the settings of a later job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credtrail.functions.dates import instant
from credtrail.functions.files import is_scanned_file
from credtrail.functions.keywords import has_any_keyword, may_match
from credtrail.plans.sizing import BROADCAST_BYTES, byte_size
from credtrail.plans.storage import stored
from credtrail.rules import Rules

# Fixed value: how a commit header starts, in full and in stream mode.
COMMIT_MARKS = ("COMMIT_START|", "COMMIT|")
FILE_MARK = "diff --git"

CARRIED = (
    "path STRING, block BIGINT, at BIGINT, header STRING, file_line STRING, "
    "kind STRING, line STRING"
)
SCHEMA = pa.schema(
    [
        ("path", pa.string()),
        ("block", pa.int64()),
        ("at", pa.int64()),
        ("header", pa.string()),
        ("file_line", pa.string()),
        ("kind", pa.string()),
        ("line", pa.string()),
    ]
)


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give each line the last headers of its block, and its place in it.

    A null means that no header came yet in the block; a commit without a file
    header so far has the file line ``""``.
    """
    block, header, file_line, place = None, None, None, 0
    for batch in batches:
        for name, rows in _runs(batch):
            if name != block:
                if block is not None:
                    yield _end(block, place, header, file_line)
                block, header, file_line, place = name, None, None, 0
            kind, line = rows.column("kind"), rows.column("line")
            commit_at = _last_place(kind, "commit")
            file_at = _last_place(kind, "file")
            headers = _filled(_picked(line, commit_at), header)
            # A new commit ends the file before it.
            ended = pa.array((commit_at >= 0) & (commit_at > file_at))
            files = _filled(pc.if_else(ended, "", _picked(line, file_at)), file_line)
            at = pa.array(np.arange(place, place + rows.num_rows, dtype="int64"))
            place += rows.num_rows
            header, file_line = headers[-1].as_py(), files[-1].as_py()
            yield pa.RecordBatch.from_arrays(
                [rows.column("path"), rows.column("block"), at, headers, files, kind, line],
                schema=SCHEMA,
            )
    if block is not None:
        yield _end(block, place, header, file_line)


def _end(block: tuple, place: int, header: str | None, file_line: str | None) -> pa.RecordBatch:
    """What a block leaves to the next one."""
    path, start = block
    row = [path, start, place, header, file_line, "end", None]
    return pa.RecordBatch.from_arrays(
        [pa.array([x], f.type) for x, f in zip(row, SCHEMA)], schema=SCHEMA
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The stretches of a batch that come from one block."""
    path, start = batch.column("path"), batch.column("block")
    codes = path.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    starts = start.to_numpy(zero_copy_only=False)
    turns = np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1
    edges = [0, *turns.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield (path[a].as_py(), start[a].as_py()), batch.slice(a, b - a)


def _last_place(kind: pa.Array, name: str) -> np.ndarray:
    """For each row the place of the last row of that kind, -1 before the first."""
    hit = pc.fill_null(pc.equal(kind, name), False).to_numpy(zero_copy_only=False)
    return np.maximum.accumulate(np.where(hit, np.arange(len(hit)), -1))


def _picked(line: pa.Array, places: np.ndarray) -> pa.Array:
    return line.take(pa.array(places, mask=places < 0))


def _filled(texts: pa.Array, before: str | None) -> pa.Array:
    return texts if before is None else pc.fill_null(texts, before)


def read_git_log(
    spark: SparkSession,
    path: str,
    rules: Rules | None = None,
    marks: tuple[str, ...] = COMMIT_MARKS,
) -> DataFrame:
    """``(seq, commit, author, date_raw, date, file, sign, line)`` of log texts.

    ``seq`` is the order in the log. With ``rules`` only lines that can become
    findings of scanned files are kept, and most text never leaves the scan.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    text = F.regexp_replace("value", r"\r\z", "")
    is_commit = F.lit(False)
    for mark in marks:
        # Fewer than four fields are no header; the commit before goes on.
        full = F.size(F.split(F.col("line"), r"\|", 4)) >= 4
        is_commit = is_commit | (F.col("line").startswith(mark) & full)
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.col("line").startswith(mark)
    is_file = F.col("line").startswith(FILE_MARK) & F.col("line").contains(" b/")
    is_change = (F.col("line").startswith("+") & ~F.col("line").startswith("+++")) | (
        F.col("line").startswith("-") & ~F.col("line").startswith("---")
    )
    kind = F.when(is_commit, "commit").when(marked, None).when(is_file, "file")
    lines = raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        text.alias("line"),
    )
    lines = lines.select("*", kind.when(is_change, "change").alias("kind"))
    lines = lines.where(F.col("kind").isNotNull())
    if rules is not None:
        wanted = may_match(F.col("line"), rules) & has_any_keyword(F.col("line"), rules)
        lines = lines.where((F.col("kind") != "change") | wanted)

    carried = lines.mapInArrow(_carry, CARRIED).where(F.col("kind").isin("change", "end"))
    carried = stored(carried, "log-lines")
    # One row per split.
    before = Window.partitionBy("path").orderBy("block")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    incoming = stored(
        carried.where(F.col("kind") == "end").select(
            "path",
            "block",
            F.last("header", True).over(before).alias("_in_header"),
            F.last("file_line", True).over(before).alias("_in_file"),
            F.lit(True).alias("_known"),
        ),
        "log-splits",
    )
    changes = carried.where(F.col("kind") == "change").drop("kind")
    placed = _with_incoming(changes, incoming)
    placed = placed.where(F.col("header").isNotNull() & (F.col("file_line") != ""))

    fields = F.split(F.col("header"), r"\|", 4)
    start = F.locate(" b/", F.col("file_line")) + 3
    rows = placed.select(
        "path",
        # Every line takes a byte at least, so places of one block stay below
        # the start of the next.
        (F.col("block") + F.col("at")).alias("seq"),
        fields[1].alias("commit"),
        fields[2].alias("author"),
        fields[3].alias("date_raw"),
        F.substr("file_line", start).alias("file"),
        F.substring("line", 1, 1).alias("sign"),
        F.substr("line", F.lit(2)).alias("line"),
    )
    rows = rows.withColumn("date", instant(F.col("date_raw")))
    if rules is not None:
        rows = rows.where(is_scanned_file(F.col("file"), rules))
    return rows


def _with_incoming(changes: DataFrame, incoming: DataFrame) -> DataFrame:
    """Fill the headers that a block takes from the blocks before. A block without its row
    in ``incoming`` is an error: its lines would vanish."""

    def filled(rows: DataFrame, side: DataFrame) -> DataFrame:
        lost = F.raise_error(F.concat(F.lit("no headers for a block of "), "path"))
        return (
            rows.join(side, ["path", "block"], "left")
            .withColumn("file_line", F.coalesce("file_line", "_in_file"))
            .withColumn("header", F.when(F.col("_known"), F.coalesce("header", "_in_header")).otherwise(lost.cast("string")))
            .drop("_in_header", "_in_file", "_known")
        )

    if byte_size(incoming) <= BROADCAST_BYTES:
        return filled(changes, F.broadcast(incoming))
    # Too many blocks: shuffle only the lines that need it.
    known = F.col("header").isNotNull() & F.col("file_line").isNotNull()
    return changes.where(known).unionByName(filled(changes.where(~known), incoming))
