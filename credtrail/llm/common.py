"""Small helpers of the operators in this folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from credtrail.plans.storage import new_path

#: Bytes of text that a numpy pass takes at once; its scratch arrays are about
#: ten times as large.
PASS_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch; a row is a document here, and documents are long.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Send documents to Python workers in smaller batches than by default, on both sides of
    the pipe; a session that asks for still smaller ones keeps them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives
    lost executors, like a checkpoint, but keeps columns apart for later reads."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def extended(df: DataFrame, added: str) -> StructType:
    """The schema of ``df`` with more columns at the end; one of the same name goes."""
    new = StructType.fromDDL(added)
    return StructType([f for f in df.schema if f.name not in new.names] + new.fields)


def batches(rows: Iterable[tuple], schema: pa.Schema, weigh=None) -> Iterator[pa.RecordBatch]:
    """Record batches of some thousand rows; ``weigh`` gives the bytes of a row."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 if weigh is None else weigh(row)
        if len(held) >= 4096 or size >= PASS_BYTES:
            yield to_batch(held, schema)
            held, size = [], 0
    if held:
        yield to_batch(held, schema)


def slices(batch: pa.RecordBatch, column: str, limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``limit`` bytes of a text column, a row at least: what is made of
    the texts then stays small next to the batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(sizes.astype(np.int64) + 64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def to_batch(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers; one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Cached(dict):
    """Values of ``make`` by text; emptied when it holds ``limit`` keys. Long texts are
    made anew each time, so the keys take a bounded number of bytes."""

    LONGEST = 64

    def __init__(self, make, limit: int = 200_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value
