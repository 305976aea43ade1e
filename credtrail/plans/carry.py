"""Values that hold from one line of a file until the next line that sets them.

Files are read in splits. Inside a split the values are carried along as Arrow batches pass
by; the result is written once, with one more row per split that says what it ends with,
and the first lines of a split take the rest from the splits before. No file is in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credtrail.plans.sizing import broadcast_if_small
from credtrail.plans.storage import stored


def carried(lines: DataFrame, fill: Sequence[str], keep: str, name: str = "carried") -> DataFrame:
    """``lines (path, block, …)`` straight from a text source, with the string columns ``fill``
    holding the last value that was set at or before the line, null before the first.

    Rows for which the boolean column ``keep`` is true are returned, without it.
    """
    fill = list(fill)
    schema = lines.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, state = None, {}
        for batch in batches:
            names = batch.schema.names
            for own, rows in _runs(batch):
                if own != block:
                    if block is not None:
                        yield _end(block, state, out_schema(names, batch.schema))
                    block, state = own, dict.fromkeys(fill)
                columns = {n: rows.column(n) for n in names}
                for c in fill:
                    filled = pc.fill_null_forward(columns[c])
                    if state[c] is not None:
                        filled = pc.fill_null(filled, state[c])
                    columns[c], state[c] = filled, filled[-1].as_py()
                done = out_schema(names, batch.schema)
                arrays = [columns[n] for n in names] + [pa.array(np.zeros(rows.num_rows, bool))]
                rows = pa.RecordBatch.from_arrays(arrays, schema=done)
                yield rows.filter(columns[keep])
        if block is not None:
            yield _end(block, state, done)

    def out_schema(names: list[str], kinds: pa.Schema) -> pa.Schema:
        return pa.schema([(n, kinds.field(n).type) for n in names] + [("_end", pa.bool_())])

    out = type(schema)(list(schema.fields)).add("_end", "boolean")
    rows = stored(lines.mapInArrow(run, out), name)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.where("_end").select(
        "path", "block", *(F.last(c, True).over(before).alias(f"_in_{c}") for c in fill), F.lit(True).alias("_known")
    )
    ends = broadcast_if_small(stored(ends, f"{name}-splits"))
    lost = F.raise_error(F.concat(F.lit("no values for a split of "), "path"))
    placed = rows.where("not _end").join(ends, ["path", "block"], "left")
    return placed.select(
        *(
            F.when(F.col("_known"), F.coalesce(c, f"_in_{c}")).otherwise(lost.cast("string")).alias(c) if c in fill else F.col(c)
            for c in lines.columns
            if c != keep
        )
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The stretches of a batch that come from one split."""
    path, start = batch.column("path"), batch.column("block")
    codes = path.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    starts = start.to_numpy(zero_copy_only=False)
    turns = np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1
    edges = [0, *turns.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield (path[a].as_py(), start[a].as_py()), batch.slice(a, b - a)


def _end(block: tuple, state: dict, schema: pa.Schema) -> pa.RecordBatch:
    row = {**state, "path": block[0], "block": block[1], "_end": True}
    return pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in schema], schema=schema)
