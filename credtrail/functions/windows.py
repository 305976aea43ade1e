"""Windows of a text that may be one of many short strings, over Arrow columns.

A window is known by its first eight bytes as a number, so equal numbers are equal bytes. Two
bits per string in a table (the sieve) tell which windows may be listed; others stay behind.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass takes, a row at least; its arrays are some ten times as large.
PASS_BYTES = 256 << 10


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where its rows start (and the last ends); null is empty."""
    column = pa.concat_arrays([pc.fill_null(column, "").cast(pa.large_string())])
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, np.int64, len(column) + 1, column.offset * 8)
    if data is None or starts[-1] == starts[0]:
        return np.zeros(0, np.uint8), starts - starts[0]
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def _heads(raw: np.ndarray) -> np.ndarray:
    """For each byte the eight from there on as a number, as if zeros followed the last."""
    head = np.zeros(len(raw) + 8, np.uint64)
    head[: len(raw)] = raw
    for step in (1, 2, 4):
        head[:-step] |= head[step:] << np.uint64(8 * step)
    return head[: len(raw)]


def _first(heads: np.ndarray, size: int) -> np.ndarray:
    return heads if size >= 8 else heads & np.uint64((1 << 8 * size) - 1)


def _places(heads: np.ndarray, longs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit places in a table of so many longs, a power of two."""
    x = heads * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    last = np.uint64(longs * 64 - 1)
    return (x >> np.uint64(32)) & last, (x ^ (x >> np.uint64(29))) & last


def _is_set(sieve: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (sieve[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def sieve_bits(strings: pa.Array, longs: int) -> pa.RecordBatch:
    """``(id, bits)``: the bits of the strings in a sieve, a long each."""
    raw, starts = _bytes(strings)
    sizes = np.diff(starts)
    heads = _heads(raw)[starts[:-1][sizes > 0]]
    sizes = sizes[sizes > 0]
    short = np.minimum(sizes, 8).astype(np.uint64) * np.uint64(8) - np.uint64(1)
    heads = heads & ((np.uint64(2) << short) - np.uint64(1))
    place = np.unique(np.concatenate(_places(heads, longs)))
    bits = np.uint64(1) << (place & np.uint64(63))
    ids = (place >> np.uint64(6)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(bits.view(np.int64))], ["id", "bits"])


def with_windows(batch: pa.RecordBatch, column: str, sizes: Sequence[int], sieve: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows in which windows of ``sizes`` bytes pass the sieve, with a list of those windows
    as a last column; windows of up to eight bytes come once per row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(lengths.astype(np.int64)) // PASS_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield from _with_windows(batch.slice(a, b - a), column, sizes, sieve)


def _with_windows(batch, column, sizes, sieve):
    raw, starts = _bytes(batch.column(column))
    heads = _heads(raw)
    ends = starts[1:]
    # Characters start at these bytes, and behind the last one.
    whole = np.append((raw & 0xC0) != 0x80, True)
    rows, found = [], []
    for size in sizes:
        if size > len(raw):
            continue
        head = _first(heads[: len(raw) - size + 1], size)
        one, other = _places(head, len(sieve))
        at = np.flatnonzero(_is_set(sieve, one))
        at = at[_is_set(sieve, other[at])]
        at = at[whole[at] & whole[at + size]]
        row = np.searchsorted(ends, at, side="right")
        inside = at + size <= ends[row]
        at, row = at[inside], row[inside]
        if size <= 8 and len(at):
            order = np.lexsort((head[at], row))
            at, row = at[order], row[order]
            new = np.append(True, (np.diff(row) != 0) | (head[at][1:] != head[at][:-1]))
            at, row = at[new], row[new]
        data = np.ascontiguousarray(raw[at[:, None] + np.arange(size)])
        offsets = np.arange(len(at) + 1, dtype=np.int32) * np.int32(size)
        rows.append(row)
        found.append(pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)))
    if not sum(map(len, rows)):
        return
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    some, first = np.unique(row[order], return_index=True)
    lists = pa.ListArray.from_arrays(
        pa.array(np.append(first, len(row)), pa.int32()), pa.concat_arrays(found).take(pa.array(order))
    )
    kept = batch.take(pa.array(some))
    yield pa.RecordBatch.from_arrays([*kept.columns, lists], [*kept.schema.names, "_anchors"])
