"""Lines that several documents hold, dropped by probing arrays behind a perfect hash.

Each line is known by 128 bits of its key. One aggregate finds the hashes that at least two
documents hold, with the least id that holds them. The distinct hashes are dealt to shards of
bounded size; a task turns a shard into a minimal perfect hash (a cascade of bit arrays: a key
rests in the first level where no other key falls on its bit, its slot is the rank of that bit)
and three arrays by slot: the other 64 bits as fingerprint, the number of documents, the owner.
Documents are then read again and look each line up in the arrays; no line is joined. Hashes of
one document only are left out of the index: they meet a slot with another fingerprint.

While the arrays are small (measured) each task gets all of them and documents stay where they
are. Beyond that the 16-byte hashes, not the lines, go to the shard that answers for them, a
shard with many probes in several copies.

Defined cases: a null or empty text is one empty line; rows of one id are one document; rows
without an id are one document that comes after all others; equal 128-bit hashes are equal lines.
Other columns pass through, but for ``kept``, ``n_lines`` and ``n_dropped``, which are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credtrail.llm.common import PASS_BYTES, batches, extended, mixed, to_batch, written

#: Shorter keys, in code points, are never dropped.
LEAST_POINTS = 10
#: Keys of one shard of the index, about 24 bytes each.
SHARD_KEYS = 1 << 17
#: Largest index, in bytes, that every task gets whole.
CARRIED_BYTES = 64 << 20
#: Probes of one shard that one task answers.
PROBES = 1 << 20

_SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_LINES = pa.schema([("digest", pa.binary()), ("high", pa.int64()), ("low", pa.int64()), ("doc_id", pa.int64())])
_SHARD = pa.schema(
    [("shard", pa.int64()), ("levels", pa.list_(pa.binary())), ("fingerprints", pa.binary()),
     ("counts", pa.binary()), ("owners", pa.binary()), ("hits", pa.int64())]
)
_SHARD_DDL = "shard bigint, levels array<binary>, fingerprints binary, counts binary, owners binary, hits bigint"


def line_key(line: bytes) -> bytes:
    """What two lines must have in common to be equal."""
    return line.strip(_SPACE).translate(_LOWER)


def digests(lines: list[bytes], least: int = LEAST_POINTS) -> list[bytes | None]:
    """16 bytes for every line whose key is long enough, else None."""
    found = []
    for line in lines:
        key = line_key(line)
        n = len(key)
        fits = n >= 4 * least or (n >= least and len(key.decode("utf-8", "replace")) >= least)
        found.append(xxhash.xxh3_128_digest(key) if fits else None)
    return found


def as_numbers(found: list[bytes]) -> np.ndarray:
    """Two unsigned numbers a digest."""
    return np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)


# -- the perfect hash ---------------------------------------------------------------


def _bit(keys: np.ndarray, level: int, n_bits: int) -> np.ndarray:
    step = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return (mixed(keys[:, 0] ^ mixed(keys[:, 1] + step)) % np.uint64(n_bits)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> list[bytes]:
    """The bit arrays of distinct keys (rows of two numbers)."""
    levels = []
    while len(keys):
        n_bits = 64 * ceil(2 * len(keys) / 64)
        at = _bit(keys, len(levels), n_bits)
        hits = np.bincount(at, minlength=n_bits)
        levels.append(np.packbits(hits == 1, bitorder="little").tobytes())
        keys = keys[hits[at] > 1]
    return levels


class Shard:
    """The arrays of one shard, and how to ask them."""

    def __init__(self, levels: list[bytes], fingerprints: bytes, counts: bytes, owners: bytes):
        self.levels = [np.frombuffer(x, "<u8") for x in levels]
        self.before, n = [], 0
        for words in self.levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.before.append(n + np.concatenate([[0], np.cumsum(ones)]))
            n = int(self.before[-1][-1])
        self.fingerprints = np.frombuffer(fingerprints, "<u8")
        self.counts = np.frombuffer(counts, "<u4")
        self.owners = np.frombuffer(owners, "<i8")

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key, -1 where no level takes it; any slot for foreign keys."""
        found, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, words in enumerate(self.levels):
            at = _bit(keys[left], level, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            found[left[hit]] = (self.before[level][at >> 6] + below)[hit]
            left = left[~hit]
        return found

    def owner_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is in the index, and the id that keeps its line."""
        slot = self.slots(keys)
        known = slot >= 0
        known[known] = self.fingerprints[slot[known]] == keys[known, 1]
        return known, np.where(known, self.owners[slot], 0) if len(self.owners) else np.zeros(len(keys), np.int64)


def shard_of(keys: np.ndarray, n_shards: int) -> np.ndarray:
    return (keys[:, 0] % np.uint64(n_shards)).astype(np.int64)


def _built(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard become one row a shard."""

    def row(shard: int, held: list[tuple]) -> tuple:
        high, low, owner, n = (np.concatenate(x) for x in zip(*held, strict=True))
        keys = np.stack([high.view(np.uint64), low.view(np.uint64)], axis=1)
        levels = perfect_hash(keys)
        empty = np.zeros(len(keys), "<u8").tobytes()
        slot = Shard(levels, empty, b"", b"").slots(keys)
        arrays = []
        for values, kind in ((keys[:, 1], "<u8"), (np.minimum(n, 0xFFFFFFFF), "<u4"), (owner, "<i8")):
            out = np.empty(len(keys), kind)
            out[slot] = values
            arrays.append(out.tobytes())
        return (shard, levels, *arrays, int(n.sum()))

    now, held = None, []
    for batch in parts:
        columns = [batch.column(c).to_numpy() for c in ("shard", "high", "low", "owner", "n")]
        cuts = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and columns[0][a] != now:
                yield to_batch([row(int(now), held)], _SHARD)
                held = []
            now = columns[0][a]
            held.append(tuple(c[a:b] for c in columns[1:]))
    if held:
        yield to_batch([row(int(now), held)], _SHARD)


def line_index(docs: DataFrame, least: int = LEAST_POINTS, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The arrays of all lines that at least two documents hold, one row a shard, and how
    many shards there are."""
    seen = _distinct_lines(docs, least).groupBy("high", "low").agg(
        F.min("doc_id").alias("owner"),
        F.max("doc_id").alias("last"),
        F.count("*").alias("n"),
        F.count_if(F.col("doc_id").isNull()).alias("no_id"),
    )
    repeated = seen.where("owner <> last or (owner is not null and no_id > 0)")
    repeated = written(repeated.select("high", "low", "owner", "n"), "repeated-lines")
    n_shards = max(1, ceil(repeated.count() / shard_keys))
    # Unsigned remainder of the high number, as shard_of takes it.
    half = F.shiftrightunsigned("high", 1) % n_shards * 2 + F.col("high").bitwiseAND(1)
    dealt = repeated.withColumn("shard", half % n_shards)
    dealt = dealt.select("shard", "high", "low", "owner", "n").repartition("shard").sortWithinPartitions("shard")
    return written(dealt.mapInArrow(_built, _SHARD_DDL), "line-index"), n_shards


def _distinct_lines(docs: DataFrame, least: int) -> DataFrame:
    """``digest, high, low, doc_id`` of the distinct long lines of every row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in parts:
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                    found = {d for d in digests((text or b"").split(b"\n"), least) if d}
                    numbers = as_numbers(list(found)).view(np.int64).tolist()
                    for digest, (high, low) in zip(found, numbers):
                        yield digest, high, low, doc_id

        yield from batches(rows(), _LINES)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "digest binary, high bigint, low bigint, doc_id bigint"
    )


# -- documents ------------------------------------------------------------------------


def deduplicated(
    docs: DataFrame,
    least: int = LEAST_POINTS,
    shard_keys: int = SHARD_KEYS,
    carried_bytes: int = CARRIED_BYTES,
    probes: int = PROBES,
) -> DataFrame:
    """``docs`` with ``kept`` (the lines that stay), ``n_lines`` and ``n_dropped``."""
    index, n_shards = line_index(docs, least, shard_keys)
    size = F.octet_length("fingerprints") + F.octet_length("counts") + F.octet_length("owners")
    size = size + F.aggregate("levels", F.lit(0), lambda n, x: n + F.octet_length(x))
    if index.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= carried_bytes:
        return _with_carried(docs, index, n_shards, least)
    return _with_routed(docs, index, n_shards, least, probes)


def _rows_kept(batch: pa.RecordBatch, names: list[str], least: int, gone_of: Callable) -> Iterator[pa.RecordBatch]:
    """Some megabytes of text at a time. ``names`` are the columns that stay; ``gone_of(batch, rows,
    digests)`` tells which of the lines go, ``rows`` being the places of their documents."""
    texts = batch.column("text").cast(pa.binary())
    piece = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy() + 64) // PASS_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        part = batch.slice(start, end - start)
        kept = [t or b"" for t in texts.slice(start, end - start).to_pylist()]
        n_lines, rows, places, found = [], [], [], []
        for i, text in enumerate(kept):
            lines = text.split(b"\n")
            n_lines.append(len(lines))
            for j, digest in enumerate(digests(lines, least)):
                if digest:
                    rows.append(i)
                    places.append(j)
                    found.append(digest)
        dropped = defaultdict(set)
        for k in np.flatnonzero(gone_of(part, rows, found)).tolist() if found else ():
            dropped[rows[k]].add(places[k])
        for i, gone in dropped.items():
            kept[i] = b"\n".join([x for j, x in enumerate(kept[i].split(b"\n")) if j not in gone])
        n_dropped = [len(dropped[i]) if i in dropped else 0 for i in range(len(kept))]
        columns = [part.column(n) for n in names]
        columns += [pa.array(kept, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*names, "kept", "n_lines", "n_dropped"])


def _free_name(name: str, df: DataFrame) -> str:
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def _as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("kept", F.col("kept").cast("string"))


_ADDED = "kept binary, n_lines bigint, n_dropped bigint"


def _staying(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("kept", "n_lines", "n_dropped")]


def _with_carried(docs: DataFrame, index: DataFrame, n_shards: int, least: int) -> DataFrame:
    # The caller has measured the index against a bound.
    fields = ("levels", "fingerprints", "counts", "owners")
    rows = {
        r["shard"]: tuple([bytes(x) for x in r[f]] if f == "levels" else bytes(r[f]) for f in fields)
        for r in index.toLocalIterator()
    }
    carried = docs.sparkSession.sparkContext.broadcast(rows)
    names = _staying(docs)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {k: Shard(*v) for k, v in carried.value.items()}

        def gone_of(batch: pa.RecordBatch, rows: list[int], found: list[bytes]) -> np.ndarray:
            ids = batch.column("doc_id").cast(pa.int64())
            no_id = ids.is_null().to_numpy(zero_copy_only=False)[rows]
            own, keys = ids.fill_null(0).to_numpy()[rows], as_numbers(found)
            gone = np.zeros(len(keys), bool)
            of = shard_of(keys, n_shards)
            by_shard = np.argsort(of, kind="stable")
            for s, shard in shards.items():
                a, b = np.searchsorted(of, [s, s + 1], sorter=by_shard)
                mine = by_shard[a:b]
                if len(mine):
                    known, owner = shard.owner_of(keys[mine])
                    gone[mine] = known & (no_id[mine] | (owner != own[mine]))
            return gone

        for batch in parts:
            yield from _rows_kept(batch, names, least, gone_of)

    return _as_text(docs.mapInArrow(run, extended(docs, _ADDED)))


def _with_routed(docs: DataFrame, index: DataFrame, n_shards: int, least: int, probes: int) -> DataFrame:
    asked = written(_distinct_lines(docs, least), "probes")
    half = F.shiftrightunsigned("high", 1) % n_shards * 2 + F.col("high").bitwiseAND(1)
    asked = asked.withColumn("shard", half % n_shards)
    # A shard with a line of very many documents has as many copies as its probes need.
    loads = asked.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(probes)).cast("bigint").alias("copies"))
    loads = written(loads, "loads")  # one row a shard
    each = index.join(loads, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    salt = F.pmod(F.xxhash64("doc_id", "low"), F.col("copies"))
    asked = asked.join(F.broadcast(loads), "shard").withColumn("copy", salt)

    def answer(rows: pa.Table, arrays: pa.Table) -> pa.Table:
        out = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary())])
        if not rows.num_rows or not arrays.num_rows:
            return out.empty_table()
        one = arrays.slice(0, 1).to_pylist()[0]
        shard = Shard(one["levels"], one["fingerprints"], one["counts"], one["owners"])
        keys = np.stack([rows.column(c).to_numpy().view(np.uint64) for c in ("high", "low")], axis=1)
        known, owner = shard.owner_of(keys)
        ids = rows.column("doc_id").combine_chunks()
        no_id = ids.is_null().to_numpy(zero_copy_only=False)
        gone = known & (no_id | (ids.fill_null(0).to_numpy() != owner))
        return rows.select(["doc_id", "digest"]).filter(pa.array(gone)).cast(out)

    hits = asked.groupBy("shard", "copy").cogroup(each.drop("hits", "copies").groupBy("shard", "copy"))
    hits = hits.applyInArrow(answer, "doc_id bigint, digest binary")
    # One group is the lines of one document, which bounds it.
    of, gone = _free_name("of", docs), _free_name("gone", docs)
    lists = hits.groupBy(F.col("doc_id").alias(of)).agg(F.collect_set("digest").alias(gone))
    joined = docs.join(lists, F.col("doc_id").cast("bigint").eqNullSafe(F.col(of)), "left").drop(of)
    names = _staying(docs)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def gone_of(batch: pa.RecordBatch, rows: list[int], found: list[bytes]) -> np.ndarray:
            lists = [set(x or ()) for x in batch.column(gone).to_pylist()]
            return np.array([d in lists[i] for i, d in zip(rows, found)])

        for batch in parts:
            yield from _rows_kept(batch, names, least, gone_of)

    return _as_text(joined.mapInArrow(run, extended(docs, _ADDED)))
