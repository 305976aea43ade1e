"""Benchmark decontamination by greedy string tiling.

Items of the benchmark and documents become sequences of word hashes. A shared seed of
``SEED_WORDS`` words makes a pair of document and item a candidate; then the pair is
tiled: windows of the current length are looked up by their rolling (Karp-Rabin) hashes,
every match is grown as far as it goes, the longest ones are marked first, no word is
used twice, and the length falls until only shorter matches than a seed are left. As tiles may lie in
any order, passages whose sentences were moved are found too. A document is
contaminated if the tiles cover ``COVERAGE`` or more of an item's words.

The seeds of the benchmark are given to every task if their size, which is counted, allows it;
beyond ``BROADCAST_BYTES`` documents and items meet in a join on the seeds instead, with
the same result.

Words: lower case, ASCII punctuation taken as blanks. Defined cases: null or empty texts hit
nothing; an item shorter than a seed counts as one seed and one tile; items without words are
left out; of items with equal coverage the one with the smallest id is named;
repeated documents are judged each; extra columns are left alone.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credtrail.llm.common import Cached, extended, mixed, written
from credtrail.plans.sizing import BROADCAST_BYTES

SEED_WORDS = 5
COVERAGE = 0.5
STEP = np.uint64(0xC2B2AE3D27D4EB4F)
BLANKS = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
RESULT = "n_items bigint, item_id bigint, coverage double"


def word_hashes() -> Cached:
    return Cached(xxhash.xxh3_64_intdigest, 300_000)


def sequence(text: str | None, known: Cached) -> np.ndarray:
    found = text.lower().encode().translate(BLANKS).split() if text else ()
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def windows(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words, in order."""
    runs = len(words) - length + 1
    if runs <= 0:
        return np.empty(0, np.uint64)
    power, total, done = words, np.zeros(runs, np.uint64), 0
    # By doubling: a window is put together from blocks of 1, 2, 4, ... words.
    width, scale = 1, np.array([STEP])
    while width <= length:
        if length & width:
            total = total * scale + power[done : done + runs]
            done += width
        if width * 2 <= length:
            power = power[: len(power) - width] * scale + power[width:]
        scale = scale * scale
        width *= 2
    return mixed(total + np.uint64(length))


def tiles(words: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Disjoint matches ``(place in words, place in item, length)``, longest first."""
    free_a, free_b = np.ones(len(words), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []
    length = len(item)
    while length >= least:
        here, there = windows(words, length), windows(item, length)
        spots = defaultdict(list)
        for j in np.flatnonzero(np.isin(there, here)).tolist():
            spots[int(there[j])].append(j)
        marked = False
        if spots:
            for i in np.flatnonzero(np.isin(here, there)).tolist():
                for j in spots.get(int(here[i]), ()):
                    a, b = slice(i, i + length), slice(j, j + length)
                    if free_a[a].all() and free_b[b].all() and (words[a] == item[b]).all():
                        free_a[a] = free_b[b] = False
                        out.append((i, j, length))
                        marked = True
                        break
        if marked and not free_b.any():
            break
        length = _next(words, item, free_a, free_b, length - 1, least)
    return out


def _next(words, item, free_a, free_b, most: int, least: int) -> int:
    """The greatest length up to ``most`` of which unmarked words still match, by halving:
    if a run matches, so do its parts."""
    low, high = least - 1, most
    while low < high:
        middle = (low + high + 1) // 2
        a, b = windows(words, middle), windows(item, middle)
        a = a[_unmarked(free_a, middle)] if len(a) else a
        b = b[_unmarked(free_b, middle)] if len(b) else b
        if len(a) and len(b) and np.isin(b, a).any():
            low = middle
        else:
            high = middle - 1
    return low if low >= least else least - 1


def _unmarked(free: np.ndarray, length: int) -> np.ndarray:
    taken = np.concatenate([[0], np.cumsum(~free)])
    return taken[length:] == taken[:-length]


class Items:
    """Sequences of the benchmark and the sorted hashes of their seeds."""

    def __init__(self, rows: list[tuple[int, str]]):
        known = word_hashes()
        self.words = {}
        seeds: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in rows:
            words = sequence(text, known)
            if len(words):
                self.words[item_id] = words
                length = min(SEED_WORDS, len(words))
                for seed in np.unique(windows(words, length)).tolist():
                    seeds[length][seed].append(item_id)
        self.seeds = {
            n: (np.sort(np.array(list(s), np.uint64)), dict(s)) for n, s in seeds.items()
        }

    def candidates(self, words: np.ndarray) -> list[int]:
        found = set()
        for length, (hashes, items) in self.seeds.items():
            here = windows(words, length)
            if len(here):
                at = np.minimum(np.searchsorted(hashes, here), len(hashes) - 1)
                for seed in np.unique(here[hashes[at] == here]).tolist():
                    found.update(items[seed])
        return sorted(found)

    def coverage(self, words: np.ndarray, item_id: int) -> float:
        item = self.words[item_id]
        found = tiles(words, item, min(SEED_WORDS, len(item)))
        return sum(n for _, _, n in found) / len(item)


def judged(docs: DataFrame, benchmark: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Add to every row of ``docs``: the number of items it is contaminated with, the one
    with the greatest coverage (also below the threshold) and that coverage."""
    names = [f.strip().split()[0] for f in RESULT.split(",")]
    docs = docs.select(*[c for c in docs.columns if c not in names])
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    items = items.select(F.col("item_id").cast("bigint"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # Python objects of a seed take about thirty times the bytes of a word.
    if size * 30 <= limit:
        return _judged_by_task(docs, items)
    return _judged_by_join(docs, items)


def _judged_by_task(docs: DataFrame, items: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known = Items(shared.value), word_hashes()
        for part in parts:
            rows = []
            for text in part.column("text").to_pylist():
                words = sequence(text, known)
                found = [(items.coverage(words, i), -i) for i in items.candidates(words)]
                rows.append(_verdict(found))
            yield _with_verdict(part, rows)

    return docs.mapInArrow(run, extended(docs, RESULT))


def _verdict(found: list[tuple[float, int]]) -> tuple:
    best = max(found, default=None)
    hits = sum(c >= COVERAGE for c, _ in found)
    return (hits, None, 0.0) if best is None else (hits, -best[1], best[0])


def _with_verdict(part: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.float64())
    columns = [pa.array([r[i] for r in rows], kinds[i]) for i in range(3)]
    names = [*part.schema.names, "n_items", "item_id", "coverage"]
    return pa.RecordBatch.from_arrays([*part.columns, *columns], names)


def _judged_by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Texts are known by their hash; only texts that share a seed meet an item."""
    lengths = items.mapInArrow(_lengths, "n int").distinct().orderBy("n")
    lengths = [r[0] for r in lengths.collect()]  # at most SEED_WORDS of them

    def seeds_of(own: bool):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = word_hashes()
            for part in parts:
                for key, text in zip(*(part.column(i).to_pylist() for i in (0, 1)), strict=True):
                    words = sequence(text, known)
                    for n in [min(SEED_WORDS, len(words))] if own else lengths:
                        seeds = np.unique(windows(words, n)) if n else ()
                        if len(seeds):
                            columns = [pa.array([key] * len(seeds)), pa.array(seeds.view(np.int64))]
                            yield pa.RecordBatch.from_arrays(columns, ["key", "seed"])

        return run

    keyed = docs.withColumn("_hash", F.sha2("text", 256))
    texts = keyed.where(F.col("text").isNotNull()).select("_hash", "text")
    mine = items.mapInArrow(seeds_of(True), "key bigint, seed bigint").withColumnRenamed("key", "item_id")
    theirs = texts.mapInArrow(seeds_of(False), "key string, seed bigint")
    pairs = written(theirs.join(mine, "seed").select("key", "item_id").distinct(), "candidates")
    needed = pairs.select(F.col("key").alias("_hash")).distinct()
    whole = texts.join(needed, "_hash", "left_semi").dropDuplicates(["_hash"])
    met = pairs.join(whole.withColumnRenamed("_hash", "key"), "key")
    met = met.join(items.withColumnRenamed("text", "item_text"), "item_id")
    covered = met.select("key", "item_id", "text", "item_text").mapInArrow(
        _covered, "key string, item_id bigint, coverage double"
    )
    verdict = covered.groupBy(F.col("key").alias("_key")).agg(
        F.sum((F.col("coverage") >= COVERAGE).cast("bigint")).alias("n_items"),
        F.max_by("item_id", F.struct("coverage", -F.col("item_id"))).alias("item_id"),
        F.max("coverage").alias("coverage"),
    )
    out = keyed.join(verdict, F.col("_hash") == F.col("_key"), "left").drop("_hash", "_key")
    return out.withColumns(
        {"n_items": F.coalesce("n_items", F.lit(0).cast("bigint")), "coverage": F.coalesce("coverage", F.lit(0.0))}
    )


def _lengths(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = word_hashes()
    for part in parts:
        found = {min(SEED_WORDS, len(sequence(t, known))) for t in part.column(1).to_pylist()} - {0}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], ["n"])


def _covered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = word_hashes()
    for part in parts:
        rows = []
        for r in part.to_pylist():
            words, item = sequence(r["text"], known), sequence(r["item_text"], known)
            found = tiles(words, item, min(SEED_WORDS, len(item)))
            rows.append(sum(n for _, _, n in found) / len(item))
        yield pa.RecordBatch.from_arrays(
            [part.column("key"), part.column("item_id"), pa.array(rows, pa.float64())],
            ["key", "item_id", "coverage"],
        )
