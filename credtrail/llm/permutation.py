"""Nearest neighbours by a permutation index.

A vector is represented by the nearer half of the pivots, in order. Blocks of vectors are
stored with an inverted file for each pivot: at which place each vector lists it. For a
query only the files of its own ``QUERY_PREFIX`` nearest pivots are read; they add up to the footrule
distance of the two permutations (a vector that does not list a pivot has it at the end), the
``RERANK`` nearest in each block are ranked again by exact inner product, and the best
of all blocks win. The nearer vectors are, the more alike are their permutations.

Inner products are brought to angles by one more coordinate that makes all
vectors equally long; queries have 0 there. Pivots are a sample of ``2 * sqrt(rows)`` distinct vectors, at
least ``LEAST_PIVOTS`` and at most ``MAX_PIVOTS``, chosen by hash; every row is indexed. Equal vectors of a block
share an entry that lists their ids, so a group of copies crowds nothing out.

Blocks of vectors and blocks of queries meet in an equi-join over groups of blocks: a
stated query set against all rows, in blocks.

Defined cases: rows with a null id, and vectors that are null, zero, or hold null or non-finite
components take no part, nor do vectors of another dimension than most; equal
scores go to the smaller id; a query has no row with its own id; with fewer
candidates than asked for, all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credtrail.llm.common import written

QUERY_PREFIX = 128
RERANK = 400
LEAST_PIVOTS = 512
MAX_PIVOTS = 4096
BLOCK_ROWS = 8192
QUERY_ROWS = 512


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` (doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vector") == (sizes[0] if sizes else 0))


def chosen_pivots(rows: DataFrame, count: int) -> np.ndarray:
    wanted = min(MAX_PIVOTS, max(LEAST_PIVOTS, math.ceil(2 * math.sqrt(count))))
    place = F.pmod(F.xxhash64("vector"), F.lit(1 << 40))
    share = min(1.0, 8 * wanted / count)
    sample = rows.where(place < F.lit(int(share * (1 << 40)))).select("vector").distinct()
    if share < 1 and sample.count() < wanted:  # few distinct vectors: look among all
        sample = rows.select("vector").distinct()
    return np.array([r[0] for r in sample.orderBy(F.xxhash64("vector")).limit(wanted).collect()])


def permutations(vectors: np.ndarray, pivots: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first: half of them, or for
    queries their first ones only."""
    k = (len(pivots) + 1) // 2
    if query:
        k = min(k, QUERY_PREFIX)
    near = vectors @ pivots.T
    if not query:
        near += _rest(vectors, longest)[:, None] * _rest(pivots, longest)[None, :]
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(near, best, 1), axis=1, kind="stable")
    return np.take_along_axis(best, order, 1)


def _rest(vectors: np.ndarray, longest: float) -> np.ndarray:
    return np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1)


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows: ``ids`` and ``vectors`` as bytes of 64-bit numbers."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, n = [], [], 0

        def block():
            columns = [np.concatenate(ids).tobytes(), np.concatenate(vectors).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["ids", "vectors"])

        for part in parts:
            for at in range(0, part.num_rows, size):
                piece = part.slice(at, size)
                if n and n + piece.num_rows > size:
                    yield block()
                    ids, vectors, n = [], [], 0
                ids.append(piece.column(0).to_numpy())
                vectors.append(_matrix(piece.column(1)))
                n += piece.num_rows
        if n:
            yield block()

    return rows.select("vec_id", "vector").mapInArrow(run, "ids binary, vectors binary")


class Block:
    """Distinct vectors with the sorted ids of each, and the inverted files of the pivots."""

    def __init__(self, ids: bytes, vectors: bytes, pivots: np.ndarray, longest: float):
        own, flat = np.frombuffer(ids, np.int64), np.frombuffer(vectors)
        order = np.argsort(own, kind="stable")
        own, flat = own[order], flat.reshape(len(own), -1)[order]
        flat = flat + 0.0  # -0 is 0
        whole = np.ascontiguousarray(flat).view(np.dtype((np.void, flat.itemsize * flat.shape[1]))).ravel()
        _, first, group = np.unique(whole, return_index=True, return_inverse=True)
        by_group = np.argsort(group, kind="stable")
        self.vectors, self.ids = flat[first], own[by_group]
        self.ends = np.append(0, np.cumsum(np.bincount(group)))
        near = permutations(self.vectors, pivots, longest, query=False)
        n, k = near.shape
        # One row a pivot: the place at which each vector lists it.
        self.places = np.full((len(pivots), n), k, np.int16)
        self.places[near.T, np.arange(n)] = np.arange(k, dtype=np.int16)[:, None]

    def nearest(self, query_id: int, query: np.ndarray, near: np.ndarray, wanted: int):
        """Ids and scores, best first."""
        own = np.arange(len(near), dtype=np.int16)[:, None]
        footrule = np.abs(self.places[near] - own).sum(axis=0, dtype=np.int32)
        take = min(max(RERANK, wanted + 1), len(footrule))
        best = np.argpartition(footrule, take - 1)[:take]
        score = np.cumsum(self.vectors[best] * query, axis=1)[:, -1]
        order = np.argsort(-score, kind="stable")[: wanted + 1]
        if len(best) > wanted + 1:  # equals at the edge
            order = np.flatnonzero(score >= score[order[-1]])
        ids = [self.ids[self.ends[b] : self.ends[b + 1]][: wanted + 1] for b in best[order]]
        scores = np.repeat(score[order], [len(x) for x in ids])
        ids = np.concatenate(ids)
        scores, ids = scores[ids != query_id], ids[ids != query_id]
        top = np.lexsort((ids, -scores))[:wanted]
        return ids[top], scores[top]


def search(vectors: DataFrame, is_query: Column, wanted: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the nearest found for each query row."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    count, queries, longest = rows.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(norm)).first()
    kinds = "query_id bigint, rank int, vec_id bigint, score double"
    if not queries:
        return spark.createDataFrame([], kinds)
    shared = spark.sparkContext.broadcast((chosen_pivots(rows, count), longest))
    blocks, groups = math.ceil(count / BLOCK_ROWS), math.ceil(queries / QUERY_ROWS)
    index = written(packed(rows.repartition(blocks), BLOCK_ROWS), "index")
    index = index.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(blocks)))
    asked = packed(rows.where(is_query).repartition(groups), QUERY_ROWS)
    asked = asked.withColumn("part", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    met = index.join(asked.withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"}), "part")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (pivots, longest), last, block = shared.value, None, None
        for part in parts:
            for r in part.to_pylist():
                if r["ids"] != last:
                    last, block = r["ids"], Block(r["ids"], r["vectors"], pivots, longest)
                ids, flat = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_vectors"])
                asked = flat.reshape(len(ids), -1)
                near = permutations(asked, pivots, longest, query=True)
                found = [block.nearest(i, q, p, wanted) for i, q, p in zip(ids.tolist(), asked, near, strict=True)]
                lengths = [len(f[0]) for f in found]
                columns = [np.repeat(ids, lengths), *(np.concatenate(x) for x in zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    found = met.select("ids", "vectors", "q_ids", "q_vectors").mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= wanted)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
