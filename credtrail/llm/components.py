"""Connected components of a large graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credtrail.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links (a, b)``; root is the least node that
    can be reached. Stars are joined by minima, so a node with very many
    links has one row in each aggregate; the number of rounds grows with the logarithm of the
    longest path. Links to itself and repeats do no harm; null ends are left out."""
    edges = links.where("a is not null and b is not null and a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    before = None
    while (now := _mark(edges)) != before:
        before = now
        edges = written(_small_star(_large_star(edges)), "edges")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return nodes.unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    hashed = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), hashed).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m"))
    joined = both.where("b > a").join(least, F.col("a") == F.col("of"))
    return joined.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m"))
    joined = edges.join(least, F.col("a") == F.col("of")).where("b <> m")
    down = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("of").alias("a"), F.col("m").alias("b"))
    return down.unionByName(own).distinct()
