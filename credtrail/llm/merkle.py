"""A Merkle manifest of a table, and proofs from a few stored levels.

Rows are leaves; those of a group (a language) form a tree of their own, and the roots of these
form the top tree. Only every ``LEVELS``-th level is stored: a node there stands for an aligned
subtree of ``2 ** LEVELS`` nodes of the stored level below. To prove rows, paths go from
the top down: a task takes one aligned subtree, makes its missing interior nodes anew from the
stored ones, hands each of them its siblings and the path from above, and forgets the interior
again. No group is ever in one task: a subtree holds 256 nodes, and rows are numbered inside
groups of any size by :func:`credtrail.plans.ranking.numbered`.

Where nodes remain an odd number the last one is hashed alone, so each row keeps as many
levels as its group has. Defined cases: null fields have a hash of their own (``-``); rows of equal
id come by their hash, rows without an id first; a group may be null; an empty table
has no rows and no root. Only the columns named are read; others do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credtrail.llm.common import batches, written
from credtrail.plans.ranking import numbered
from credtrail.plans.sizing import broadcast_if_small

#: Levels from one stored level to the next.
LEVELS = 8

#: How a path notes each level: no sibling, one behind the node, one before it.
ALONE, RIGHT, LEFT = "0", "1", "2"
_STEP = 65

_NODES = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("at", pa.int64()), ("node", pa.string())])
_PATHS = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", pa.string())])


def field(column: Column) -> Column:
    """A value so that neighbours cannot run into each other."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_hash(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def h(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    return (n - 1).bit_length()


def grown(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and ``levels`` levels above them."""
    all_levels = [nodes]
    for _ in range(levels):
        below = all_levels[-1]
        all_levels.append([h(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return all_levels


def local_paths(nodes: list[str], levels: int) -> Iterator[str]:
    """For each node its steps inside the subtree over all nodes."""
    above = grown(nodes, levels)
    for i in range(len(nodes)):
        steps = []
        for level in above[:levels]:
            if i % 2:
                steps.append(LEFT + level[i - 1])
            elif i + 1 < len(level):
                steps.append(RIGHT + level[i + 1])
            else:
                steps.append(ALONE + "-" * (_STEP - 1))
            i //= 2
        yield "".join(steps)


def folded(node: str, path: str) -> str:
    """The root that a node and its path lead to."""
    for i in range(0, len(path), _STEP):
        side, sibling = path[i], path[i + 1 : i + _STEP]
        node = h(node) if side == ALONE else h(node, sibling) if side == RIGHT else h(sibling, node)
    return node


def siblings(path: str) -> list[str]:
    """The hashes that a proof consists of."""
    return [path[i + 1 : i + _STEP] for i in range(0, len(path), _STEP) if path[i] != ALONE]


@dataclass(frozen=True)
class Tree:
    """Stored levels of one or many trees: ``blocks[k]`` has a row ``tree, n, block, items`` for
    each aligned subtree of level ``k * levels``; ``roots`` is ``tree, n, node``."""

    blocks: list[DataFrame]
    roots: DataFrame
    levels: int


def _in_blocks(nodes: DataFrame, levels: int, *payload: str) -> DataFrame:
    """``2 ** levels`` nodes to a row, in order."""
    items = F.array_sort(F.collect_list(F.struct("at", "node", *payload)))
    return nodes.groupBy("tree", "n", F.shiftright("at", levels).alias("block")).agg(items.alias("items"))


def build(leaves: DataFrame, levels: int = LEVELS, payload: Sequence[str] = ()) -> Tree:
    """Trees over ``leaves (tree, n, at, node)``: ``at`` counts from 0 to ``n - 1`` in each tree.
    Columns of ``payload`` stay with the leaves."""
    tallest = height(leaves.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0])
    nodes, stored, roots = leaves, [], []
    for base in range(0, max(tallest, 1), levels):
        blocks = written(_in_blocks(nodes, levels, *(payload if base == 0 else ())), f"level-{base}")
        stored.append(blocks)

        def run(parts: Iterator[pa.RecordBatch], base: int = base) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for batch in parts:
                    for r in batch.to_pylist():
                        steps = min(levels, height(r["n"]) - base)
                        yield r["tree"], r["n"], r["block"], grown(r["nodes"], steps)[-1][0]

            yield from batches(rows(), _NODES)

        only = blocks.select("tree", "n", "block", F.transform("items", lambda x: x["node"]).alias("nodes"))
        above = written(only.mapInArrow(run, "tree string, n bigint, at bigint, node string"), f"level-{base + levels}")
        # Trees of no more leaves than one subtree has at this level are done.
        done = F.col("n") <= F.lit(1 << (base + levels)) if base + levels < 62 else F.lit(True)
        roots.append(above.where(done).select("tree", "n", "node"))
        nodes = above.where(~done)
    whole = roots[0]
    for more in roots[1:]:
        whole = whole.unionByName(more)
    return Tree(stored, written(whole, "roots"), levels)


def _paths_down(tree: Tree, tops: DataFrame) -> DataFrame:
    """``tree, block, path`` for the blocks of the leaves. ``tops (tree, path)`` is what lies
    above each root."""
    last = len(tree.blocks) - 1
    from_above = None
    for k in range(last, -1, -1):
        reach = min(62, tree.levels * (k + 1))
        own = F.col("n") <= F.lit(1 << reach)
        if k:
            own = own & (F.col("n") > F.lit(1 << (tree.levels * k)))
        starts = tree.roots.where(own).select("tree").join(tops, "tree")
        starts = starts.select("tree", F.lit(0).cast("bigint").alias("block"), "path")
        paths = starts if from_above is None else starts.unionByName(from_above)
        if k == 0:
            return written(paths, "paths")
        from_above = written(_spread_paths(tree, k, paths), "paths")
    raise AssertionError("a tree has at least one stored level")


def _spread_paths(tree: Tree, k: int, paths: DataFrame) -> DataFrame:
    """The path of every node of stored level ``k``, each a block of the level below."""
    base, levels = tree.levels * k, tree.levels
    rows = tree.blocks[k].select("tree", "n", "block", F.transform("items", lambda x: x["node"]).alias("nodes"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for batch in parts:
                for r in batch.to_pylist():
                    steps = min(levels, height(r["n"]) - base)
                    for i, path in enumerate(local_paths(r["nodes"], steps)):
                        yield r["tree"], (r["block"] << levels) + i, path + r["path"]

        yield from batches(out(), _PATHS, lambda r: len(r[2]))

    return rows.join(paths, ["tree", "block"]).mapInArrow(run, "tree string, block bigint, path string")


@dataclass(frozen=True)
class Manifest:
    """The trees of the groups, the tree over their roots, and its root (None: no rows)."""

    groups: Tree
    top: Tree
    group_roots: DataFrame
    root: str | None


def manifest(
    rows: DataFrame,
    fields: Sequence[Column],
    id_column: str = "doc_id",
    group: str = "lang",
    presented: Column | None = None,
    levels: int = LEVELS,
) -> Manifest:
    """Trees over ``rows``, a leaf for each, by ``id_column`` inside each ``group``.

    ``presented`` is the leaf that a proof of the row will start from, by default its own."""
    leaf = row_hash(fields)
    leaves = rows.select(
        field(F.col(group)).alias("tree"), F.col(group).alias("grp"), F.col(id_column).alias("id"),
        leaf.alias("node"), (leaf if presented is None else presented).alias("presented"),
    )
    # Written first: laying rows out by range looks at them twice.
    leaves = written(leaves, "leaves")
    sizes = written(leaves.groupBy("tree").agg(F.count("*").alias("n"), F.min("grp").alias("grp")), "sizes")
    placed = numbered(leaves.drop("grp"), [F.col("id").asc(), F.col("node").asc(), F.col("presented").asc()], ["tree"])
    placed = placed.withColumn("at", F.col("position") - 1).drop("position")
    placed = placed.join(broadcast_if_small(sizes.select("tree", "n")), "tree")
    groups = build(placed, levels, ["id", "presented"])

    tops = groups.roots.join(sizes.select("tree", "grp"), "tree").select("grp", F.col("tree").alias("group_tree"), "node")
    n = tops.count()
    tops = numbered(tops, [F.col("grp").asc_nulls_first()]).select(
        F.lit("top").alias("tree"), F.lit(n).cast("bigint").alias("n"), (F.col("position") - 1).alias("at"), "node", "group_tree"
    )
    top = build(tops, levels, ["group_tree"])
    first = top.roots.first()
    return Manifest(groups, top, groups.roots.select("tree", F.col("node").alias("subroot")), first and first["node"])


def proofs(made: Manifest) -> DataFrame:
    """``id, leaf, subroot, root, proof, folded_root`` for every row: ``proof`` are the
    siblings from the leaf to the root, ``folded_root`` what the presented leaf leads to."""
    no_path = made.top.roots.select("tree", F.lit("").alias("path"))
    above = _leaf_paths(made.top, _paths_down(made.top, no_path), "group_tree string")
    tops = written(above.select(F.col("group_tree").alias("tree"), "path"), "tops")
    paths = _paths_down(made.groups, tops).join(made.group_roots, "tree")
    found = _leaf_paths(made.groups, paths, "id bigint, presented string", ["subroot"])
    return found.select("id", "leaf", "subroot", F.lit(made.root).alias("root"), "proof", "folded_root")


def _leaf_paths(tree: Tree, paths: DataFrame, payload: str, carried: Sequence[str] = ()) -> DataFrame:
    """The leaves with their paths; ``carried`` columns of ``paths`` come along."""
    levels = tree.levels
    names = [p.split()[0] for p in payload.split(", ")]
    kinds = [pa.int64() if p.endswith("bigint") else pa.string() for p in payload.split(", ")]
    presented = "presented" in names
    schema = pa.schema(
        [*zip(names, kinds), *((c, pa.string()) for c in carried),
         ("leaf", pa.string()), ("path", pa.string()), ("proof", pa.string()), ("folded_root", pa.string())]
    )
    ddl = ", ".join([payload, *(f"{c} string" for c in carried), "leaf string, path string, proof string, folded_root string"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for batch in parts:
                for r in batch.to_pylist():
                    steps = min(levels, height(r["n"]))
                    nodes = [x["node"] for x in r["items"]]
                    rest = [r[c] for c in carried]
                    for item, local in zip(r["items"], local_paths(nodes, steps)):
                        path = local + r["path"]
                        own = [item[c] for c in names]
                        start = item["presented"] if presented else item["node"]
                        yield (*own, *rest, item["node"], path, "".join(siblings(path)), folded(start, path))

        yield from batches(out(), schema, lambda r: 2 * len(r[-3]))

    return tree.blocks[0].join(paths, ["tree", "block"]).mapInArrow(run, ddl)
