"""Resharding by minimum-cost flow.

From the bytes that the old shards hold and the capacities of the new ones, a flow is found
that moves the fewest bytes. Documents are moved in blocks: inside an old shard a hash of
id and text gives each its block, so sizes of blocks come from one aggregate, no
order is needed, and a hot shard or a group of copies spreads over many blocks. The blocks (a
fixed number for each old shard, whatever the data's size) realise the flow, and
only shards that gain or lose a block are written again.

Defined cases: a null text has no bytes; null ids and repeated rows are documents like others;
an empty table has no transfers; of equal costs, the arc of lower numbers is taken.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credtrail.plans.ranking import numbered

#: Bytes that a document takes besides its text.
HEADER_BYTES = 8
#: Blocks of each old shard; their size bounds how uneven the new ones may be.
BLOCKS_PER_SHARD = 1024


def document_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + HEADER_BYTES


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def minimum_cost_flow(supply: list[int], demand: list[int], cost=None) -> dict[tuple[int, int], int]:
    """Units from old shard i to new shard j; both lists have the same sum. A unit costs
    ``cost(i, j)``, by default 1 if it moves (i != j). Shortest augmenting paths with
    potentials on a graph of ``len(supply) + len(demand) + 2`` nodes."""
    cost = cost or (lambda i, j: int(i != j))
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    arcs: list[list[int]] = []  # to, capacity, cost; the arc back is at index ^ 1
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, capacity: int, price: int) -> None:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            out[x].append(len(arcs))
            arcs.append([y, c, p])

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
        for j in range(m):
            arc(i, n + j, s, cost(i, j))
    for j, d in enumerate(demand):
        arc(n + j, sink, d, 0)
    potential = [0] * (n + m + 2)
    while True:
        far, came = {source: 0}, {}
        heap = [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k in out[a]:
                b, capacity, price = arcs[k]
                to = d + price + potential[a] - potential[b]
                if capacity > 0 and to < far.get(b, 1 << 62):
                    far[b], came[b] = to, k
                    heapq.heappush(heap, (to, b))
        if sink not in far:
            break
        for a in range(n + m + 2):
            potential[a] += min(far.get(a, far[sink]), far[sink])
        path, at = [], sink
        while at != source:
            path.append(came[at])
            at = arcs[came[at] ^ 1][0]
        amount = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= amount
            arcs[k ^ 1][1] += amount
    return {
        (i, arcs[k][0] - n): arcs[k ^ 1][1]
        for i in range(n)
        for k in out[i]
        if k % 2 == 0 and arcs[k ^ 1][1] > 0
    }


def block_transfers(blocks: list[tuple[int, int, int]], capacities: list[int]) -> dict[tuple[int, int], int]:
    """New shard of each ``(old shard, block)``, given ``(old shard, block, bytes)``.

    Blocks realise the flow, the largest first, each on the arc of its old shard that is
    furthest from filled. What blocks overshoot on one arc is taken off the next ones, so a
    shard is off by about one block, however many arcs end in it."""
    old = max((b[0] for b in blocks), default=-1) + 1
    supply = [0] * old
    for i, _, size in blocks:
        supply[i] += size
    flow = minimum_cost_flow(supply, capacities)
    room = list(capacities)
    target = {}
    for i in range(old):
        left = {j: x for (a, j), x in flow.items() if a == i}
        mine = sorted((b for b in blocks if b[0] == i), key=lambda b: (-b[2], b[1]))
        for _, block, size in mine:
            j = max(left, key=lambda j: (left[j], j == i, -j))
            target[i, block] = j
            left[j] -= size
            room[j] -= size
    # Even out by single small blocks where the sum over the arcs is still off.
    by_shard: dict[int, list[tuple[int, int, int]]] = {}
    for i, block, size in blocks:
        by_shard.setdefault(target[i, block], []).append((size, i, block))
    for mine in by_shard.values():
        mine.sort(reverse=True)
    for _ in range(len(blocks)):
        low, high = min(range(len(room)), key=room.__getitem__), max(range(len(room)), key=room.__getitem__)
        gap = room[high] - room[low]
        fit = next((b for b in by_shard.get(low, ()) if 0 < b[0] < gap), None)
        if fit is None:
            break
        by_shard[low].remove(fit)
        by_shard.setdefault(high, []).append(fit)
        by_shard[high].sort(reverse=True)
        room[low] += fit[0]
        room[high] -= fit[0]
        target[fit[1], fit[2]] = high
    return target


def reshard(docs: DataFrame, old_shard: str, shards: int) -> tuple[DataFrame, list[int]]:
    """``docs`` with ``size`` and ``shard``, and the shards whose files change.

    ``old_shard`` is an integer column from 0 on; its values are few, as shards are."""
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(BLOCKS_PER_SHARD)).cast("int")
    sized = docs.withColumn("size", document_size(F.col("text"))).withColumn("_block", block)
    found = sized.groupBy(old_shard, "_block").agg(F.sum("size").alias("bytes"))
    rows = [tuple(r) for r in found.collect()]
    target = block_transfers(rows, even_capacities(sum(r[2] for r in rows), shards))
    spark = docs.sparkSession
    moves = spark.createDataFrame(
        [(i, b, j) for (i, b), j in sorted(target.items())], "_from int, _part int, shard int"
    )
    placed = sized.join(
        F.broadcast(moves),  # at most old shards * BLOCKS_PER_SHARD rows of integers
        (F.col(old_shard) == F.col("_from")) & (F.col("_block") == F.col("_part")),
    )
    moved = {x for (i, _), j in target.items() if i != j for x in (i, j)}
    return placed.drop("_from", "_part", "_block"), sorted(moved)


def rewrite(placed: DataFrame, changed: list[int], path: str, files_per_shard: int = 4) -> None:
    """Write the shards that change, a folder for each; the others keep their files."""
    spread = F.pmod(F.xxhash64("doc_id", "size"), F.lit(files_per_shard))
    (
        placed.where(F.col("shard").isin(changed))
        .repartition("shard", spread)
        .write.partitionBy("shard")
        .parquet(path)
    )


def with_slots(placed: DataFrame) -> DataFrame:
    """Add ``slot``: the place in the shard, from 0, by id, then size and checksum."""
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "size", "text_crc32")]
    return numbered(placed, order, ["shard"]).withColumn("slot", F.col("position") - 1).drop("position")
