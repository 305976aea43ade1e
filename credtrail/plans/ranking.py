"""Running totals inside groups of any size.

A window over a hot group runs in one task. Here the rows are range-partitioned
by group and order, so a hot group spreads over many partitions ("slices"). Each
slice counts on its own and only one small row per slice carries the totals over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credtrail.plans.storage import materialized


def numbered(
    df: DataFrame,
    order: Sequence[Column],
    keys: Sequence[str] = (),
    weight: Column | None = None,
    neighbours: dict[str, str] | None = None,
) -> DataFrame:
    """Add ``position``: the running sum of ``weight`` (1 by default, so a row
    number) within ``keys`` by ``order``.

    ``neighbours`` maps new column names to ``"-name"`` (value of that column in
    the row before) or ``"+name"`` (row after). ``order`` should be total.
    """
    keys = list(keys)
    neighbours = neighbours or {}
    by_key = [F.col(k).asc() for k in keys]
    laid = df.withColumn("_weight", (F.lit(1) if weight is None else weight).cast("bigint"))
    laid = laid.repartitionByRange(*by_key, *order).sortWithinPartitions(*by_key, *order)
    laid = materialized(
        laid.withColumn("_slice", F.spark_partition_id()).withColumn(
            "_place", F.monotonically_increasing_id()
        )
    )

    # Totals of the slices before, for the few groups that span slices.
    seen = sorted({spec[1:] for spec in neighbours.values()})
    edge = F.struct(F.col("_place"), *[F.col(c) for c in seen])
    heads = laid.groupBy("_slice", *keys).agg(
        F.sum("_weight").alias("_total"),
        F.min(edge).alias("_first"),
        F.max(edge).alias("_last"),
    )
    across = Window.partitionBy(*keys).orderBy("_slice")
    heads = heads.select(
        "_slice",
        *keys,
        F.sum("_total").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.lag("_last").over(across).alias("_prev"),
        F.lead("_first").over(across).alias("_next"),
    ).where(F.col("_before").isNotNull() | F.col("_next").isNotNull())

    inside = Window.partitionBy("_slice", *keys).orderBy("_place")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = laid.withColumn("_local", F.sum("_weight").over(running))
    for name, spec in neighbours.items():
        shift = F.lag if spec[0] == "-" else F.lead
        local = local.withColumn(f"_near_{name}", shift(spec[1:]).over(inside))
        local = local.withColumn(
            f"_edge_{name}", shift(F.lit(True)).over(inside).isNull()
        )

    # At most two rows per slice, and the slices are partitions: safe to broadcast.
    heads = heads.withColumnRenamed("_slice", "_h_slice")
    for k in keys:
        heads = heads.withColumnRenamed(k, f"_h_{k}")
    same = F.col("_slice") == F.col("_h_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    joined = local.join(F.broadcast(heads), same, "left")

    near = []
    for name, spec in neighbours.items():
        over = F.col("_prev" if spec[0] == "-" else "_next")[spec[1:]]
        near.append(
            F.when(F.col(f"_edge_{name}"), over).otherwise(F.col(f"_near_{name}")).alias(name)
        )
    position = (F.col("_local") + F.coalesce(F.col("_before"), F.lit(0))).alias("position")
    return joined.select(*df.columns, position, *near)
