"""Partition counts and broadcasts by measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024

# Bookkeeping per row of a hashed relation, a rough upper figure.
ROW_OVERHEAD = 64


def byte_size(df: DataFrame) -> int:
    """Size of a materialized frame, from its text columns and its row count."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(ROW_OVERHEAD))
    width = width + F.lit(8 * len(df.columns))
    return df.agg(F.coalesce(F.sum(width.cast("bigint")), F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` must be materialized. Beyond the limit the join shuffles and
    adaptive execution splits its hot keys."""
    return F.broadcast(df) if byte_size(df) <= limit else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core work when an input has fewer splits than there are cores.

    Large tables have many more splits, and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
