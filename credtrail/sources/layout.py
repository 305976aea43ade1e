"""Findings laid out by the day of their commit, so that a range of days reads only its folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_day(found: DataFrame, path: str) -> None:
    """One folder per day below ``path``. Rows are laid out by day and secret, so a day is few
    files, and a day with very many findings is written by many tasks."""
    days = found.withColumn("day", F.to_date("date"))
    days.repartitionByRange("day", "file", "key").write.partitionBy("day").parquet(path)


def read_by_day(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def in_days(found: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings in the ranges ``(since, until)`` of days, ``until`` left out, with the other columns
    of ``ranges``. The days met while the query runs choose the folders that are read; a finding
    in several ranges comes once for each."""
    others = [c for c in ranges.columns if c not in ("since", "until")]
    days = ranges.where(F.col("since") < F.col("until")).select(
        *others, F.explode(F.sequence(F.to_date("since"), F.date_sub(F.to_date("until"), 1))).alias("day")
    )
    return found.join(days, "day")
