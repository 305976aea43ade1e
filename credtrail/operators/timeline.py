"""The history of a secret as numbered versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credtrail.operators.scan import secret_keys
from credtrail.plans.ranking import numbered


def secret_timeline(value_rows: DataFrame, by: str = "first_seen") -> DataFrame:
    """Values of each secret by first appearance, with the value before and the
    moment the next one came; or by ``occurrences``, most frequent first."""
    first = F.col("occurrences").desc() if by == "occurrences" else F.col("first_seen").asc()
    rows = numbered(
        value_rows,
        [first, F.col("value").asc()],
        secret_keys(value_rows),
        neighbours={"previous_value": "-value", "replaced_at": "+first_seen"},
    )
    return rows.withColumnRenamed("position", "version")
