"""First finding per (file, key, value) and the distinct sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credtrail.functions.values import is_usable_value
from credtrail.operators.scan import secret_keys


def first_findings(found: DataFrame) -> DataFrame:
    """Keep the first finding per secret and value: current files before
    history (``src_rank``, if present), then keyword order, then log order (``seq``
    counts in a log file, so ``path`` comes before it, if present).

    An aggregate, so repeats of a hot value collapse before the shuffle. The text of the
    line stays behind: nothing that follows needs it, and it is most of a row.
    """
    keys = [*secret_keys(found), "value"]
    order = [c for c in ("src_rank", "kw_first", "path", "seq") if c in found.columns]
    rest = [c for c in found.columns if c not in (*keys, "line")]
    best = F.min(F.struct(*order, F.struct(*rest).alias("_row"))).alias("_best")
    return found.groupBy(*keys).agg(best).select(*keys, "_best._row.*")


def distinct_values(found: DataFrame) -> DataFrame:
    return found.select("value").distinct()


def usable_values(found: DataFrame) -> DataFrame:
    """Distinct values fit for redaction. Sort with :func:`longest_first`."""
    return found.where(is_usable_value(F.col("value"))).select("value").distinct()


def longest_first(values: DataFrame) -> DataFrame:
    return values.orderBy(F.length("value").desc(), "value")


def distinct_files(found: DataFrame) -> DataFrame:
    return found.where(F.col("file") != "").select("file").distinct()


def value_authors(found: DataFrame) -> DataFrame:
    """Authors of a value, one row each."""
    return found.select(*secret_keys(found), "value", "author").distinct()


def secret_authors(found: DataFrame) -> DataFrame:
    """Authors of a secret, one row each."""
    return found.select(*secret_keys(found), "author").distinct()
