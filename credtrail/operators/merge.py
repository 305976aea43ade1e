"""Current files and history as one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credtrail.functions.keywords import keyword_name
from credtrail.operators.dedup import first_findings
from credtrail.operators.scan import secret_keys
from credtrail.rules import Rules


def both_sources(current: DataFrame, history: DataFrame) -> DataFrame:
    """Union with ``src_rank``: 0 for current files, 1 for history."""
    return current.withColumn("src_rank", F.lit(0)).unionByName(
        history.withColumn("src_rank", F.lit(1)), allowMissingColumns=True
    )


def findings_union(current: DataFrame, history: DataFrame) -> DataFrame:
    """One stream of findings over both sources, current first."""
    return first_findings(both_sources(current, history))


def _of(source: int, column: Column) -> Column:
    return F.when(F.col("src_rank") == source, column)


def merged_values(current: DataFrame, history: DataFrame) -> DataFrame:
    """Value rows of both sources in one aggregate.

    A value of a current file counts once however often it occurs; only
    history counts repeats. A value on both sides keeps the current dates, but
    its occurrences add up.
    """
    both = both_sources(current, history)
    in_current = F.max(_of(0, F.lit(1)))
    history_hits = F.coalesce(F.sum(_of(1, F.col("hits"))), F.lit(0))
    grouped = both.groupBy(*secret_keys(both), "value").agg(
        in_current.isNotNull().alias("in_current"),
        F.max(_of(1, F.lit(1))).isNotNull().alias("in_history"),
        (F.coalesce(in_current, F.lit(0)) + history_hits).alias("occurrences"),
        history_hits.alias("history_occurrences"),
        F.coalesce(F.min(_of(0, F.col("date"))), F.min("date")).alias("first_seen"),
        F.coalesce(F.max(_of(0, F.col("date"))), F.max("date")).alias("last_seen"),
        F.min(_of(1, F.col("date"))).alias("history_first"),
        F.max(_of(1, F.col("date"))).alias("history_last"),
        F.min(_of(0, F.col("kw_first"))).alias("kw_current"),
        F.min(_of(1, F.col("kw_first"))).alias("kw_history"),
    )
    return grouped


def merged_secrets(current: DataFrame, history: DataFrame, rules: Rules) -> DataFrame:
    """Secrets of both sources: values united, occurrences added, the type of
    the current side if it knows the secret."""
    rows = merged_values(current, history)
    grouped = rows.groupBy(*secret_keys(rows)).agg(
        F.count("*").alias("change_count"),
        F.sum("occurrences").alias("total_occurrences"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.coalesce(F.min("kw_current"), F.min("kw_history")).alias("_kw"),
    )
    return grouped.withColumn("type", keyword_name(F.col("_kw"), rules)).drop("_kw")


def merged_secrets_history_wins(
    current: DataFrame, history: DataFrame, rules: Rules
) -> DataFrame:
    """As :func:`merged_secrets`, but a secret known to history is taken from
    there as a whole."""
    rows = merged_values(current, history)
    n_history = F.count_if("in_history")
    known = n_history > 0
    grouped = rows.groupBy(*secret_keys(rows)).agg(
        F.when(known, n_history).otherwise(F.count("*")).alias("change_count"),
        F.when(known, F.sum("history_occurrences"))
        .otherwise(F.sum("occurrences"))
        .alias("total_occurrences"),
        F.when(known, F.min("history_first")).otherwise(F.min("first_seen")).alias("first_seen"),
        F.when(known, F.max("history_last")).otherwise(F.max("last_seen")).alias("last_seen"),
        F.when(known, F.min("kw_history")).otherwise(F.min("kw_current")).alias("_kw"),
    )
    return grouped.withColumn("type", keyword_name(F.col("_kw"), rules)).drop("_kw")


def merged_summary(current: DataFrame, history: DataFrame, rules: Rules) -> DataFrame:
    """Totals of the merged scan: a value of both sides counts once."""
    rows = merged_secrets(current, history, rules)
    return rows.agg(
        F.count("*").alias("secrets_found"),
        F.coalesce(F.sum("change_count"), F.lit(0)).alias("total_values"),
        F.coalesce(F.sum("total_occurrences"), F.lit(0)).alias("total_occurrences"),
    )


def merged_summary_history_wins(current: DataFrame, history: DataFrame, rules: Rules) -> DataFrame:
    """Totals when history wins: the values of both scans are added up, also those of secrets
    that only one of them gives to the result."""
    rows = merged_secrets_history_wins(current, history, rules)
    values = merged_values(current, history).agg(
        (F.count_if("in_current") + F.count_if("in_history")).alias("n")
    )
    return rows.agg(
        F.count("*").alias("secrets_found"),
        F.coalesce(F.sum("total_occurrences"), F.lit(0)).alias("total_occurrences"),
    ).select("secrets_found", values.scalar().alias("total_values"), "total_occurrences")


def merged_authors(current: DataFrame, history: DataFrame) -> DataFrame:
    """Authors of the merged secrets, one row each."""
    keys = [*secret_keys(history), "author"]
    return current.select(*keys).unionByName(history.select(*keys)).distinct()


def still_live(current: DataFrame, history: DataFrame) -> DataFrame:
    """Values of history that a current file still holds."""
    rows = merged_values(current, history)
    live = rows.where(F.col("in_current") & F.col("in_history"))
    return live.select(
        *secret_keys(rows),
        "value",
        "history_occurrences",
        F.col("history_first").alias("first_seen"),
        F.col("history_last").alias("last_seen"),
    )


def only_in_history(current: DataFrame, history: DataFrame) -> DataFrame:
    """Values of history that no current file holds any more."""
    rows = merged_values(current, history)
    gone = rows.where(~F.col("in_current"))
    return gone.select(*secret_keys(rows), "value", "history_occurrences")
