"""Report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credtrail.functions.text import bar_width, mask, preview, truncate
from credtrail.operators.aggregate import (
    author_counts,
    by_change_count,
    entry_counts,
    scan_summary,
    secret_counts,
    secrets,
    top,
    with_type,
)
from credtrail.operators.dedup import first_findings, secret_authors
from credtrail.operators.scan import secret_keys
from credtrail.rules import Rules


def secret_stats(found: DataFrame, rules: Rules) -> dict[str, DataFrame]:
    """Statistics of a scan result, counted per secret."""
    rows = secrets(found, rules)
    return {
        "summary": scan_summary(rows).select(
            F.col("total_values").alias("total_entries"),
            F.col("secrets_found").alias("unique_secrets"),
            F.col("total_values").alias("unique_values"),
        ),
        "authors": top(author_counts(found), "author"),
        "files": top(secret_counts(rows, "file"), "file"),
        "types": top(secret_counts(rows, "type"), "type", None),
    }


def entry_stats(entries: DataFrame, rules: Rules) -> dict[str, DataFrame]:
    """Statistics of a findings file, counted per entry."""
    typed = entries if "type" in entries.columns else with_type(entries, rules)
    keys = secret_keys(typed)
    return {
        "summary": typed.agg(
            F.count("*").alias("total_entries"),
            F.count_distinct(*keys).alias("unique_secrets"),
            F.count_distinct(*keys, "value").alias("unique_values"),
        ),
        "authors": top(entry_counts(typed, "author"), "author"),
        "files": top(entry_counts(typed, "file"), "file"),
        "types": top(entry_counts(typed, "type"), "type", None),
    }


def stats_long(stats: dict[str, DataFrame]) -> DataFrame:
    """All sections of the statistics as ``(section, name, count)``."""
    totals = stats["summary"].select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit("summary").alias("section"),
                        F.lit(c).alias("name"),
                        F.col(c).cast("bigint").alias("count"),
                    )
                    for c in ("total_entries", "unique_secrets", "unique_values")
                ]
            )
        )
    )
    for section, name in (("authors", "author"), ("files", "file"), ("types", "type")):
        part = stats[section].select(
            F.lit(section).alias("section"), F.col(name).alias("name"), "count"
        )
        totals = totals.unionByName(part)
    return totals


def report_authors(entries: DataFrame, size: int = 10) -> DataFrame:
    """Top authors with the width of their bar, relative to all entries."""
    counts = entry_counts(entries, "author")
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total")).scalar()
    return top(counts, "author", size).select(
        "author", "count", bar_width(F.col("count"), total).alias("bar_width")
    )


def top_with_more(entries: DataFrame, by: str, size: int = 5) -> DataFrame:
    """``section, name, count, remaining``: the most frequent of a column and how many more there are."""
    counts = entry_counts(entries, by)
    more = counts.agg(F.greatest(F.count("*") - size, F.lit(0)).alias("n")).scalar()
    return top(counts, by, size).select(
        F.lit(by).alias("section"), F.col(by).alias("name"), "count", more.alias("remaining")
    )


def report_files(entries: DataFrame, size: int = 10, width: int = 50) -> DataFrame:
    counts = top(entry_counts(entries, "file"), "file", size)
    return counts.select(F.substring("file", 1, width).alias("file"), "count")


def first_texts(rows: DataFrame, keys: list[str], text: str, width: int) -> DataFrame:
    """The sorted texts of each group joined by ``", "``, cut to ``width``.

    Each text but the first takes two characters at least, so ``width`` texts
    always suffice; Spark limits a ranked group before the shuffle.
    """
    order = Window.partitionBy(*keys).orderBy(text)
    ranked = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= width)
    joined = F.array_join(F.sort_array(F.collect_list(text)), ", ")
    return ranked.groupBy(*keys).agg(truncate(joined, width).alias(f"{text}s"))


def top_secrets(found: DataFrame, rules: Rules, size: int) -> DataFrame:
    return by_change_count(secrets(found, rules)).limit(size)


def report_secrets(found: DataFrame, rules: Rules, size: int = 5) -> DataFrame:
    """The secrets that change most and how many are left out."""
    keys = secret_keys(found)
    shown = top_secrets(found, rules, size)
    total = secrets(found, rules).agg(F.count("*").alias("n")).scalar()
    # ``shown`` has at most ``size`` rows.
    chosen = secret_authors(found).join(F.broadcast(shown.select(*keys)), keys, "left_semi")
    names = first_texts(chosen, keys, "author", 67)
    return shown.join(names, keys).select(
        *(c for c in keys if c not in ("file", "key")),
        truncate(F.col("file"), 76).alias("file"),
        truncate(F.col("key"), 71).alias("key"),
        "type",
        "change_count",
        "total_occurrences",
        "authors",
        F.to_date("first_seen").cast("string").alias("first_day"),
        F.to_date("last_seen").cast("string").alias("last_day"),
        F.greatest(total - F.lit(size), F.lit(0)).alias("remaining"),
    )


def report_values(
    found: DataFrame, rules: Rules, size: int = 5, reveal: bool = False
) -> DataFrame:
    """All values of the secrets in the report, one row each."""
    keys = secret_keys(found)
    shown = top_secrets(found, rules, size).select(*keys)
    # ``shown`` has at most ``size`` rows.
    chosen = found.join(F.broadcast(shown), keys, "left_semi")
    rows = chosen.groupBy(*keys, "value").agg(
        F.sum("hits").alias("occurrences"), F.min("date").alias("first_seen")
    )
    pairs = chosen.select(*keys, "value", "author").distinct()
    names = first_texts(pairs, [*keys, "value"], "author", 20)
    value = F.col("value")
    text = truncate(mask(value), 40)
    joined = rows.join(names, [*keys, "value"])
    extra = [preview(value).alias("preview")] if reveal else []
    return joined.select(
        *keys, text.alias("masked"), *extra, F.sha2("value", 256).alias("value_hash"),
        "occurrences", "authors", "first_seen",
    )


def stream_entries(found: DataFrame, rules: Rules) -> DataFrame:
    """The entries a findings file holds: the first finding per value, typed."""
    return with_type(first_findings(found), rules)
