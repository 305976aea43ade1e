"""Values, secrets, totals and statistics.

Everything here is a sum, count, minimum or maximum, so Spark combines rows
before each shuffle and one hot file, key or value costs no more than another.
Lists of any length stay rows (``value_commits``, ``secret_authors``); the
``nested`` module turns them into arrays of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credtrail.functions.keywords import keyword_name
from credtrail.functions.text import fingerprint, mask
from credtrail.functions.values import is_usable_value, reject_reason
from credtrail.operators.dedup import secret_authors
from credtrail.operators.scan import CURRENT, secret_keys
from credtrail.rules import Rules, keyword_table


def hidden(df: DataFrame, reveal: bool = False) -> DataFrame:
    """Replace ``value`` by its mask and its fingerprint, unless ``reveal``."""
    value = F.col("value")
    rest = [c for c in df.columns if c != "value"]
    shown = [value] if reveal else []
    return df.select(
        *rest, *shown, mask(value).alias("masked"), fingerprint(value).alias("value_hash")
    )


def date_range(df: DataFrame) -> list[Column]:
    """First and last instant and, if known, their texts with the author's offset.

    The texts need a sort-based aggregate, so they are only asked for if there.
    """
    out = [F.min("date").alias("first_seen"), F.max("date").alias("last_seen")]
    if "date_raw" in df.columns:
        out.append(F.min_by("date_raw", "date").alias("first_raw"))
        out.append(F.max_by("date_raw", "date").alias("last_raw"))
    return out


def values(found: DataFrame) -> DataFrame:
    """Per secret and value: occurrences (keyword times line), distinct commits
    and authors, lowest keyword, first and last seen."""
    return found.groupBy(*secret_keys(found), "value").agg(
        F.sum("hits").alias("occurrences"),
        F.count_distinct("commit").alias("commit_count"),
        F.count_distinct("author").alias("author_count"),
        F.min("kw_first").alias("kw_first"),
        *date_range(found),
    )


def value_commits(found: DataFrame) -> DataFrame:
    """The commits of each value, one row each with its occurrences."""
    keys = [*secret_keys(found), "value", "commit", "author"]
    return found.groupBy(*keys).agg(F.sum("hits").alias("occurrences"), *date_range(found))


def secrets(found: DataFrame, rules: Rules) -> DataFrame:
    """Per (file, key): distinct values (``change_count``), occurrences, authors,
    type (its lowest keyword), first and last seen."""
    keys = secret_keys(found)
    grouped = found.groupBy(*keys).agg(
        F.count_distinct("value").alias("change_count"),
        F.sum("hits").alias("total_occurrences"),
        F.count_distinct("author").alias("author_count"),
        F.count_distinct("commit").alias("commit_count"),
        F.min("kw_first").alias("kw_first"),
        *date_range(found),
    )
    return grouped.withColumn("type", keyword_name(F.col("kw_first"), rules)).drop("kw_first")


def secrets_of_values(value_rows: DataFrame, rules: Rules) -> DataFrame:
    """As :func:`secrets`, from value rows, without the author and commit counts."""
    first, last = F.min("first_seen"), F.max("last_seen")
    grouped = value_rows.groupBy(*secret_keys(value_rows)).agg(
        F.count("*").alias("change_count"),
        F.sum("occurrences").alias("total_occurrences"),
        F.min("kw_first").alias("kw_first"),
        first.alias("first_seen"),
        last.alias("last_seen"),
    )
    return grouped.withColumn("type", keyword_name(F.col("kw_first"), rules)).drop("kw_first")


def by_change_count(secret_rows: DataFrame) -> DataFrame:
    return secret_rows.orderBy(F.col("change_count").desc(), "file", "key")


def with_group_type(df: DataFrame, rules: Rules) -> DataFrame:
    """Add ``type_group``: the first group with a keyword equal to the key."""
    table = keyword_table(df.sparkSession, rules)
    first = table.groupBy(F.col("keyword").alias("key")).agg(
        F.min_by("group", "kw_idx").alias("_group")
    )
    # The keyword list is part of the rules, a few dozen rows.
    joined = df.join(F.broadcast(first), "key", "left")
    group = F.coalesce("_group", F.lit("unknown")).alias("type_group")
    return joined.select(*df.columns, group)


def scan_summary(secret_rows: DataFrame) -> DataFrame:
    return secret_rows.agg(
        F.count("*").alias("secrets_found"),
        F.coalesce(F.sum("change_count"), F.lit(0)).alias("total_values"),
        F.coalesce(F.sum("total_occurrences"), F.lit(0)).alias("total_occurrences"),
    )


def unique_values(found: DataFrame, exact: bool = True) -> DataFrame:
    """Values per secret added up, and distinct values overall."""
    keys = secret_keys(found)
    if exact:
        pairs = found.select(*keys, "value").distinct()
        return pairs.agg(
            F.count("*").alias("unique_values"),
            F.count_distinct("value").alias("global_unique_values"),
        )
    return found.agg(
        F.approx_count_distinct(F.struct(*keys, "value"), 0.01).alias("unique_values"),
        F.approx_count_distinct("value", 0.01).alias("global_unique_values"),
    )


# Size of a value sketch: 2 ** 12 registers, about 2 percent off.
SKETCH_SIZE = 12


def value_sketches(found: DataFrame, *by: str) -> DataFrame:
    """``(*by, values, secret_values)``: sketches of the distinct values and of the distinct
    (file, key, value), a few kilobytes a row. Kept per day, they give the counts of any
    range of days without looking at a finding again."""
    key = F.xxhash64(*secret_keys(found), "value")
    return found.groupBy(*by).agg(
        F.hll_sketch_agg("value", F.lit(SKETCH_SIZE)).alias("values"),
        F.hll_sketch_agg(key, F.lit(SKETCH_SIZE)).alias("secret_values"),
    )


def sketched_values(sketches: DataFrame, *by: str) -> DataFrame:
    """Estimates of both counts per ``by``, from finer sketches."""
    grouped = sketches.groupBy(*by).agg(
        F.hll_union_agg("values").alias("_v"), F.hll_union_agg("secret_values").alias("_s")
    )
    return grouped.select(
        *by,
        F.hll_sketch_estimate("_s").alias("unique_values"),
        F.hll_sketch_estimate("_v").alias("global_unique_values"),
    )


def entry_counts(entries: DataFrame, by: str) -> DataFrame:
    """Findings per author, file, type or key."""
    return entries.groupBy(by).agg(F.count("*").alias("count"))


def secret_counts(secret_rows: DataFrame, by: str) -> DataFrame:
    """Secrets per file or type."""
    return secret_rows.groupBy(by).agg(F.count("*").alias("count"))


def author_counts(found: DataFrame) -> DataFrame:
    """Secrets per author; a secret counts for each of its authors."""
    return secret_authors(found).groupBy("author").agg(F.count("*").alias("count"))


def top(counts: DataFrame, by: str, size: int | None = 10) -> DataFrame:
    ordered = counts.orderBy(F.col("count").desc(), by)
    return ordered if size is None else ordered.limit(size)


def with_type(found: DataFrame, rules: Rules) -> DataFrame:
    return found.withColumn("type", keyword_name(F.col("kw_first"), rules))


def detect_source(found: DataFrame) -> DataFrame:
    """Where the usable findings come from: current, history or both."""
    usable = found.where(is_usable_value(F.col("value")))
    commit = F.coalesce(F.col("commit"), F.lit(""))
    seen = usable.agg(
        F.coalesce(F.bool_or(commit == CURRENT), F.lit(False)).alias("has_current"),
        F.coalesce(F.bool_or(~commit.isin(CURRENT, "")), F.lit(False)).alias("has_history"),
    )
    only_current = F.col("has_current") & ~F.col("has_history")
    only_history = F.col("has_history") & ~F.col("has_current")
    source = F.when(only_current, "current").when(only_history, "history").otherwise("both")
    return seen.withColumn("source", source)


def in_date_range(found: DataFrame, since: Column, until: Column) -> DataFrame:
    return found.where((F.col("date") >= since) & (F.col("date") < until))


def gate(found: DataFrame) -> DataFrame:
    return found.agg((F.count("*") > 0).alias("found"), F.count("*").alias("n"))


def reject_breakdown(extractions: DataFrame, rules: Rules, *by: str) -> DataFrame:
    """How many extractions each value test drops; ``kept`` for the rest."""
    reason = F.coalesce(reject_reason(F.col("value"), rules), F.lit("kept"))
    return extractions.groupBy(*by, reason.alias("reason")).agg(F.count("*").alias("n"))


def keyword_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("keyword").agg(F.count("*").alias("n"))
