"""Secrets with their histories as arrays, and the CSV table.

A list is cut into parts of about ``part_size`` entries, so no row and no task
holds an unbounded list. Nearly all secrets have the one part 0; a hot one goes
over several rows that together hold everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credtrail.functions.dates import days_between, local_day
from credtrail.functions.text import mask
from credtrail.operators.aggregate import date_range, secrets, value_commits
from credtrail.operators.merge import merged_secrets, merged_secrets_history_wins
from credtrail.operators.scan import secret_keys
from credtrail.plans.ranking import numbered
from credtrail.plans.sizing import broadcast_if_small
from credtrail.plans.storage import stored
from credtrail.rules import Rules

PART_SIZE = 10_000


def _part(weight: Column, size: int) -> Column:
    return F.floor((F.col("position") - weight) / F.lit(size)).alias("part")


def iso_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd'T'HH:mm:ssXXX")


def _histories(grain: DataFrame, keys: list[str], part_size: int) -> DataFrame:
    """``(*keys, part, history)`` of rows as :func:`credtrail.operators.aggregate.value_commits`
    gives them. With ``src_rank`` the values of the first source come before those of the second."""
    lead = ["src_rank"] if "src_rank" in grain.columns else []
    # A commit with very many occurrences becomes several rows of bounded weight.
    steps = F.sequence(F.lit(0), F.floor((F.col("occurrences") - 1) / F.lit(part_size)))
    grain = grain.withColumn("_step", F.explode(steps)).withColumn(
        "_times",
        F.least(F.col("occurrences") - F.col("_step") * part_size, F.lit(part_size)),
    )
    order = [F.col(c).asc() for c in (*lead, "value", "first_seen", "commit", "author", "_step")]
    rows = numbered(grain, order, keys, weight=F.col("_times"))
    rows = rows.select("*", _part(F.col("_times"), part_size))

    raw = "first_raw" in rows.columns
    first = F.min_by("first_raw", "first_seen") if raw else iso_text(F.min("first_seen"))
    last = F.max_by("last_raw", "last_seen") if raw else iso_text(F.max("last_seen"))
    commits = F.array_sort(
        F.collect_list(
            F.struct("first_seen", "commit", "_step", F.col("_times").cast("int").alias("n"))
        )
    )
    per_value = rows.groupBy(*keys, "part", *lead, "value").agg(
        F.flatten(F.transform(commits, lambda c: F.array_repeat(c["commit"], c["n"]))).alias(
            "commits"
        ),
        F.sort_array(F.collect_set("author")).alias("authors"),
        F.min("first_seen").alias("_at"),
        first.alias("firstSeen"),
        last.alias("lastSeen"),
    )
    entry = F.struct(
        *lead,
        "_at",
        "value",
        mask(F.col("value")).alias("maskedValue"),
        "commits",
        "authors",
        "firstSeen",
        "lastSeen",
    )
    history = F.transform(
        F.array_sort(F.collect_list(entry)),
        lambda h: F.struct(
            h["value"].alias("value"),
            h["maskedValue"].alias("maskedValue"),
            h["commits"].alias("commits"),
            h["authors"].alias("authors"),
            h["firstSeen"].alias("firstSeen"),
            h["lastSeen"].alias("lastSeen"),
        ),
    )
    return per_value.groupBy(*keys, "part").agg(history.alias("history"))


def _with_totals(lists: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a nested result; each says how many rows its secret has."""
    n_parts = lists.groupBy(*keys).agg((F.max("part") + 1).alias("parts"))
    totals = totals.select(
        *keys,
        "type",
        F.col("change_count").alias("changeCount"),
        F.col("total_occurrences").alias("totalOccurrences"),
    )
    return totals.join(lists, keys).join(n_parts, keys).select(
        *keys, "type", "changeCount", "totalOccurrences", "authors", "history", "part", "parts"
    )


def nested_secrets(found: DataFrame, rules: Rules, part_size: int = PART_SIZE) -> DataFrame:
    """The result file of a scan: one row per secret (and part) with its
    ``history``; a commit is listed once per occurrence."""
    keys = secret_keys(found)
    histories = _histories(value_commits(found), keys, part_size)
    authors = F.array_sort(
        F.array_distinct(F.flatten(F.transform("history", lambda h: h["authors"])))
    )
    return _with_totals(histories.withColumn("authors", authors), secrets(found, rules), keys)


def merged_nested(
    current: DataFrame,
    history: DataFrame,
    rules: Rules,
    part_size: int = PART_SIZE,
    history_wins: bool = False,
) -> DataFrame:
    """As :func:`nested_secrets`, for current files and history as one scan.

    Values of the current files come first, each with the one commit ``current``; of history
    come the values that no current file holds. Authors are those of both sides.
    With ``history_wins`` a secret known to history is taken from there as a whole. What is
    compared between the sides is their values, counted once each, not their findings.
    """
    keys = secret_keys(history)
    first = current.groupBy(*keys, "value", "commit", "author").agg(
        F.lit(1).cast("bigint").alias("occurrences"),
        *date_range(current),
    )
    first = stored(first, "current-values")
    grain = stored(value_commits(history), "history-values")
    if history_wins:
        totals = merged_secrets_history_wins(current, history, rules)
        known = stored(grain.select(*keys).distinct(), "known-secrets")
        first = first.join(broadcast_if_small(known), keys, "left_anti")
        authors = first.select(*keys, "author").unionByName(grain.select(*keys, "author")).distinct()
    else:
        totals = merged_secrets(current, history, rules)
        authors = first.select(*keys, "author").unionByName(grain.select(*keys, "author")).distinct()
        known = stored(first.select(*keys, "value").distinct(), "known-values")
        grain = grain.join(broadcast_if_small(known), [*keys, "value"], "left_anti")
    both = first.withColumn("src_rank", F.lit(0)).unionByName(
        grain.withColumn("src_rank", F.lit(1)), allowMissingColumns=True
    )
    histories = _histories(both, keys, part_size)
    listed = numbered(authors, [F.col("author").asc()], keys).select("*", _part(F.lit(1), part_size))
    listed = listed.groupBy(*keys, "part").agg(F.sort_array(F.collect_list("author")).alias("authors"))
    # A secret may have more parts of authors than of values, or the other way round.
    lists = histories.join(listed, [*keys, "part"], "full").withColumns(
        {c: F.coalesce(c, F.array()) for c in ("authors", "history")}
    )
    return _with_totals(lists, totals, keys)


def csv_view(found: DataFrame, rules: Rules, part_size: int = PART_SIZE) -> DataFrame:
    """The 11 columns of the secrets CSV, ``Part`` and ``Parts``.

    Authors and masked values of a secret are numbered together and regrouped
    by part; the values come by first appearance, as in the history.
    """
    keys = secret_keys(found)
    zero = F.lit("0001-01-01").cast(found.schema["date"].dataType)
    authors = (
        found.select(*keys, "author")
        .distinct()
        .select(*keys, F.lit("a").alias("kind"), zero.alias("at"), F.col("author").alias("text"))
    )
    seen = (
        found.groupBy(*keys, "value")
        .agg(F.min("date").alias("at"))
        .select(*keys, F.lit("v").alias("kind"), "at", F.col("value").alias("text"))
    )
    items = numbered(
        authors.unionByName(seen), [F.col("at").asc(), F.col("text").asc()], [*keys, "kind"]
    ).select("*", _part(F.lit(1), part_size))

    def listing(kind: str, shown: Column, glue: str) -> Column:
        chosen = F.when(F.col("kind") == kind, F.struct("position", shown.alias("text")))
        texts = F.transform(F.array_sort(F.collect_list(chosen)), lambda c: c["text"])
        return F.array_join(texts, glue)

    lists = items.groupBy(*keys, "part").agg(
        listing("a", F.col("text"), ", ").alias("Authors"),
        listing("v", mask(F.col("text")), " | ").alias("Values"),
    )
    n_parts = lists.groupBy(*keys).agg((F.max("part") + 1).alias("parts"))
    rows = secrets(found, rules).join(lists, keys).join(n_parts, keys)
    raw = "first_raw" in rows.columns
    first = local_day(F.col("first_raw")) if raw else F.to_date("first_seen").cast("string")
    last = local_day(F.col("last_raw")) if raw else F.to_date("last_seen").cast("string")
    return rows.select(
        *(c for c in keys if c not in ("file", "key")),
        F.col("file").alias("File"),
        F.col("key").alias("Key"),
        F.col("type").alias("Type"),
        F.col("change_count").alias("ChangeCount"),
        F.col("total_occurrences").alias("TotalOccurrences"),
        "Authors",
        F.col("author_count").alias("AuthorCount"),
        first.alias("FirstSeen"),
        last.alias("LastSeen"),
        days_between(F.col("first_seen"), F.col("last_seen")).alias("DaysActive"),
        "Values",
        F.col("part").alias("Part"),
        F.col("parts").alias("Parts"),
    )
