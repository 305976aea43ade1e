"""From lines to findings.

A line table has ``file``, ``line`` and optionally ``repo``, ``ref``, ``seq``,
``commit``, ``author``, ``date``, ``date_raw`` and ``sign``. A finding is such a
row plus ``pattern``, ``key``, ``value``, ``hits`` (number of keywords in the
line) and ``kw_first`` (lowest keyword index in the line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credtrail.functions.extract import extracted
from credtrail.functions.files import MAX_FILE_BYTES, is_scanned_file
from credtrail.functions.keywords import (
    has_any_keyword,
    keyword_indexes,
    keyword_name,
    may_match,
)
from credtrail.functions.values import is_ignored_value
from credtrail.rules import Rules, default_rules

CURRENT = "current"


def secret_keys(df: DataFrame) -> list[str]:
    """Columns that identify a secret."""
    return [*(c for c in ("repo",) if c in df.columns), "file", "key"]


def added_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("sign") == "+")


def scanned_files(lines: DataFrame, rules: Rules) -> DataFrame:
    return lines.where(is_scanned_file(F.col("file"), rules))


def small_files(files: DataFrame, size: str = "size", limit: int = MAX_FILE_BYTES) -> DataFrame:
    return files.where(F.col(size) <= limit)


def text_lines(
    texts: DataFrame, text: str, rules: Rules, number: bool = False
) -> DataFrame:
    """One row per line of a text column; texts that cannot match stay out.

    The test sits below the explode by hand: Catalyst would keep it above.
    """
    if all(p.needs is not None for p in rules.patterns):
        kept = texts.where(may_match(F.col(text), rules))
    else:
        kept = texts.where(has_any_keyword(F.col(text), rules))
    others = [c for c in texts.columns if c != text]
    parts = F.split(F.col(text), "\n")
    if number:
        return kept.select(*others, F.posexplode(parts).alias("line_no", "line"))
    return kept.select(*others, F.explode(parts).alias("line"))


def extract(lines: DataFrame, rules: Rules) -> DataFrame:
    """Add pattern, key and value; lines without a match drop out.

    ``inline`` is a barrier: without it Catalyst would copy the regexes into
    every later use of the value.
    """
    found = lines.where(may_match(F.col("line"), rules)).select(
        "*", F.inline(F.array(extracted(F.col("line"), rules)))
    )
    return found.where(F.col("key").isNotNull())


def judged(extractions: DataFrame, rules: Rules) -> DataFrame:
    return extractions.where(~is_ignored_value(F.col("value"), rules))


def findings(lines: DataFrame, rules: Rules | None = None) -> DataFrame:
    """All findings of lines that are already restricted to the wanted files.

    The cheap test for ``=`` or ``:`` comes first, then the keywords, then the
    regexes: each one sees only what is left.
    """
    rules = rules or default_rules()
    line = F.col("line")
    kept = lines.where(may_match(line, rules)).where(has_any_keyword(line, rules))
    found = judged(extract(kept, rules), rules)
    found = found.withColumn("_kws", keyword_indexes(line, rules))
    return found.withColumns({"hits": F.size("_kws"), "kw_first": F.col("_kws")[0]}).drop("_kws")


def scan_history(
    lines: DataFrame, rules: Rules | None = None, ref: str | None = None
) -> DataFrame:
    """Findings of the added lines of patches, of one ref or of all."""
    rules = rules or default_rules()
    if ref is not None:
        lines = lines.where(F.col("ref") == ref)
    return findings(scanned_files(added_lines(lines), rules), rules)


def scan_current(
    lines: DataFrame,
    scan_date: Column,
    rules: Rules | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Findings of current files, under the commit and author ``current``; with
    ``max_bytes``, of files whose ``size`` is not above it.

    ``scan_date`` is a parameter so that a run can be repeated.
    """
    rules = rules or default_rules()
    if max_bytes is not None:
        lines = small_files(lines, limit=max_bytes)
    found = findings(scanned_files(lines, rules), rules)
    return found.withColumns(
        {"commit": F.lit(CURRENT), "author": F.lit(CURRENT), "date": scan_date}
    )


def by_keyword(found: DataFrame, rules: Rules) -> DataFrame:
    """One row per finding and keyword in its line."""
    rows = found.select("*", F.explode(keyword_indexes(F.col("line"), rules)).alias("kw_idx"))
    return rows.withColumn("keyword", keyword_name(F.col("kw_idx"), rules))
