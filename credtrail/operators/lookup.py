"""Keywords from a table of any size: which of them a line contains.

An alternation suits a few thousand words. Here each keyword is found by its rarest
piece: pieces of the lines that pass a sieve meet the pieces of the keywords in an equi-join, and
what meets is compared in full (as values and texts do in :mod:`credtrail.operators.redact`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credtrail.operators.redact import find_values
from credtrail.operators.scan import extract, judged
from credtrail.rules import Rules


def keyword_matches(
    lines: DataFrame, keywords: DataFrame, key: list[str], text: str = "line", case_sensitive: bool = False
) -> DataFrame:
    """``(*key, kw_idx)`` for each row of ``keywords (kw_idx, keyword)`` in a line; a keyword
    listed twice is found twice. ``key`` must be unique among the lines."""
    fold = (lambda c: c) if case_sensitive else F.lower
    listed = keywords.where("keyword <> ''").select("kw_idx", fold(F.col("keyword")).alias("_word"))
    words = listed.select(F.col("_word").alias("value")).distinct()
    texts = lines.select(*key, fold(F.col(text)).alias("_text"))
    found = find_values(texts, words, key, "_text")
    return found.join(listed, F.col("value") == F.col("_word")).select(*key, "kw_idx")


def findings_by_table(
    lines: DataFrame, keywords: DataFrame, rules: Rules, key: list[str]
) -> DataFrame:
    """As :func:`credtrail.operators.scan.findings`, with the keywords of a table in place of those
    of the rules. Lines are matched by the patterns first, which leaves few."""
    found = judged(extract(lines, rules), rules)
    matches = keyword_matches(found, keywords, key, case_sensitive=rules.case_sensitive)
    hits = matches.groupBy(*key).agg(F.count("*").cast("int").alias("hits"), F.min("kw_idx").alias("kw_first"))
    return found.join(hits, key)
