"""Commits that change how often a keyword occurs in a file.

This is what a log search with ``-S<keyword>`` returns: it leaves out commits
that only change a value. Always case-sensitive. Unchanged lines cancel, so the
signed lines of a patch are enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credtrail.functions.files import has_excluded_extension
from credtrail.functions.keywords import holds_any, word_array
from credtrail.functions.text import count_literal
from credtrail.operators.scan import by_keyword
from credtrail.plans.sizing import broadcast_if_small
from credtrail.plans.storage import materialized
from credtrail.rules import Rules


def keyword_deltas(lines: DataFrame, rules: Rules) -> DataFrame:
    """``(commit, file, keyword, touched, delta)`` for keywords in the patch.

    The sums combine before the shuffle, which carries one row per commit, file
    and keyword at most.
    """
    keys = [*(c for c in ("repo",) if c in lines.columns), "commit", "file"]
    words = list(dict.fromkeys(kw for _, _, kw in rules.keywords))
    line = F.col("line")
    kept = lines.where(~has_excluded_extension(F.col("file"), rules))
    kept = kept.where(holds_any(line, words))
    listed = F.filter(word_array(words), lambda w: F.contains(line, w))
    rows = kept.select(*keys, "sign", "line", F.explode(listed).alias("keyword"))
    n = count_literal(line, F.col("keyword"))
    sign = F.when(F.col("sign") == "+", 1).otherwise(-1)
    return rows.groupBy(*keys, "keyword").agg(
        F.sum(n).alias("touched"), F.sum(n * sign).alias("delta")
    )


def pickaxe_commits(lines: DataFrame, rules: Rules) -> DataFrame:
    return keyword_deltas(lines, rules).where(F.col("delta") != 0).drop("touched")


def pickaxe_findings(found: DataFrame, lines: DataFrame, rules: Rules) -> DataFrame:
    """Findings as a per-keyword log search would see them: ``hits`` counts only
    keywords whose commit and file the search returns."""
    changed = materialized(pickaxe_commits(lines, rules))
    on = [c for c in ("repo", "commit", "file", "keyword") if c in changed.columns]
    hits = by_keyword(found.drop("hits", "kw_first"), rules)
    kept = hits.join(broadcast_if_small(changed.select(*on)), on, "left_semi")
    return kept.withColumn("hits", F.lit(1)).withColumnRenamed("kw_idx", "kw_first")
