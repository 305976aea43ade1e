"""Ignored files by a glob list that is a table, for example one per repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credtrail.functions.files import glob_rule_columns
from credtrail.plans.sizing import broadcast_if_small
from credtrail.plans.storage import materialized, stored


def without_ignored(
    lines: DataFrame, globs: DataFrame, by: tuple[str, ...] = ()
) -> DataFrame:
    """Drop the files that a glob of the table ``(glob, *by)`` matches.

    Only distinct paths are compared. Paths and globs meet on equal text: a path
    offers its prefixes and suffixes of the lengths that occur in the table. A glob such as
    ``**/x`` has the empty prefix, which every path would offer: it drops all paths of
    its list, and no join is needed for that.
    """
    rules = globs.select(*by, *[c.alias(n) for n, c in glob_rule_columns(F.col("glob")).items()])
    rules = stored(rules.distinct(), "globs")
    of_all = (F.col("how") != "equal") & (F.col("text") == "")
    everything = rules.where(of_all).select(*by).distinct()
    if everything.limit(1).count():
        if not by:
            return lines.where(F.lit(False))
        lines = lines.join(broadcast_if_small(stored(everything, "ignored-lists")), list(by), "left_anti")
        rules = rules.where(~of_all)
    # One row per kind: the lengths that occur, a few dozen numbers.
    sizes = rules.groupBy("how").agg(F.sort_array(F.collect_set(F.length("text"))).alias("sizes"))
    lengths = {r["how"]: r["sizes"] for r in sizes.collect()}

    paths = lines.select(*by, "file").distinct()
    size = F.length("file")

    def offer(how: str, part) -> DataFrame:
        options = F.array(*[F.lit(n) for n in lengths[how]])
        return paths.select(
            *by, "file", F.lit(how).alias("how"),
            F.explode(F.transform(F.filter(options, lambda n: n <= size), part)).alias("text"),
        )

    cuts = {
        "prefix": lambda n: F.substr("file", F.lit(1), n),
        "suffix": lambda n: F.right(F.col("file"), n),
        "equal": lambda n: F.when(n == size, F.col("file")),
    }
    ignored = None
    for how in sorted(lengths):
        part = offer(how, cuts[how])
        ignored = part if ignored is None else ignored.unionByName(part)
    if ignored is None:
        return lines
    ignored = ignored.join(rules, [*by, "how", "text"], "left_semi")
    ignored = materialized(ignored.select(*by, "file").distinct())
    return lines.join(broadcast_if_small(ignored), [*by, "file"], "left_anti")
