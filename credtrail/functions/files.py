"""Predicates on file paths and sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from credtrail.functions.text import java_quote
from credtrail.rules import Rules

# Fixed value: larger files are not read.
MAX_FILE_BYTES = 1024 * 1024


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def matches_glob(path: Column, glob: str) -> Column:
    """The four rules for an ignored-file entry."""
    if "**" in glob:
        return path.startswith(glob.split("**", 1)[0])
    if glob.startswith("*."):
        return path.endswith(glob[1:])
    if glob.endswith("/"):
        return path.startswith(glob)
    return path == F.lit(glob)


def glob_regex(glob: str) -> str:
    """The rule of :func:`matches_glob` as a regex, to test a whole list at once."""
    if "**" in glob:
        return "^" + java_quote(glob.split("**", 1)[0])
    if glob.startswith("*."):
        return java_quote(glob[1:]) + r"\z"
    if glob.endswith("/"):
        return "^" + java_quote(glob)
    return "^" + java_quote(glob) + r"\z"


def _any_regex(path: Column, parts: list[str]) -> Column:
    return path.rlike("|".join(parts)) if parts else F.lit(False)


def is_ignored_file(path: Column, rules: Rules) -> Column:
    return _any_regex(path, [glob_regex(g) for g in rules.ignored_files])


def has_excluded_extension(path: Column, rules: Rules) -> Column:
    return _any_regex(path, [java_quote(e) + r"\z" for e in rules.excluded_extensions])


def is_scanned_file(path: Column, rules: Rules) -> Column:
    """Neither ignored nor excluded. Uses the path only, so it is applied below
    any explode, and on the file listing if the path is file metadata."""
    parts = [glob_regex(g) for g in rules.ignored_files]
    parts += [java_quote(e) + r"\z" for e in rules.excluded_extensions]
    return ~_any_regex(path, list(dict.fromkeys(parts)))


def glob_rule_columns(glob: Column) -> dict[str, Column]:
    """The four rules for a glob that is itself a column (ignore lists as tables)."""
    star2 = glob.contains("**")
    suffix = ~star2 & glob.startswith("*.")
    prefix = ~star2 & ~suffix & glob.endswith("/")
    return {
        "how": F.when(star2 | prefix, "prefix").when(suffix, "suffix").otherwise("equal"),
        "text": F.when(star2, F.split_part(glob, F.lit("**"), F.lit(1)))
        .when(suffix, F.substr(glob, F.lit(2)))
        .otherwise(glob),
    }
