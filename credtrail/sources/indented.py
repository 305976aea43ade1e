"""Scan results as other tools write them: one indented JSON document, of any size.

In such a document every scalar has a line of its own, and its depth says what it is. So the
lines are read in parallel like any text; each takes the secret and the value that it belongs to
from the lines before (:mod:`credtrail.plans.carry`). Nothing is put together into one
document or one list: a secret with millions of commits is as many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credtrail.functions.dates import instant
from credtrail.plans.carry import carried

# The fields of the exchange format, by their depth in steps of indentation.
SECRET_FIELDS = ("file", "key", "type", "changeCount", "totalOccurrences", "part", "parts")
VALUE_FIELDS = ("value", "maskedValue", "firstSeen", "lastSeen")
TOP_FIELDS = ("repository", "branch", "secretsFound", "totalValues", "scanDate")

_CARRIED = ("file", "key", "type", "value", "_list")


def _scalar(text: Column) -> Column:
    """The value of one JSON scalar, as text; null if it is none."""
    options = {"mode": "PERMISSIVE"}
    return F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", options), F.lit(0))


def read_indented(spark: SparkSession, path: str, indent: int = 2) -> DataFrame:
    """``path, file, key, type, value, name, text, bad``: one row per scalar below ``secrets``.

    ``name`` is the field, or the list that the scalar stands in (``commits``, ``authors``;
    ``secretAuthors`` for those of the secret). Lines that fit nowhere are ``bad``. A file may
    hold several documents one after the other.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    line = F.regexp_replace("value", r"\s+\z", "")
    spaces = F.length(line) - F.length(F.ltrim(line))
    lines = raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.when(spaces % indent == 0, spaces / indent).otherwise(-1).cast("int").alias("_depth"),
        F.regexp_replace(F.ltrim(line), r",\z", "").alias("_body"),
    ).where(F.col("_body") != "")
    field = F.regexp_extract("_body", r'^"(\w+)": ', 1)
    rest = F.regexp_extract("_body", r'(?s)^"\w+": (.*)\z', 1)
    depth = F.col("_depth")
    opens = F.col("_body").isin("{", "[") | rest.isin("{", "[")
    closes = F.col("_body").isin("}", "]")
    empty = rest.isin("[]", "{}", "null")
    item = depth.isin(4, 6) & F.col("_body").startswith('"') & (field == "")
    known = (
        ((depth == 1) & field.isin(*TOP_FIELDS))
        | ((depth == 3) & field.isin(*SECRET_FIELDS))
        | ((depth == 5) & field.isin(*VALUE_FIELDS))
    )
    lines = lines.select("*", field.alias("_field"), F.when(item, F.col("_body")).otherwise(rest).alias("_text"),
                         (known | item).alias("_scalar"), (opens | closes | empty).alias("_frame"))
    starts_secret = (depth == 2) & (F.col("_body") == "{")
    starts_value = (depth == 4) & (F.col("_body") == "{")
    value_of = F.when(F.col("_scalar"), _scalar(F.col("_text")))

    def set_by(name: str, at: int, *resets: Column) -> Column:
        out = F.when((depth == at) & (F.col("_field") == name), F.coalesce(value_of, F.lit("")))
        for r in resets:
            out = out.when(r, "")
        return out.alias(name)

    marked = lines.select(
        "path", "block", "_depth",
        F.when(F.col("_field") != "", F.col("_field")).alias("name"), value_of.alias("text"),
        (F.col("_scalar") & value_of.isNull() & (F.col("_text") != "null") | ~(F.col("_scalar") | F.col("_frame"))).alias("bad"),
        set_by("file", 3, starts_secret), set_by("key", 3, starts_secret), set_by("type", 3, starts_secret),
        set_by("value", 5, starts_secret, starts_value),
        # The list that items stand in, by its depth.
        F.when(depth.isin(3, 5) & opens & (F.col("_field") != ""), F.col("_field")).alias("_list"),
        (F.col("_scalar") & (depth > 1) | ~(F.col("_scalar") | F.col("_frame"))).alias("_keep"),
    )
    rows = carried(marked, _CARRIED, "_keep", "indented")
    in_list = F.when((F.col("_depth") == 4) & (F.col("_list") == "authors"), "secretAuthors").otherwise(F.col("_list"))
    return rows.select("path", "file", "key", "type", "value", F.coalesce("name", in_list).alias("name"), "text", "bad")


def indented_commits(rows: DataFrame) -> DataFrame:
    """One row per listed commit, as :func:`credtrail.sources.records.commits_of_secrets`."""
    return rows.where("name = 'commits' and not bad").select("file", "key", "type", "value", F.col("text").alias("commit"))


def indented_values(rows: DataFrame) -> DataFrame:
    """One row per secret and value, with its number of commits and its dates."""

    def only(name: str) -> Column:
        return F.when(F.col("name") == name, F.col("text"))

    first, last = instant(only("firstSeen")), instant(only("lastSeen"))
    given = F.col("name").isin(*VALUE_FIELDS, "commits")
    return rows.where(given & ~F.col("bad")).groupBy("file", "key", "type", "value").agg(
        F.count(only("commits")).alias("occurrences"),
        F.min(F.when(only("firstSeen").isNotNull(), first)).alias("first_seen"),
        F.max(F.when(only("lastSeen").isNotNull(), last)).alias("last_seen"),
    )


def indented_secrets(rows: DataFrame) -> DataFrame:
    """Secret rows, as :func:`credtrail.sources.records.analyzed_secrets`."""
    return indented_values(rows).groupBy("file", "key", "type").agg(
        F.count("*").alias("change_count"),
        F.sum("occurrences").alias("total_occurrences"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def count_bad_lines(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("lines"), F.count_if("bad").alias("bad_lines"))


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _list_of(items: Column, depth: int) -> Column:
    pad, close = "\n" + "  " * (depth + 1), "\n" + "  " * depth + "]"
    joined = F.array_join(F.transform(items, _quoted), "," + pad)
    return F.when(F.size(items) == 0, "[]").otherwise(F.concat(F.lit("[" + pad), joined, F.lit(close)))


def _object(fields: list[tuple[str, Column]], depth: int) -> Column:
    pad = "\n" + "  " * (depth + 1)
    parts = [F.concat(F.lit(f'"{name}": '), value) for name, value in fields]
    return F.concat(F.lit("{" + pad), F.concat_ws("," + pad, *parts), F.lit("\n" + "  " * depth + "}"))


def indented_documents(nested: DataFrame, repository: str, branch: str, scan_date: str) -> DataFrame:
    """``value``: each row of a nested result as an indented document of its own."""

    def entry(h: Column) -> Column:
        texts = [(n, _quoted(h[n])) for n in ("value", "maskedValue")]
        lists = [(n, _list_of(h[n], 5)) for n in ("commits", "authors")]
        return _object([*texts, *lists, *((n, _quoted(h[n])) for n in ("firstSeen", "lastSeen"))], 4)

    history = F.concat(
        F.lit("[\n        "), F.array_join(F.transform("history", entry), ",\n        "), F.lit("\n      ]")
    )
    numbers = [(n, F.col(n).cast("string")) for n in ("changeCount", "totalOccurrences")]
    secret = _object(
        [*((n, _quoted(F.col(n))) for n in ("file", "key", "type")), *numbers,
         ("authors", _list_of(F.col("authors"), 3)), ("history", history)], 2,
    )
    top = [(n, _quoted(F.lit(t))) for n, t in (("repository", repository), ("branch", branch))]
    top += [("secretsFound", F.lit("1")), ("totalValues", F.col("changeCount").cast("string"))]
    top.append(("secrets", F.concat(F.lit("[\n    "), secret, F.lit("\n  ]"))))
    top.append(("scanDate", _quoted(F.lit(scan_date))))
    return nested.select(_object(top, 0).alias("value"))
