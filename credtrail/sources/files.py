"""Current files of a working tree as a line table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credtrail.functions.files import is_scanned_file
from credtrail.rules import Rules, default_rules


def relative_path(uri: Column, root: str) -> Column:
    """The part of a file URI below ``root``. The URI writes blanks and other characters in
    code; ``root`` is plain, and a plus sign is one in both."""
    path = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    tail = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return F.substr(path, F.locate(tail, path) + F.lit(len(tail)))


def read_file_lines(
    spark: SparkSession,
    root: str,
    rules: Rules | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """``(file, size, line)`` of all text files below ``root``.

    The tests use path and size only; Spark applies them to the file listing, so
    the other files are never opened. Small files share a task.
    """
    rules = rules or default_rules()
    raw = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(root)
    lines = raw.select(
        relative_path(F.col("_metadata.file_path"), root).alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.regexp_replace("value", r"\r\z", "").alias("line"),
    )
    if max_bytes is not None:
        lines = lines.where(F.col("size") <= max_bytes)
    lines = lines.where(~F.concat(F.lit("/"), F.col("file")).contains("/.git/"))
    return lines.where(is_scanned_file(F.col("file"), rules))


def read_file_texts(
    spark: SparkSession, root: str, max_bytes: int | None = None
) -> DataFrame:
    """``(file, size, text)``, whole files, for redaction; with ``max_bytes`` no
    larger ones."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    small = raw if max_bytes is None else raw.where(F.col("length") <= max_bytes)
    texts = small.select(
        relative_path(F.col("_metadata.file_path"), root).alias("file"),
        F.col("length").alias("size"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )
    return texts.where(~F.concat(F.lit("/"), F.col("file")).contains("/.git/"))
