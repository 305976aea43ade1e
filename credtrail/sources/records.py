"""Scan results (nested JSON), findings (JSON lines) and CSV, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credtrail.functions.dates import instant
from credtrail.functions.text import csv_escape, mask
from credtrail.operators.nested import iso_text
from credtrail.plans.ranking import numbered
from credtrail.plans.storage import stored

# The field names of the exchange formats. ``part`` and ``parts`` are ours: a long
# secret goes over several rows, and says so.
FINDING_SCHEMA = (
    "file STRING, `key` STRING, `value` STRING, maskedValue STRING, type STRING, "
    "`commit` STRING, author STRING, `date` STRING"
)

HISTORY_TYPE = (
    "ARRAY<STRUCT<value: STRING, maskedValue: STRING, commits: ARRAY<STRING>, "
    "authors: ARRAY<STRING>, firstSeen: STRING, lastSeen: STRING>>"
)

SECRET_SCHEMA = (
    "file STRING, `key` STRING, type STRING, changeCount BIGINT, totalOccurrences BIGINT, "
    f"authors ARRAY<STRING>, history {HISTORY_TYPE}, part BIGINT, parts BIGINT"
)

SCAN_RESULT_SCHEMA = (
    "repository STRING, branch STRING, secretsFound BIGINT, totalValues BIGINT, "
    f"secrets ARRAY<STRUCT<{SECRET_SCHEMA}>>, scanDate STRING"
)


# -- findings as JSON lines ---------------------------------------------------


def parsed_findings(texts: DataFrame) -> DataFrame:
    """Parse a ``value`` column of JSON lines; ``bad`` tells the unreadable ones."""
    schema = FINDING_SCHEMA + ", _bad STRING"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = texts.select(F.from_json("value", schema, options).alias("_f"))
    names = ["file", "key", "value", "maskedValue", "type", "commit", "author", "date"]
    filled = [F.coalesce(F.col(f"_f.{n}"), F.lit("")).alias(n) for n in names]
    bad = F.col("_f").isNull() | F.col("_f._bad").isNotNull()
    return parsed.select(*filled, bad.alias("bad"))


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a JSON-lines folder, unreadable lines left out. ``date_raw``
    is the text, ``date`` the instant; each entry counts once (``hits``)."""
    good = parsed_findings(spark.read.text(path)).where(~F.col("bad")).drop("bad")
    return as_entries(good)


def as_entries(rows: DataFrame) -> DataFrame:
    return (
        rows.withColumnRenamed("date", "date_raw")
        .withColumn("date", instant(F.col("date_raw")))
        .withColumn("hits", F.lit(1))
    )


def count_bad_findings(spark: SparkSession, path: str) -> DataFrame:
    return parsed_findings(spark.read.text(path)).agg(
        F.count("*").alias("lines"), F.count_if("bad").alias("bad_lines")
    )


def finding_rows(entries: DataFrame) -> DataFrame:
    """The eight text columns of a finding."""
    date = F.col("date_raw") if "date_raw" in entries.columns else iso_text(F.col("date"))
    return entries.select(
        "file", "key", "value", mask(F.col("value")).alias("maskedValue"), "type",
        "commit", "author", date.alias("date"),
    )


def write_findings(entries: DataFrame, path: str) -> None:
    finding_rows(entries).write.json(path)


# -- nested scan results ------------------------------------------------------


def write_secrets(nested: DataFrame, path: str) -> None:
    """One JSON object per secret and part: grows with the data without limit."""
    nested.write.json(path)


def scan_results(
    nested: DataFrame,
    repository: str,
    branch: str,
    scan_date: str,
    result_size: int = 100_000,
) -> DataFrame:
    """A scan in the form other tools read, most changed secrets first.

    Usually one row. When the secrets list more than ``result_size`` commits they
    go over several rows; each is a valid result and carries the totals of all.
    """
    weight = F.aggregate(F.col("history"), F.lit(1), lambda n, h: n + F.size(h["commits"]))
    rows = numbered(
        nested.withColumn("_size", weight),
        [F.col("changeCount").desc(), *(F.col(c).asc() for c in ("file", "key", "part"))],
        weight=F.col("_size"),
    )
    secret = F.struct(
        "file", "key", "type", F.col("changeCount").cast("bigint").alias("changeCount"),
        F.col("totalOccurrences").cast("bigint").alias("totalOccurrences"), "authors", "history",
        F.col("part").cast("bigint").alias("part"), F.col("parts").cast("bigint").alias("parts"),
    )
    chunk = F.floor((F.col("position") - F.col("_size")) / F.lit(result_size))
    listed = F.array_sort(F.collect_list(F.struct("position", secret.alias("secret"))))
    chunks = rows.groupBy(chunk.alias("_chunk")).agg(
        F.transform(listed, lambda x: x["secret"]).alias("secrets")
    )
    whole = rows.where(F.col("part") == 0)
    n_secrets = whole.agg(F.count("*").alias("n")).scalar()
    n_values = whole.agg(F.sum("changeCount").cast("bigint").alias("n")).scalar()
    return chunks.select(
        F.lit(repository).alias("repository"),
        F.lit(branch).alias("branch"),
        n_secrets.alias("secretsFound"),
        n_values.alias("totalValues"),
        "secrets",
        F.lit(scan_date).alias("scanDate"),
    )


def write_scan_results(results: DataFrame, path: str) -> None:
    results.write.json(path)


def _whole_parts(nested: DataFrame) -> DataFrame:
    """Files of other tools have no parts: each row is a whole secret there."""
    return nested.withColumns(
        {"part": F.coalesce("part", F.lit(0).cast("bigint")), "parts": F.coalesce("parts", F.lit(1).cast("bigint"))}
    )


def read_secrets(spark: SparkSession, path: str) -> DataFrame:
    """Secrets of a folder written by :func:`write_secrets`."""
    return _whole_parts(spark.read.schema(SECRET_SCHEMA).json(path))


def incomplete_secrets(nested: DataFrame) -> DataFrame:
    """Secrets of which a part is missing or there twice: ``file, key, n_parts, parts``."""
    counted = nested.groupBy("file", "key").agg(
        F.count("*").alias("n_parts"), F.count_distinct("part").alias("_different"), F.max("parts").alias("parts")
    )
    wrong = (F.col("n_parts") != F.col("parts")) | (F.col("_different") != F.col("parts"))
    return counted.where(wrong).drop("_different")


def read_scan_results(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Secrets of scan results: one result per line, as written here, or with
    line ends inside (``multi_line``), one per file."""
    reader = spark.read.schema(SCAN_RESULT_SCHEMA).option("multiLine", multi_line)
    whole = reader.json(path)
    return _whole_parts(whole.select(F.inline("secrets")))


def values_of_secrets(nested: DataFrame) -> DataFrame:
    """One row per secret and value, with its number of commits."""
    each = nested.select("file", "key", "type", F.explode("history").alias("h"))
    return each.select(
        "file", "key", "type",
        F.col("h.value").alias("value"),
        F.coalesce(F.size("h.commits"), F.lit(0)).alias("occurrences"),
        F.col("h.authors").alias("authors"),
        F.col("h.firstSeen").alias("first_raw"),
        F.col("h.lastSeen").alias("last_raw"),
        instant(F.col("h.firstSeen")).alias("first_seen"),
        instant(F.col("h.lastSeen")).alias("last_seen"),
    )


def analyzed_secrets(nested: DataFrame) -> DataFrame:
    """Secret rows of a nested result. Parts of one secret come together again."""
    rows = values_of_secrets(nested)
    merged = rows.groupBy("file", "key", "type", "value").agg(
        F.sum("occurrences").alias("occurrences"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    return merged.groupBy("file", "key", "type").agg(
        F.count("*").alias("change_count"),
        F.sum("occurrences").alias("total_occurrences"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def commits_of_secrets(nested: DataFrame) -> DataFrame:
    """One row per listed commit: what source detection and cleaning need."""
    each = nested.select("file", "key", "type", F.explode("history").alias("h"))
    return each.select(
        "file", "key", "type", F.col("h.value").alias("value"),
        F.explode_outer("h.commits").alias("commit"),
    )


# -- CSV ----------------------------------------------------------------------


# The columns of the secrets CSV. The last two are ours and only there when a
# secret goes over several rows.
CSV_SCHEMA = (
    "File STRING, Key STRING, Type STRING, ChangeCount BIGINT, TotalOccurrences BIGINT, "
    "Authors STRING, AuthorCount BIGINT, FirstSeen STRING, LastSeen STRING, "
    "DaysActive INT, `Values` STRING"
)
CSV_PARTS = ", Part BIGINT, Parts BIGINT"


def write_csv(view: DataFrame, path: str, quoting: str = "standard") -> None:
    """The secrets CSV, most changed first. ``quoting="flat"`` replaces
    semicolons and line ends in texts instead of quoting them. ``Part`` and ``Parts`` are written
    if some secret has more than one row; else there are the 11 columns."""
    order = [F.col("ChangeCount").desc(), "File", "Key"]
    rows = view
    if "Part" in view.columns:
        view = stored(view, "csv-view")
        rows = view.orderBy(*order, "Part")
        several = "Parts > 1" if "Parts" in view.columns else "Part > 0"
        if not view.where(several).limit(1).count():
            rows = rows.drop("Part", "Parts")
    else:
        rows = view.orderBy(*order)
    writer = rows.write.option("header", True).option("sep", ";").option("escape", '"')
    if quoting == "flat":
        texts = {c: csv_escape(F.col(c)) for c in ("File", "Key", "Type", "Authors", "Values")}
        rows = rows.withColumns(texts)
        # The texts are quoted already.
        writer = rows.write.option("header", True).option("sep", ";").option("quote", "\u0000")
    writer.csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The table of a secrets CSV, with ``Part`` and ``Parts`` also where the files lack them."""
    reader = spark.read.option("header", True).option("sep", ";").option("escape", '"').option("multiLine", True)
    names = reader.csv(path).columns
    if "Part" in names:
        return reader.schema(CSV_SCHEMA + CSV_PARTS).csv(path)
    rows = reader.schema(CSV_SCHEMA).csv(path)
    return rows.withColumns({"Part": F.lit(0).cast("bigint"), "Parts": F.lit(1).cast("bigint")})


def csv_secrets(rows: DataFrame) -> DataFrame:
    """One row per secret of a CSV table: its numbers and dates, which each part repeats."""
    return rows.where(F.col("Part") == 0).drop("Authors", "Values", "Part", "Parts")


def csv_lists(rows: DataFrame) -> DataFrame:
    """``File, Key, kind, text``: every author and every masked value, from all parts."""
    authors = F.transform(F.split("Authors", ", "), lambda x: F.struct(F.lit("author").alias("kind"), x.alias("text")))
    values = F.transform(F.split("Values", r" \| "), lambda x: F.struct(F.lit("value").alias("kind"), x.alias("text")))
    each = rows.select("File", "Key", F.inline(F.concat(F.coalesce(authors, F.array()), F.coalesce(values, F.array()))))
    return each.where(F.col("text") != "")


def write_stats_csv(stats: DataFrame, path: str) -> None:
    stats.orderBy("section", F.col("count").desc(), "name").write.option("header", True).option(
        "sep", ";"
    ).csv(path)


def write_redacted(redacted: DataFrame, path: str, text: str) -> None:
    """The redacted table goes to a new path; the source stays."""
    names = [c for c in redacted.columns if c not in ("redacted", "modified", text)]
    redacted.select(*names, F.col("redacted").alias(text)).write.mode("errorifexists").parquet(path)

