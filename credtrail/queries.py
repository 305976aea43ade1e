"""The registered queries.

Two derived tables feed them. ``commit_lines`` turns every row of ``events``
into a line of a commit; ``document_lines`` are the lines of every document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credtrail.functions.keywords import has_any_keyword
from credtrail.functions.text import fingerprint, mask
from credtrail.operators import aggregate as agg
from credtrail.operators import dedup, lookup, merge, nested, pickaxe, redact, report, scan
from credtrail.operators.dedup import longest_first, usable_values
from credtrail.operators.ignore import without_ignored
from credtrail.operators.timeline import secret_timeline
from credtrail.plans.sizing import spread
from credtrail.plans.storage import materialized, new_path
from credtrail.rules import (
    INLINE_ASSIGNMENT,
    Rules,
    alternative_rules,
    default_rules,
    ignore_table,
    keyword_table,
)
from credtrail.sources import indented, layout, records
from credtrail.sources.files import read_file_lines
from credtrail.sources.git_log import read_git_log
from credtrail.streaming import findings as streams

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# When the current files count as scanned.
SCAN_DATE = "2030-01-01 00:00:00"

COMMIT_LINES = """
SELECT event_id AS seq,
  md5('c' || CAST(event_id - event_id % 48 AS STRING)) AS commit,
  'dev' || CAST((event_id - event_id % 48) % 17 AS STRING) AS author,
  min(ts) OVER (PARTITION BY event_id - event_id % 48) AS date,
  'cfg/svc' || CAST(user_id % 3 AS STRING)
    || CASE user_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.png' ELSE '.env' END AS file,
  CASE WHEN event_id % 5 IN (2, 4) THEN '-' ELSE '+' END AS sign,
  CASE event_id % 8
    WHEN 0 THEN 'password=' || substr(md5(CAST(user_id % 13 AS STRING) || '-'
                                || CAST(event_id % 5 AS STRING)), 1, 12)
    WHEN 1 THEN 'api_key: "' || substr(md5(CAST(user_id % 29 AS STRING)), 1, 20) || '"'
    WHEN 2 THEN '  "client_secret": "' || substr(md5(event_type), 1, 16) || '",'
    WHEN 3 THEN 'export AUTH_TOKEN=' || substr(md5(CAST(user_id % 11 AS STRING)), 1, 24)
    WHEN 4 THEN 'db_url = https://h/' || CAST(user_id AS STRING)
    WHEN 5 THEN 'token = config.Value'
    WHEN 6 THEN 'Password=changeme'
    ELSE 'timeout=30' END AS line
FROM events
"""


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        COMMIT_LINES.replace("FROM events", "FROM {events}"),
        events=table(spark, sf_dir, "events"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = spread(rows, "doc_id")
    return rows.select("doc_id", F.concat("source", F.lit("/"), "doc_id").alias("file"), "text")


def prose_rules() -> Rules:
    """Rules for documents: assignments inside sentences, one keyword."""
    return replace(default_rules().with_patterns(INLINE_ASSIGNMENT).with_keywords("token"),
                   ignored_files=(), excluded_extensions=())


def history(spark: SparkSession, sf_dir: str, rules: Rules | None = None) -> DataFrame:
    return scan.scan_history(commit_lines(spark, sf_dir), rules)


def kept_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings written once, for queries that use them more than once: the
    lines are then read and matched a single time."""
    columns = ("seq", "commit", "author", "date", "file", "key", "value", "hits", "kw_first")
    return materialized(history(spark, sf_dir).select(*columns))


def snapshot_lines(lines: DataFrame) -> DataFrame:
    """The current files: lines whose last change added them."""
    # The highest (seq, sign) in one number, so the aggregate needs no sort.
    change = F.col("seq") * 2 + F.when(F.col("sign") == "+", 1).otherwise(0)
    last = lines.groupBy("file", "line").agg(F.max(change).alias("_last"))
    return last.where(F.col("_last") % 2 == 1).select(
        "file", "line", F.floor(F.col("_last") / 2).cast("bigint").alias("seq")
    )


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.lit(SCAN_DATE).cast("timestamp_ntz")
    return scan.scan_current(snapshot_lines(commit_lines(spark, sf_dir)), when)


def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = prose_rules()
    lines = scan.text_lines(documents(spark, sf_dir), "text", rules, number=True)
    return scan.findings(lines, rules)


def document_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable_values(document_findings(spark, sf_dir))


def shown(df: DataFrame) -> DataFrame:
    return agg.hidden(df)


# -- extraction and filters -----------------------------------------------------


@query
def extract_kv(spark, sf_dir):
    rows = scan.extract(commit_lines(spark, sf_dir), default_rules())
    return shown(rows.select("seq", "pattern", "key", "value"))


@query
def extract_kv_fallthrough(spark, sf_dir):
    rules = replace(default_rules(), fallthrough=True)
    rows = scan.extract(commit_lines(spark, sf_dir), rules)
    return shown(rows.select("seq", "pattern", "key", "value"))


@query
def extract_inline(spark, sf_dir):
    rows = document_findings(spark, sf_dir)
    counted = rows.groupBy("key", "value").agg(F.count("*").alias("n"))
    return shown(counted)


@query
def document_scan(spark, sf_dir):
    return shown(document_findings(spark, sf_dir).select("doc_id", "file", "line_no", "key", "value"))


@query
def conversation_scan(spark, sf_dir):
    """Chat turns hold no assignment in quotes, so keyword lines are counted."""
    rules = default_rules()
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    lines = rows.select("conv_id", "turn", "role", F.explode(F.split("text", "\n")).alias("line"))
    hit = has_any_keyword(F.col("line"), rules)
    return lines.groupBy("role").agg(
        F.count("*").alias("lines"), F.count_if(hit).alias("keyword_lines")
    )


@query
def page_scan(spark, sf_dir):
    """Assignments in the lines of every page, and how the value tests judge them."""
    rules = default_rules().with_patterns(INLINE_ASSIGNMENT)
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    rows = scan.extract(scan.text_lines(pages, "html", rules), rules)
    return agg.reject_breakdown(rows, rules, "key")


@query
def filter_ignored_files(spark, sf_dir):
    rows = scan.scanned_files(commit_lines(spark, sf_dir), default_rules())
    return rows.groupBy("file").agg(F.count("*").alias("n"))


@query
def filter_file_size(spark, sf_dir):
    files = documents(spark, sf_dir).withColumn("size", F.octet_length("text"))
    return scan.small_files(files, limit=4096).select("doc_id", "size")


@query
def filter_added_lines(spark, sf_dir):
    rows = scan.added_lines(commit_lines(spark, sf_dir))
    return rows.groupBy("commit").agg(F.count("*").alias("n"))


@query
def keyword_hits(spark, sf_dir):
    rows = scan.by_keyword(scan.added_lines(commit_lines(spark, sf_dir)), default_rules())
    return rows.select("seq", "kw_idx", "keyword")


@query
def keyword_counts(spark, sf_dir):
    rules = default_rules()
    return agg.keyword_counts(scan.by_keyword(history(spark, sf_dir), rules))


@query
def pickaxe_commits(spark, sf_dir):
    rows = pickaxe.keyword_deltas(commit_lines(spark, sf_dir), default_rules())
    return rows.groupBy("keyword").agg(
        F.count("*").alias("touched"), F.count_if(F.col("delta") != 0).alias("changed")
    )


@query
def pickaxe_secrets(spark, sf_dir):
    rules = default_rules()
    lines = commit_lines(spark, sf_dir)
    found = pickaxe.pickaxe_findings(history(spark, sf_dir), lines, rules)
    return agg.secrets(found, rules).select(
        "file", "key", "type", "change_count", "total_occurrences"
    )


@query
def reject_breakdown(spark, sf_dir):
    rules = default_rules()
    lines = scan.scanned_files(scan.added_lines(commit_lines(spark, sf_dir)), rules)
    return agg.reject_breakdown(scan.extract(lines, rules), rules)


@query
def masked_findings(spark, sf_dir):
    return shown(history(spark, sf_dir).select("seq", "commit", "file", "key", "value", "hits"))


@query
def type_by_keyword(spark, sf_dir):
    return agg.secrets(history(spark, sf_dir), default_rules()).select("file", "key", "type")


@query
def type_by_group(spark, sf_dir):
    rules = default_rules()
    keys = agg.secrets(history(spark, sf_dir), rules).select("file", "key")
    return agg.with_group_type(keys, rules)


# -- dedup, values, secrets -------------------------------------------------------


@query
def findings_dedup(spark, sf_dir):
    rows = report.stream_entries(history(spark, sf_dir), default_rules())
    return shown(rows.select("file", "key", "value", "type", "commit", "author", "date"))


@query
def values_agg(spark, sf_dir):
    rules = default_rules()
    rows = agg.with_type(agg.values(history(spark, sf_dir)), rules)
    return shown(rows.select(
        "file", "key", "value", "type", "occurrences", "commit_count", "author_count",
        "first_seen", "last_seen",
    ))


@query
def value_commits(spark, sf_dir):
    rows = agg.value_commits(history(spark, sf_dir))
    return shown(rows.select("file", "key", "value", "commit", "author", "occurrences"))


@query
def secrets_agg(spark, sf_dir):
    rows = agg.secrets(history(spark, sf_dir), default_rules())
    return agg.by_change_count(rows.select(
        "file", "key", "type", "change_count", "total_occurrences", "author_count",
        "commit_count", "first_seen", "last_seen",
    ))


@query
def secrets_alternative_rules(spark, sf_dir):
    rules = alternative_rules()
    rows = agg.secrets(history(spark, sf_dir, rules), rules)
    return rows.select("file", "key", "type", "change_count", "total_occurrences")


@query
def secret_authors(spark, sf_dir):
    return dedup.secret_authors(history(spark, sf_dir))


@query
def secrets_by_file(spark, sf_dir):
    rows = agg.secrets(history(spark, sf_dir), default_rules())
    return rows.orderBy("file", "key").select("file", "key", "change_count")


@query
def timeline(spark, sf_dir):
    rows = secret_timeline(agg.values(history(spark, sf_dir)))
    return rows.select(
        "file", "key", "version",
        mask(F.col("value")).alias("masked"),
        fingerprint(F.col("value")).alias("value_hash"),
        fingerprint(F.col("previous_value")).alias("previous_hash"),
        "first_seen", "last_seen", "replaced_at", "occurrences",
    )


QUERIES["secret_timeline"] = QUERIES.pop("timeline")


@query
def scan_summary(spark, sf_dir):
    return agg.scan_summary(agg.secrets(history(spark, sf_dir), default_rules()))


@query
def unique_values(spark, sf_dir):
    return agg.unique_values(history(spark, sf_dir))


@query
def approx_unique_values(spark, sf_dir):
    return agg.unique_values(history(spark, sf_dir), exact=False)


@query
def unique_values_by_sketch(spark, sf_dir):
    """Distinct values of each file from sketches kept per file and day, beside exact counts."""
    found = kept_history(spark, sf_dir).withColumn("day", F.to_date("date"))
    kept = materialized(agg.value_sketches(found, "file", "day"))
    near = agg.sketched_values(kept, "file").withColumnsRenamed(
        {"unique_values": "_u", "global_unique_values": "_g"}
    )
    pairs = found.groupBy("file").agg(
        F.count_distinct("key", "value").alias("unique_values"), F.count_distinct("value").alias("global_unique_values")
    )

    def close(estimate: str, exact: str):
        return F.abs(F.col(estimate) - F.col(exact)) <= F.col(exact) * 0.05

    return pairs.join(near, "file").select(
        "file", "unique_values", "global_unique_values",
        (close("_u", "unique_values") & close("_g", "global_unique_values")).alias("within_5_percent"),
    )


# -- statistics -------------------------------------------------------------------


def _entries(spark, sf_dir):
    return report.stream_entries(history(spark, sf_dir), default_rules())


@query
def stats_entry_authors(spark, sf_dir):
    return agg.top(agg.entry_counts(_entries(spark, sf_dir), "author"), "author")


@query
def stats_entry_files(spark, sf_dir):
    return agg.top(agg.entry_counts(_entries(spark, sf_dir), "file"), "file")


@query
def stats_entry_types(spark, sf_dir):
    return agg.top(agg.entry_counts(_entries(spark, sf_dir), "type"), "type", None)


@query
def stats_secret_authors(spark, sf_dir):
    return agg.top(agg.author_counts(history(spark, sf_dir)), "author")


@query
def stats_secret_files(spark, sf_dir):
    rows = agg.secrets(history(spark, sf_dir), default_rules())
    return agg.top(agg.secret_counts(rows, "file"), "file")


@query
def stats_secret_types(spark, sf_dir):
    rows = agg.secrets(history(spark, sf_dir), default_rules())
    return agg.top(agg.secret_counts(rows, "type"), "type", None)


@query
def key_counts(spark, sf_dir):
    return agg.entry_counts(_entries(spark, sf_dir), "key")


@query
def file_counts(spark, sf_dir):
    return agg.entry_counts(_entries(spark, sf_dir), "file")


@query
def detect_source(spark, sf_dir):
    both = merge.both_sources(current(spark, sf_dir), history(spark, sf_dir))
    return agg.detect_source(both)


@query
def findings_by_date_range(spark, sf_dir):
    since, until = F.lit("2024-01-08").cast("timestamp_ntz"), F.lit("2024-01-15").cast("timestamp_ntz")
    rows = agg.in_date_range(history(spark, sf_dir), since, until)
    per_day = rows.groupBy(F.to_date("date").alias("day"))
    return per_day.agg(F.count("*").alias("lines"), F.sum("hits").alias("occurrences"))


@query
def findings_in_weeks(spark, sf_dir):
    """Findings laid out by day, and the weeks asked for given by a table."""
    path = new_path(spark, "by-day")
    layout.write_by_day(kept_history(spark, sf_dir), path)
    weeks = spark.sql(
        "SELECT id AS week, date_add(date'2024-01-01', CAST(14 * id AS INT)) AS since, "
        "date_add(date'2024-01-08', CAST(14 * id AS INT)) AS until FROM range(3)"
    )
    rows = layout.in_days(layout.read_by_day(spark, path), weeks)
    return rows.groupBy("week", "file").agg(F.count("*").alias("lines"), F.sum("hits").alias("occurrences"))


@query
def gate(spark, sf_dir):
    return agg.gate(history(spark, sf_dir))


# -- current files and history ------------------------------------------------------


@query
def current_secrets(spark, sf_dir):
    """A current value counts once, so occurrences equal distinct values."""
    found = current(spark, sf_dir)
    rows = merge.merged_secrets(found, found.limit(0), default_rules())
    return rows.select("file", "key", "type", "change_count", "total_occurrences")


@query
def scan_both_merge(spark, sf_dir):
    rows = merge.merged_secrets(
        current(spark, sf_dir), history(spark, sf_dir), default_rules()
    )
    return rows.select("file", "key", "type", "change_count", "total_occurrences",
                       "first_seen", "last_seen")


@query
def scan_both_history_wins(spark, sf_dir):
    rows = merge.merged_secrets_history_wins(
        current(spark, sf_dir), history(spark, sf_dir), default_rules()
    )
    return rows.select("file", "key", "type", "change_count", "total_occurrences",
                       "first_seen", "last_seen")


@query
def scan_both_authors(spark, sf_dir):
    rows = merge.merged_authors(current(spark, sf_dir), history(spark, sf_dir))
    return rows.groupBy("file", "key").agg(F.count("*").alias("author_count"))


def _both_kept(spark, sf_dir):
    columns = ("author", "commit", "date", "file", "key", "value", "hits", "kw_first")
    return materialized(current(spark, sf_dir).select(*columns)), kept_history(spark, sf_dir)


def _nested_facts(rows: DataFrame) -> DataFrame:
    """One row per secret and listed value, of a nested result."""
    each = rows.select(
        "file", "key", "type", "changeCount", "totalOccurrences", F.size("authors").alias("authors"),
        F.posexplode("history").alias("place", "h"),
    )
    return each.select(
        "file", "key", "type", F.col("changeCount").alias("change_count"),
        F.col("totalOccurrences").alias("total_occurrences"), "authors", "place",
        F.col("h.maskedValue").alias("masked"), fingerprint(F.col("h.value")).alias("value_hash"),
        F.size("h.commits").alias("listed_commits"), F.array_join("h.authors", ",").alias("value_authors"),
        F.col("h.firstSeen").alias("first_raw"), F.col("h.lastSeen").alias("last_raw"),
    )


@query
def scan_both_nested(spark, sf_dir):
    """The result file of a scan of both sources, written and read, value by value."""
    path = new_path(spark, "both")
    records.write_secrets(nested.merged_nested(*_both_kept(spark, sf_dir), default_rules()), path)
    return _nested_facts(records.read_secrets(spark, path))


@query
def scan_both_nested_parts(spark, sf_dir):
    """The same in parts of 10 entries: all parts together hold the same values and authors."""
    path = new_path(spark, "both")
    rows = nested.merged_nested(*_both_kept(spark, sf_dir), default_rules(), part_size=10)
    records.write_secrets(rows, path)
    back = records.read_secrets(spark, path)
    values = records.values_of_secrets(back).groupBy("file", "key").agg(
        F.count_distinct("value").alias("values"), F.sum("occurrences").alias("listed_commits")
    )
    authors = back.select("file", "key", F.explode("authors").alias("a")).groupBy("file", "key")
    authors = authors.agg(F.count("*").alias("authors"))
    wrong = records.incomplete_secrets(back).agg(F.count("*").alias("n")).scalar()
    return values.join(authors, ["file", "key"]).withColumn("incomplete", wrong)


@query
def scan_both_history_wins_nested(spark, sf_dir):
    path = new_path(spark, "both")
    records.write_secrets(
        nested.merged_nested(*_both_kept(spark, sf_dir), default_rules(), history_wins=True), path
    )
    return _nested_facts(records.read_secrets(spark, path))


@query
def scan_both_summary(spark, sf_dir):
    return merge.merged_summary(current(spark, sf_dir), history(spark, sf_dir), default_rules())


@query
def scan_both_history_wins_summary(spark, sf_dir):
    return merge.merged_summary_history_wins(
        current(spark, sf_dir), history(spark, sf_dir), default_rules()
    )


@query
def findings_union(spark, sf_dir):
    rows = merge.findings_union(current(spark, sf_dir), history(spark, sf_dir))
    rows = agg.with_type(rows, default_rules())
    return shown(rows.select("file", "key", "value", "type", "commit", "author"))


@query
def still_live(spark, sf_dir):
    return shown(merge.still_live(current(spark, sf_dir), history(spark, sf_dir)))


@query
def only_in_history(spark, sf_dir):
    return shown(merge.only_in_history(current(spark, sf_dir), history(spark, sf_dir)))


# -- redaction -----------------------------------------------------------------------


@query
def values_longest_first(spark, sf_dir):
    rows = longest_first(usable_values(history(spark, sf_dir)))
    return shown(rows.withColumn("n_chars", F.length("value")))


@query
def pattern_batches(spark, sf_dir):
    rows = redact.pattern_batches(usable_values(history(spark, sf_dir)))
    return rows.select("batch", "n", fingerprint(F.col("pattern")).alias("pattern_hash"))


@query
def redact_plan(spark, sf_dir):
    return redact.redact_plan(kept_history(spark, sf_dir))


@query
def redact_preview(spark, sf_dir):
    return redact.redact_preview(usable_values(history(spark, sf_dir)))


@query
def redact_lines(spark, sf_dir):
    lines = commit_lines(spark, sf_dir).select("seq", "file", "sign", "line")
    done = redact.redact_lines(lines, usable_values(history(spark, sf_dir)), ["seq"])
    return done.select("seq", "file", "sign", "redacted", "modified")


def _redacted_documents(spark, sf_dir, kernel):
    texts = documents(spark, sf_dir).select("doc_id", "file", "text")
    return kernel(texts, document_values(spark, sf_dir), ["doc_id"], "text")


@query
def redact_documents_fold(spark, sf_dir):
    done = _redacted_documents(spark, sf_dir, redact.redact)
    return done.select("doc_id", fingerprint(F.col("redacted")).alias("text_hash"), "modified")


@query
def redact_documents_anchor(spark, sf_dir):
    done = _redacted_documents(spark, sf_dir, redact.redact_by_anchor)
    return done.select("doc_id", fingerprint(F.col("redacted")).alias("text_hash"), "modified")


@query
def redact_documents_pattern(spark, sf_dir):
    done = _redacted_documents(spark, sf_dir, redact.redact_by_pattern)
    return done.select("doc_id", fingerprint(F.col("redacted")).alias("text_hash"), "modified")


@query
def redact_named_files(spark, sf_dir):
    """Only the documents named by the findings are looked at."""
    done = redact.redact_files(
        documents(spark, sf_dir), document_findings(spark, sf_dir), ["doc_id"], "text"
    )
    return done.select("doc_id", fingerprint(F.col("redacted")).alias("text_hash"), "modified")


@query
def redact_overlaps(spark, sf_dir):
    """Thousands of values that are parts of each other: all long words of the documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{13,}"), F.lit(0))).alias("value"))
    done = redact.redact(docs, words.distinct(), ["doc_id"], "text")
    return done.select("doc_id", fingerprint(F.col("redacted")).alias("text_hash"), "modified")


@query
def redact_summary(spark, sf_dir):
    return redact.redact_summary(_redacted_documents(spark, sf_dir, redact.redact))


@query
def redact_residual(spark, sf_dir):
    """Scan the redacted documents again and look for the values: both zero."""
    rules = prose_rules()
    found = materialized(document_values(spark, sf_dir))
    done = redact.redact(documents(spark, sf_dir), found, ["doc_id"], "text")
    left = redact.residual(done, found, ["doc_id"])
    clean = done.select("doc_id", "file", F.col("redacted").alias("text"))
    again = scan.findings(scan.text_lines(clean, "text", rules), rules)
    return left.select(F.lit("value").alias("kind")).unionByName(
        again.select(F.lit("finding").alias("kind"))
    ).agg(
        F.count_if(F.col("kind") == "value").alias("values_left"),
        F.count_if(F.col("kind") == "finding").alias("findings_left"),
    )


# -- reports, sinks and round trips ------------------------------------------------------


@query
def secrets_csv_view(spark, sf_dir):
    return nested.csv_view(kept_history(spark, sf_dir), default_rules()).drop("Parts")


@query
def stats_long(spark, sf_dir):
    return report.stats_long(report.secret_stats(kept_history(spark, sf_dir), default_rules()))


@query
def stats_long_entries(spark, sf_dir):
    entries = materialized(_entries(spark, sf_dir).drop("line", "pattern", "sign"))
    return report.stats_long(report.entry_stats(entries, default_rules()))


@query
def report_authors(spark, sf_dir):
    return report.report_authors(materialized(_entries(spark, sf_dir).select("author")))


@query
def report_files(spark, sf_dir):
    return report.report_files(_entries(spark, sf_dir))


@query
def report_secrets(spark, sf_dir):
    return report.report_secrets(kept_history(spark, sf_dir), default_rules())


@query
def report_values(spark, sf_dir):
    return report.report_values(kept_history(spark, sf_dir), default_rules())


@query
def csv_roundtrip(spark, sf_dir):
    """The CSV files read back: texts, numbers and separators survive."""
    path = new_path(spark, "secrets-csv")
    records.write_csv(nested.csv_view(kept_history(spark, sf_dir), default_rules()), path)
    return records.read_csv(spark, path).drop("Part", "Parts")


@query
def csv_parts_roundtrip(spark, sf_dir):
    """Long secrets over many rows of the CSV: what the files hold together."""
    path = new_path(spark, "secrets-csv")
    records.write_csv(nested.csv_view(kept_history(spark, sf_dir), default_rules(), part_size=10), path)
    rows = records.read_csv(spark, path)
    lists = records.csv_lists(rows).groupBy("File", "Key").agg(
        F.count_if(F.col("kind") == "author").alias("authors"), F.count_if(F.col("kind") == "value").alias("values")
    )
    return records.csv_secrets(rows).join(lists, ["File", "Key"]).select(
        "File", "Key", "ChangeCount", "TotalOccurrences", "authors", "values"
    )


def commit_texts(lines: DataFrame) -> DataFrame:
    """Each commit as the text a log with patches shows."""
    body = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("seq", F.concat("sign", "line").alias("t")))),
            lambda x: x["t"],
        ),
        "\n",
    )
    diffs = lines.groupBy("commit", "author", "date", "file").agg(body.alias("body"))
    part = F.concat(
        F.lit("diff --git a/"), "file", F.lit(" b/"), "file",
        F.lit("\nindex 0000000..1111111 100644\n--- a/"), "file", F.lit("\n+++ b/"), "file",
        F.lit("\n@@ -1 +1 @@\n"), "body",
    )
    patches = diffs.groupBy("commit", "author", "date").agg(
        F.array_join(F.sort_array(F.collect_list(part)), "\n").alias("patch")
    )
    when = F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    header = F.concat_ws("|", F.lit("COMMIT_START"), "commit", "author", when)
    return patches.select(F.concat(header, F.lit("\n\n"), "patch", F.lit("\n")).alias("value"))


@query
def git_log_ingest(spark, sf_dir):
    path = new_path(spark, "log")
    # A commit of this table has 48 lines at most.
    commit_texts(commit_lines(spark, sf_dir)).write.text(path)
    rows = read_git_log(spark, path)
    return rows.groupBy("commit", "author", "date_raw", "file", "sign", "line").agg(
        F.count("*").alias("n")
    )


@query
def git_log_secrets(spark, sf_dir):
    """From log text to secrets, with the keyword test inside the text scan."""
    rules = default_rules()
    path = new_path(spark, "log")
    commit_texts(commit_lines(spark, sf_dir)).write.text(path)
    found = scan.scan_history(read_git_log(spark, path, rules), rules)
    return agg.secrets(found, rules).select(
        "file", "key", "type", "change_count", "total_occurrences", "author_count",
        "first_raw", "last_raw",
    )


@query
def file_tree_scan(spark, sf_dir):
    """The current files as a folder tree, one folder per file, and its findings."""
    rules = default_rules()
    path = new_path(spark, "tree")
    lines = snapshot_lines(commit_lines(spark, sf_dir)).select("file", "line")
    lines.write.partitionBy("file").text(path)
    everything = replace(rules, ignored_files=(), excluded_extensions=())
    read = read_file_lines(spark, path, everything, max_bytes=None)
    folder = F.url_decode(F.regexp_extract("file", "^file=([^/]+)/", 1))
    found = scan.findings(scan.scanned_files(read.withColumn("file", folder), rules), rules)
    return shown(found.groupBy("file", "key", "value").agg(F.sum("hits").alias("occurrences")))


@query
def jsonl_roundtrip(spark, sf_dir):
    path = new_path(spark, "findings")
    records.write_findings(_entries(spark, sf_dir), path)
    rows = records.read_findings(spark, path)
    return shown(rows.select("file", "key", "value", "type", "commit", "author", "date_raw"))


@query
def json_roundtrip(spark, sf_dir):
    path = new_path(spark, "secrets")
    rows = nested.nested_secrets(kept_history(spark, sf_dir), default_rules())
    records.write_secrets(rows, path)
    back = records.analyzed_secrets(records.read_secrets(spark, path))
    return back.select("file", "key", "type", "change_count", "total_occurrences")


@query
def scan_result_roundtrip(spark, sf_dir):
    """A whole scan in nested form, written and read for cleaning."""
    path = new_path(spark, "scan")
    rows = nested.nested_secrets(kept_history(spark, sf_dir), default_rules())
    results = records.scan_results(rows, "events", "--all", "2030-01-01T00:00:00Z")
    records.write_scan_results(results, path)
    back = records.read_scan_results(spark, path)
    found = records.commits_of_secrets(back)
    return found.groupBy("file", "key").agg(
        F.count("*").alias("listed_commits"),
        F.count_distinct("commit").alias("commits"),
        F.count_distinct("value").alias("values"),
    )


@query
def indented_result_scan(spark, sf_dir):
    """Results as other tools write them, indented over many lines, read line by line."""
    path = new_path(spark, "indented")
    rows = nested.nested_secrets(kept_history(spark, sf_dir), default_rules(), part_size=100)
    indented.indented_documents(rows, "events", "--all", "2030-01-01T00:00:00Z").write.text(path)
    read = indented.read_indented(spark, path)
    found = indented.indented_secrets(read).select("file", "key", "type", "change_count", "total_occurrences")
    commits = indented.indented_commits(read).groupBy("file", "key").agg(F.count_distinct("commit").alias("commits"))
    bad = indented.count_bad_lines(read).select("bad_lines").scalar()
    return found.join(commits, ["file", "key"]).withColumn("bad_lines", bad)


# -- rules as tables ------------------------------------------------------------------


@query
def ignored_by_table(spark, sf_dir):
    """Ignored files by a glob list that is a table, per kind of glob."""
    globs = ignore_table(spark, default_rules()).where(F.col("list") == "file")
    lines = commit_lines(spark, sf_dir)
    kept = without_ignored(lines, globs.select(F.col("entry").alias("glob")))
    return kept.groupBy("file").agg(F.count("*").alias("n"))


@query
def ignored_by_lists(spark, sf_dir):
    """A list of globs for each language, with all four kinds of them and one that ignores everything."""
    files = table(spark, sf_dir, "documents").select(
        "lang", F.concat("source", F.lit("/"), "doc_id", F.lit("."), "lang").alias("file"), "n_chars"
    )
    globs = [("en", "src1/"), ("en", "src2**/x"), ("de", "*.de"), ("es", "src3/"), ("es", "*4.es"), ("fr", "**/x")]
    first = files.where("lang = 'es'").agg(F.min_by("lang", "file").alias("lang"), F.min("file").alias("glob"))
    lists = spark.createDataFrame(globs, "lang STRING, glob STRING").unionByName(first)
    kept = without_ignored(files, lists, by=("lang",))
    return kept.groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("n_chars"), F.min("file").alias("first"))


@query
def keyword_table_hits(spark, sf_dir):
    """How many lines of the documents hold each word of the benchmark, as a table of keywords."""
    words = table(spark, sf_dir, "benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("keyword")
    ).distinct()
    words = words.withColumn("kw_idx", F.xxhash64("keyword"))
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    hits = lookup.keyword_matches(lines, words, ["doc_id", "line_no"])
    return hits.join(words, "kw_idx").groupBy("keyword").agg(
        F.count("*").alias("lines"), F.count_distinct("doc_id").alias("docs")
    )


@query
def secrets_by_keyword_table(spark, sf_dir):
    """The scan with its keywords as a table that lines are joined with."""
    rules = default_rules()
    lines = scan.scanned_files(scan.added_lines(commit_lines(spark, sf_dir)), rules)
    found = lookup.findings_by_table(lines, keyword_table(spark, rules), rules, ["seq"])
    return agg.secrets(found, rules).select("file", "key", "type", "change_count", "total_occurrences")


@query
def keyword_groups_hit(spark, sf_dir):
    """Findings per keyword group, the keyword list joined as a table."""
    rules = default_rules()
    hits = scan.by_keyword(history(spark, sf_dir), rules)
    groups = keyword_table(spark, rules).select("kw_idx", "group")
    # The keyword list is part of the rules, a few dozen rows.
    joined = hits.join(F.broadcast(groups), "kw_idx")
    return joined.groupBy("group").agg(F.count("*").alias("n"))


# -- streams ---------------------------------------------------------------------------


def _line_stream(spark, sf_dir, files_per_trigger: int = 1000) -> DataFrame:
    path = new_path(spark, "lines")
    lines = commit_lines(spark, sf_dir).withColumn("date", F.col("date").cast("timestamp"))
    lines.write.parquet(path)
    reader = spark.readStream.schema(lines.schema)
    return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _run(stream: DataFrame, spark: SparkSession, name: str) -> str:
    out = new_path(spark, name)
    streams.write_findings_stream(stream, out, new_path(spark, name + "-state")).awaitTermination()
    return out


STREAM_SCHEMA = (
    "file STRING, `key` STRING, `value` STRING, type STRING, `commit` STRING, "
    "author STRING, `date` TIMESTAMP, maskedValue STRING"
)
CHANGE_SCHEMA = STREAM_SCHEMA + ", version BIGINT"


def _first_rows(spark: SparkSession, found: DataFrame) -> DataFrame:
    """The first finding of each value, as a stream has written it."""
    changes = _run(streams.least_in_stream(found), spark, "stream")
    rows = streams.latest_versions(spark.read.schema(CHANGE_SCHEMA).json(changes))
    return shown(rows.select("file", "key", "value", "type", "commit", "author", "date"))


@query
def stream_findings(spark, sf_dir):
    return _first_rows(spark, streams.history_stream(_line_stream(spark, sf_dir)))


@query
def stream_current(spark, sf_dir):
    path = new_path(spark, "files")
    lines = snapshot_lines(commit_lines(spark, sf_dir))
    lines.write.parquet(path)
    stream = spark.readStream.schema(lines.schema).parquet(path)
    found = streams.first_in_stream(
        streams.current_stream(stream, F.lit(SCAN_DATE).cast("timestamp"))
    )
    rows = spark.read.schema(STREAM_SCHEMA).json(_run(found, spark, "stream"))
    return shown(rows.select("file", "key", "value", "commit", "author"))


@query
def stream_both(spark, sf_dir):
    path = new_path(spark, "files")
    lines = snapshot_lines(commit_lines(spark, sf_dir))
    lines.write.parquet(path)
    files = spark.readStream.schema(lines.schema).parquet(path)
    both = streams.both_stream(
        streams.history_stream(_line_stream(spark, sf_dir)),
        streams.current_stream(files, F.lit(SCAN_DATE).cast("timestamp")),
    )
    return _first_rows(spark, both)


@query
def stream_counts(spark, sf_dir):
    """Findings by author, file, type and key, kept up by batches of a stream."""
    path, out = new_path(spark, "findings"), new_path(spark, "section-counts")
    records.write_findings(_entries(spark, sf_dir), path)
    save = streams.counts_upsert(out, ["author", "file", "type", "key"])
    writer = streams.read_findings_stream(spark, path).writeStream.foreachBatch(save)
    writer = writer.option("checkpointLocation", new_path(spark, "section-counts-state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return streams.read_counts(spark, out)


@query
def stream_author_counts(spark, sf_dir):
    """Running counts over a findings file, kept up by a streaming aggregate."""
    path, out = new_path(spark, "findings"), new_path(spark, "counts")
    records.write_findings(_entries(spark, sf_dir), path)
    counts = streams.running_counts(streams.read_findings_stream(spark, path), "author")

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    writer = counts.writeStream.outputMode("complete").foreachBatch(save)
    writer = writer.option("checkpointLocation", new_path(spark, "counts-state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("author", "count")


@query
def stream_days(spark, sf_dir):
    """Findings per day, all days, however many triggers the backlog takes."""
    return days_of(spark, streams.history_stream(_line_stream(spark, sf_dir)))


def days_of(spark, found: DataFrame) -> DataFrame:
    out = new_path(spark, "days")

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    writer = streams.findings_per_day(found).writeStream.outputMode("complete").foreachBatch(save)
    writer = writer.option("checkpointLocation", new_path(spark, "days-state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("day TIMESTAMP, n BIGINT").parquet(out)
