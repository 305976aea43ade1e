"""Queries over values made to sit on both sides of every rule.

Each row of ``events`` becomes a line whose value is of one of some twenty kinds: code, addresses, odd
lengths, blanks of all sorts, text that CSV must quote. Dates carry offsets, some are unreadable.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credtrail import oracle as sql
from credtrail.functions import dates, text, values
from credtrail.operators import aggregate as agg
from credtrail.operators import redact, report, scan
from credtrail.operators.dedup import usable_values
from credtrail.operators.nested import csv_view
from credtrail.operators.timeline import secret_timeline
from credtrail.plans.storage import materialized, new_path
from credtrail.queries import Query, table
from credtrail.rules import default_rules, load_rules
from credtrail.sources import records

CASE_QUERIES: dict[str, Query] = {}
CASE_ORACLE: dict[str, str] = {}

CASE_LINES = """
SELECT seq, kind, commit, author, date_raw, file, sign, ref, 'token_' || CAST(kind % 4 AS STRING) || '=' || value AS line
FROM (
  SELECT event_id AS seq, event_id % 27 AS kind, 'c' || CAST(event_id % 50 AS STRING) AS commit,
    'dev' || CAST(user_id % 23 AS STRING) AS author, 'cfg/' || CAST(user_id % 7 AS STRING) || '.env' AS file,
    CASE WHEN event_id % 11 = 3 THEN '-' ELSE '+' END AS sign,
    CASE WHEN event_id % 3 = 0 THEN 'main' ELSE 'dev' END AS ref,
    '2024-01-' || lpad(CAST(1 + event_id % 28 AS STRING), 2, '0') || 'T' || lpad(CAST(event_id % 24 AS STRING), 2, '0')
      || CASE event_id % 5 WHEN 0 THEN ':30:00+05:00' WHEN 1 THEN ':30:00-08:00' WHEN 2 THEN ':30:00Z'
         WHEN 3 THEN ':30:00.5+00:00' ELSE ' at noon' END AS date_raw,
    CASE event_id % 27
      WHEN 0 THEN 'fn(' || CAST(user_id AS STRING) || ')' WHEN 1 THEN 'row[' || CAST(user_id AS STRING) || ']'
      WHEN 2 THEN '{' || substr(md5(event_type), 1, 8) WHEN 3 THEN substr(md5(event_type), 1, 8) || '}'
      WHEN 4 THEN 'a.b.c.d' || CAST(user_id % 9 AS STRING) WHEN 5 THEN 'item.Name' || CAST(user_id % 9 AS STRING)
      WHEN 6 THEN 'item.Name.x' || CAST(user_id % 9 AS STRING) WHEN 7 THEN 'return it' || CAST(user_id % 9 AS STRING)
      WHEN 8 THEN 'returned' || CAST(user_id % 9 AS STRING) WHEN 9 THEN 'HTTPS://h/' || CAST(user_id % 9 AS STRING)
      WHEN 10 THEN 'Pwd' WHEN 11 THEN 'pwd' || CAST(user_id % 9 AS STRING) WHEN 12 THEN 'ab' WHEN 13 THEN 'abc'
      WHEN 14 THEN repeat('k', 500) WHEN 15 THEN repeat('k', 501)
      WHEN 16 THEN 'wasREMOVED' || CAST(user_id % 9 AS STRING)
      WHEN 17 THEN '  ' || substr(md5(CAST(user_id % 9 AS STRING)), 1, 9) || '　 '
      WHEN 18 THEN 'né' || substr(md5(CAST(user_id % 9 AS STRING)), 1, 30) WHEN 19 THEN 'func ' || CAST(user_id AS STRING)
      WHEN 20 THEN 'mailto:x' WHEN 21 THEN 'my_Default_' || CAST(user_id AS STRING)
      WHEN 22 THEN 'a;b,c"d' || CAST(user_id % 9 AS STRING) WHEN 23 THEN 'make(x' || CAST(user_id AS STRING)
      WHEN 24 THEN 'open(' || CAST(user_id % 9 AS STRING) WHEN 25 THEN 'ÉÉ'
      ELSE substr(md5(CAST(user_id % 40 AS STRING)), 1, 20) END AS value
  FROM events)
"""


def query(oracle: str):
    def register(fn: Query) -> Query:
        CASE_QUERIES[fn.__name__] = fn
        CASE_ORACLE[fn.__name__] = oracle
        return fn

    return register


def case_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = CASE_LINES.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}")
    rows = spark.sql(plain, events=table(spark, sf_dir, "events"))
    return rows.withColumn("date", dates.instant(F.col("date_raw")))


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.extract(case_lines(spark, sf_dir), default_rules())


def found(spark: SparkSession, sf_dir: str, rules=None) -> DataFrame:
    names = ("seq", "commit", "author", "date_raw", "date", "file", "key", "value", "hits", "kw_first")
    return materialized(scan.scan_history(case_lines(spark, sf_dir), rules).select(*names))


# The SQL side: the same lines, their instants, extractions and findings.
RULES = default_rules()
_INSTANT = (
    "CASE WHEN contains(date_raw, 'noon') THEN TIMESTAMP '0001-01-01 00:00:00' "
    "ELSE CAST(CAST(date_raw AS TIMESTAMPTZ) AS TIMESTAMP) END"
)
BASE = f"""WITH w AS (SELECT *, {_INSTANT} AS date FROM ({CASE_LINES.replace("AS STRING", "AS VARCHAR")})),
kw AS ({sql._keywords(RULES)}),
x AS ({sql._kv('w', RULES)}),
added AS (SELECT * FROM w WHERE sign = '+' AND {sql._wanted_file(RULES)}),
h AS ({sql._findings('added', RULES)})
"""


@query(BASE + f"SELECT kind, {sql._reason('value', RULES)} AS reason, count(*) AS n FROM x GROUP BY ALL")
def case_reject_reasons(spark, sf_dir):
    return agg.reject_breakdown(extracted(spark, sf_dir), default_rules(), "kind")


_TESTS = ", ".join(f"count(*) FILTER ({test}) AS {name}" for name, test in sql._ignored("value", RULES).items())


@query(
    BASE + f"SELECT kind, {_TESTS}, count(*) FILTER (value <> '' AND NOT contains(value, 'REMOVED')) AS usable "
    "FROM x GROUP BY kind"
)
def case_value_tests(spark, sf_dir):
    """Every value test on its own, fired or not, and the test for redaction."""
    value = F.col("value")
    tests = [F.count_if(test).alias(name) for name, test in values.reject_tests(value, default_rules())]
    return extracted(spark, sf_dir).groupBy("kind").agg(*tests, F.count_if(values.is_usable_value(value)).alias("usable"))


@query(BASE + "SELECT seq, key, length(value) AS n_chars, sha256(value) AS value_hash FROM x")
def case_trimmed_values(spark, sf_dir):
    """Keys and values without blanks at the ends, Unicode ones included."""
    rows = extracted(spark, sf_dir).withColumn("n_chars", F.length("value").cast("bigint"))
    return rows.select("seq", "key", "n_chars", text.fingerprint(F.col("value")).alias("value_hash"))


_STARS = "CASE WHEN length(value) <= 4 THEN '****' ELSE substr(value, 1, 2) || repeat('*', length(value) - 4) || right(value, 2) END"
_FLAT = "translate(value, ';' || chr(10) || chr(13), ',  ')"


@query(
    BASE + f"""SELECT DISTINCT sha256(value) AS value_hash, {_STARS} AS whole_mask,
  CASE WHEN length(value) > 10 THEN substr(value, 1, 10) || '...' ELSE value END AS preview,
  CASE WHEN length(value) > 20 THEN substr(value, 1, 17) || '...' ELSE value END AS shortened,
  CASE WHEN contains({_FLAT}, ',') OR contains({_FLAT}, '"') THEN '"' || replace({_FLAT}, '"', '""') || '"'
    ELSE {_FLAT} END AS csv FROM x"""
)
def case_text_forms(spark, sf_dir):
    """Masks without a limit, previews, shortened and CSV forms of every value."""
    value = F.col("value")
    return extracted(spark, sf_dir).select(
        text.fingerprint(value).alias("value_hash"), text.mask(value, capped=False).alias("whole_mask"),
        text.preview(value).alias("preview"), text.truncate(value, 20).alias("shortened"), text.csv_escape(value).alias("csv"),
    ).distinct()


@query(
    BASE + f"""SELECT CASE WHEN contains(date_raw, 'noon') THEN date_raw ELSE substr(date_raw, 1, 10) END AS local_day,
  CAST(sign(epoch({_INSTANT}) - epoch(TIMESTAMP '2024-01-10 01:30:00')) AS INT) AS side, count(*) AS n FROM w GROUP BY ALL"""
)
def case_local_days(spark, sf_dir):
    """Days in the author's own offset, and instants before, at or after another one."""
    raw = F.col("date_raw")
    side = dates.compare_dates(raw, F.lit("2024-01-10T06:30:00+05:00"))
    rows = case_lines(spark, sf_dir).select(dates.local_day(raw).alias("local_day"), side.alias("side"))
    return rows.groupBy("local_day", "side").agg(F.count("*").alias("n"))


@query(
    BASE + "SELECT file, key, count(*) AS lines, count(DISTINCT value) AS change_count, "
    "CAST(sum(hits) AS BIGINT) AS occurrences FROM h WHERE ref = 'main' GROUP BY file, key"
)
def case_findings_of_ref(spark, sf_dir):
    """The scan of one branch."""
    rows = scan.scan_history(case_lines(spark, sf_dir), ref="main")
    return rows.groupBy("file", "key").agg(
        F.count("*").alias("lines"), F.count_distinct("value").alias("change_count"), F.sum("hits").alias("occurrences")
    )


@query(
    BASE + """SELECT file, key, row_number() OVER (PARTITION BY file, key ORDER BY n DESC, value) AS version,
  sha256(value) AS value_hash, n AS occurrences
FROM (SELECT file, key, value, CAST(sum(hits) AS BIGINT) AS n FROM h GROUP BY file, key, value)"""
)
def case_history_by_occurrences(spark, sf_dir):
    """Values of each secret, most frequent first."""
    rows = secret_timeline(agg.values(found(spark, sf_dir)), by="occurrences")
    return rows.select("file", "key", "version", text.fingerprint(F.col("value")).alias("value_hash"), "occurrences")


@query(
    BASE + """SELECT count(*) + (SELECT count(*) FROM w WHERE seq % 10 = 0) AS lines,
  (SELECT count(*) FROM w WHERE seq % 10 = 0) AS bad_lines, count(*) AS read FROM h"""
)
def case_bad_json_lines(spark, sf_dir):
    """A findings file with broken lines in it: they are left out and counted."""
    path = new_path(spark, "findings")
    records.write_findings(found(spark, sf_dir).withColumn("type", F.lit("token")), path)
    broken = case_lines(spark, sf_dir).where("seq % 10 = 0").select(F.concat(F.lit('{"file": "'), "line").alias("value"))
    broken.write.mode("append").text(path)
    n = records.read_findings(spark, path).agg(F.count("*").alias("n")).scalar()
    return records.count_bad_findings(spark, path).select("lines", "bad_lines", n.alias("read"))


FILE_RULES = (
    '{"keywords": [{"name": "mine", "patterns": ["Token_1", "token_2", "token_"]}], "ignoredValues": ["ABC", "kkk"],\n'
    ' "settings": {"maxSecretLength": 30, "caseSensitive": true},\n'
    ' "extractionPatterns": [{"name": "p", "pattern": "^(token_[0-9])=(.*)$"}, {"name": "broken", "pattern": "("}]}'
)
_FILE_RULES = replace(
    RULES.with_keywords("Token_1", "token_2", "token_", group="mine"),
    patterns=(replace(RULES.patterns[0], name="p", regex="^(token_[0-9])=(.*)$", needs=None),),
    ignored_values=("ABC", "kkk"), max_length=30, case_sensitive=True,
)


def _file_findings() -> str:
    """Case matters for keywords; the listed texts meet the folded value as they stand."""
    tests = sql._ignored("value", _FILE_RULES)
    tests["ignored_text"] = "contains(lower(value), 'ABC') OR contains(lower(value), 'kkk')"
    test = " OR ".join(f"({t})" for t in tests.values())
    return BASE + f""", fk AS ({sql._keywords(_FILE_RULES)})
SELECT file, key, count(DISTINCT value) AS change_count, CAST(sum(hits) AS BIGINT) AS total_occurrences FROM (
  SELECT f.*, (SELECT count(*) FROM fk WHERE contains(f.line, fk.keyword)) AS hits
  FROM ({sql._kv('added', _FILE_RULES)}) f WHERE NOT ({test})) WHERE hits > 0 GROUP BY file, key"""


@query(_file_findings())
def case_rules_of_a_file(spark, sf_dir):
    """A scan by the rules of a JSON file: its lists replace the defaults, its settings are merged."""
    path = new_path(spark, "rules")
    spark.createDataFrame([(FILE_RULES,)], "value STRING").coalesce(1).write.text(path)
    rules = load_rules(spark, path)
    rows = agg.secrets(scan.scan_history(case_lines(spark, sf_dir), rules), rules)
    return rows.select("file", "key", "change_count", "total_occurrences")


@query(
    BASE + """SELECT file AS "File", key AS "Key", count(DISTINCT value) AS "ChangeCount",
  CAST(sum(hits) AS BIGINT) AS "TotalOccurrences", count(DISTINCT author) AS "AuthorCount" FROM h GROUP BY file, key"""
)
def case_flat_csv(spark, sf_dir):
    """The CSV with its texts made flat: every field where it belongs, whatever the values hold."""
    path = new_path(spark, "csv")
    records.write_csv(csv_view(found(spark, sf_dir), default_rules()), path, quoting="flat")
    rows = records.csv_secrets(records.read_csv(spark, path))
    return rows.select("File", "Key", "ChangeCount", "TotalOccurrences", "AuthorCount")


_USABLE = """, u AS (SELECT DISTINCT value FROM h WHERE value <> '' AND NOT contains(value, 'REMOVED')),
ul AS (SELECT list(value ORDER BY length(value) DESC, value) AS vs FROM u),
r AS (SELECT w.*, list_reduce(list_prepend(line, vs), lambda t, v: replace(t, v, '***REMOVED***')) AS done FROM w, ul)
"""


@query(BASE + _USABLE + "SELECT seq, sha256(done) AS text_hash FROM r")
def case_redacted_table(spark, sf_dir):
    """Redacted lines written as a table of their own and read again."""
    lines = case_lines(spark, sf_dir).select("seq", "file", "line")
    path = new_path(spark, "redacted")
    done = redact.redact_lines(lines, usable_values(found(spark, sf_dir)), ["seq"])
    records.write_redacted(done, path, "line")
    return spark.read.parquet(path).select("seq", text.fingerprint(F.col("line")).alias("text_hash"))


@query(
    BASE + _USABLE + """SELECT (SELECT count(*) FROM u) AS secrets_removed, (SELECT count(*) + 99 FROM u) // 100 AS patterns_used,
  'history' AS source, count(*) AS texts, count(*) FILTER (done <> line) AS texts_modified,
  count(DISTINCT CASE WHEN done <> line THEN file END) AS files_modified FROM r"""
)
def case_redact_outcome(spark, sf_dir):
    rows = found(spark, sf_dir)
    lines = case_lines(spark, sf_dir).select("seq", "file", "line")
    done = redact.redact_lines(lines, usable_values(rows), ["seq"])
    return redact.redact_outcome(done, rows)


@query(BASE + _USABLE + "SELECT file, count(*) AS texts_modified FROM r WHERE done <> line GROUP BY file")
def case_redact_changed_files(spark, sf_dir):
    """The files that a redaction changes."""
    lines = case_lines(spark, sf_dir).select("seq", "file", "line")
    return redact.changed_files(redact.redact_lines(lines, usable_values(found(spark, sf_dir)), ["seq"]))


_MORE = """SELECT '{0}' AS section, {0} AS name, count(*) AS count,
  greatest((SELECT count(DISTINCT {0}) FROM h) - 5, 0) AS remaining FROM h GROUP BY {0} ORDER BY count DESC, {0} LIMIT 5"""


@query(BASE + f"SELECT * FROM ({_MORE.format('author')}) UNION ALL SELECT * FROM ({_MORE.format('key')})")
def case_top_with_more(spark, sf_dir):
    """The first five authors and keys, and how many more there are."""
    rows = found(spark, sf_dir)
    return report.top_with_more(rows, "author").unionByName(report.top_with_more(rows, "key"))


_BYTES = replace(RULES, length_in_bytes=True)
_BY_BYTES = sql._any_ignored("value", RULES).replace("length(value) NOT BETWEEN", "strlen(value) NOT BETWEEN")


@query(BASE + f"SELECT kind, count(*) AS n FROM x WHERE NOT ({_BY_BYTES}) GROUP BY kind")
def case_lengths_in_bytes(spark, sf_dir):
    """Values that pass the tests when their length counts bytes."""
    rows = scan.judged(extracted(spark, sf_dir), _BYTES)
    return rows.groupBy("kind").agg(F.count("*").alias("n"))
