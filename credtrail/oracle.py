"""SQL for DuckDB with the results the queries must have.

Written from the rules alone, with regexes in their first dialect and plain
``GROUP BY`` and windows; it shares only the fixed lists with the library.
"""

from __future__ import annotations

from credtrail.functions.text import WHITE_SPACE
from credtrail.queries import COMMIT_LINES
from credtrail.rules import INLINE_ASSIGNMENT, Rules, alternative_rules, default_rules


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SPACE = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)


def _trim(expr: str) -> str:
    return f"trim({expr}, {SPACE})"


def _mask(v: str) -> str:
    return (
        f"CASE WHEN length({v}) <= 4 THEN '****' ELSE substr({v}, 1, 2) || "
        f"repeat('*', least(length({v}) - 4, 16)) || right({v}, 2) END"
    )


SHOWN = f"{_mask('value')} AS masked, sha256(value) AS value_hash"


def _ignored(v: str, rules: Rules) -> dict[str, str]:
    words = "'password','secret','token','key','credential','auth','pass','pwd'"
    starts = "func |return |if |for |range |make\\(|append\\(|new\\(|len\\("
    texts = " OR ".join(f"contains(lower({v}), {_s(t.lower())})" for t in rules.ignored_values)
    return {
        "length": f"length({v}) NOT BETWEEN {rules.min_length} AND {rules.max_length}",
        "code": (
            f"(contains({v},'(') AND contains({v},')')) OR "
            f"(contains({v},'[') AND contains({v},']')) OR "
            f"starts_with({v},'{{') OR ends_with({v},'}}') OR "
            f"length({v}) - length(replace({v},'.','')) > 2 OR "
            f"regexp_matches({v}, '^[A-Za-z0-9_]+\\.[A-Z][^.]*\\z') OR "
            f"regexp_matches({v}, '^({starts})')"
        ),
        "url": f"regexp_matches(lower({v}), '^(https?://|ftp://|ssh://|file://|mailto:)')",
        "common_word": f"lower({v}) IN ({words})",
        "ignored_text": texts,
    }


def _any_ignored(v: str, rules: Rules) -> str:
    return " OR ".join(f"({t})" for t in _ignored(v, rules).values())


def _reason(v: str, rules: Rules) -> str:
    whens = " ".join(f"WHEN {t} THEN '{n}'" for n, t in _ignored(v, rules).items())
    return f"CASE {whens} ELSE 'kept' END"


def _kv(source: str, rules: Rules, fallthrough: bool = False, line: str = "line") -> str:
    """Rows of ``source`` with pattern, key and value of the first match."""
    picks = {"pattern": "", "key": "", "value": ""}
    for p in rules.patterns:
        value = _trim(f"regexp_extract({line}, {_s(p.regex)}, {p.value_group})")
        key = _trim(f"regexp_extract({line}, {_s(p.regex)}, 1)")
        test = f"regexp_matches({line}, {_s(p.regex)})"
        if fallthrough:
            test += f" AND NOT ({_any_ignored(value, rules)})"
        picks["pattern"] += f" WHEN {test} THEN {_s(p.name)}"
        picks["key"] += f" WHEN {test} THEN {key}"
        picks["value"] += f" WHEN {test} THEN {value}"
    cols = ", ".join(f"CASE{body} END AS {name}" for name, body in picks.items())
    return f"SELECT * FROM (SELECT *, {cols} FROM {source}) WHERE pattern IS NOT NULL"


def _keywords(rules: Rules) -> str:
    rows = ", ".join(f"({i}, {_s(g)}, {_s(k)})" for i, g, k in rules.keywords)
    return f"SELECT * FROM (VALUES {rows}) AS t(kw_idx, grp, keyword)"


def _wanted_file(rules: Rules) -> str:
    tests = []
    for g in rules.ignored_files:
        if "**" in g:
            tests.append(f"starts_with(file, {_s(g.split('**')[0])})")
        elif g.startswith("*."):
            tests.append(f"ends_with(file, {_s(g[1:])})")
        else:
            tests.append(f"file = {_s(g)}")
    tests += [f"ends_with(file, {_s(e)})" for e in rules.excluded_extensions]
    return "NOT (" + " OR ".join(tests) + ")"


def _findings(source: str, rules: Rules) -> str:
    """Findings with ``hits`` and ``kw_first``."""
    return f"""SELECT f.*, k.hits, k.kw_first FROM
      (SELECT * FROM ({_kv(source, rules)}) WHERE NOT ({_any_ignored('value', rules)})) f
      JOIN (SELECT l.line, count(*) AS hits, min(kw_idx) AS kw_first
            FROM (SELECT DISTINCT line FROM {source}) l
            JOIN kw ON contains(lower(l.line), lower(kw.keyword)) GROUP BY l.line) k
      USING (line)"""


RULES = default_rules()
LINES = COMMIT_LINES.replace("AS STRING", "AS VARCHAR")

BASE = f"""WITH c AS ({LINES}),
kw AS ({_keywords(RULES)}),
added AS (SELECT * FROM c WHERE sign = '+' AND {_wanted_file(RULES)}),
h AS ({_findings('added', RULES)}),
"""

SNAPSHOT = f"""snap AS (SELECT file, line, max(seq) AS seq FROM c GROUP BY file, line
  HAVING arg_max(sign, seq) = '+'),
snap_lines AS (SELECT * FROM snap WHERE {_wanted_file(RULES)}),
cur AS (SELECT *, 'current' AS commit, 'current' AS author,
  TIMESTAMP '2030-01-01 00:00:00' AS date FROM ({_findings('snap_lines', RULES)})),
"""

ENTRIES = """e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, key, value
  ORDER BY kw_first, seq) AS rn FROM h) WHERE rn = 1),
et AS (SELECT e.*, kw.keyword AS type FROM e JOIN kw ON kw.kw_idx = e.kw_first),
"""

SECRETS = """s AS (SELECT g.*, kw.keyword AS type FROM (
  SELECT file, key, count(DISTINCT value) AS change_count,
    CAST(sum(hits) AS BIGINT) AS total_occurrences,
    count(DISTINCT author) AS author_count, count(DISTINCT commit) AS commit_count,
    min(date) AS first_seen, max(date) AS last_seen, min(kw_first) AS k
  FROM h GROUP BY file, key) g JOIN kw ON kw.kw_idx = g.k),
"""

MERGED = """mv AS (SELECT file, key, value,
    max(src = 0) AS in_current, max(src = 1) AS in_history,
    max(CASE WHEN src = 0 THEN 1 ELSE 0 END)
      + CAST(coalesce(sum(CASE WHEN src = 1 THEN hits END), 0) AS BIGINT) AS occurrences,
    CAST(coalesce(sum(CASE WHEN src = 1 THEN hits END), 0) AS BIGINT) AS history_occurrences,
    coalesce(min(CASE WHEN src = 0 THEN date END), min(date)) AS first_seen,
    coalesce(max(CASE WHEN src = 0 THEN date END), max(date)) AS last_seen,
    min(CASE WHEN src = 1 THEN date END) AS history_first,
    max(CASE WHEN src = 1 THEN date END) AS history_last,
    min(CASE WHEN src = 0 THEN kw_first END) AS kw0,
    min(CASE WHEN src = 1 THEN kw_first END) AS kw1
  FROM (SELECT 0 AS src, file, key, value, hits, kw_first, date FROM cur
        UNION ALL SELECT 1, file, key, value, hits, kw_first, date FROM h)
  GROUP BY file, key, value),
"""

USABLE = """u AS (SELECT DISTINCT value FROM h
  WHERE value <> '' AND NOT contains(value, 'REMOVED')),
"""

# Assignments in the lines of documents.
INLINE = r"""([A-Za-z_][\w.-]*)\s*=\s*"([^"]+)\""""
DOCS = f"""WITH dl AS (SELECT doc_id, source || '/' || doc_id AS file,
    unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
kv AS (SELECT *, {_trim(f"regexp_extract(line, {_s(INLINE)}, 1)")} AS key,
    {_trim(f"regexp_extract(line, {_s(INLINE)}, 2)")} AS value
  FROM dl WHERE contains(lower(line), 'token') AND regexp_matches(line, {_s(INLINE)})),
d AS (SELECT * FROM kv WHERE NOT ({_any_ignored('value', RULES)})),
dv AS (SELECT DISTINCT value FROM d WHERE value <> '' AND NOT contains(value, 'REMOVED')),
dp AS (SELECT coalesce(string_agg(regexp_escape(value), '|' ORDER BY length(value) DESC, value),
    '[^\\s\\S]') AS p FROM dv),
"""


def _base(body: str, *extra: str) -> str:
    return (BASE + "".join(extra)).rstrip().rstrip(",") + "\n" + body


def _docs(body: str) -> str:
    return DOCS.rstrip().rstrip(",") + "\n" + body


def _top(source: str, by: str, limit: bool = True) -> str:
    tail = f" ORDER BY count DESC, {by}" + (" LIMIT 10" if limit else "")
    return f"SELECT {by}, count(*) AS count FROM {source} GROUP BY {by}{tail}"


def _cut(text: str, n: int) -> str:
    return f"CASE WHEN length({text}) > {n} THEN substr({text}, 1, {n - 3}) || '...' ELSE {text} END"


def _stats(entries: str, values: str, authors: str, files: str, types: str) -> str:
    return f"""
SELECT 'summary' AS section, name, CAST(count AS BIGINT) AS count FROM (
  SELECT 'total_entries' AS name, {entries} AS count
  UNION ALL SELECT 'unique_secrets', (SELECT count(*) FROM s)
  UNION ALL SELECT 'unique_values', {values})
UNION ALL SELECT 'authors', author, count FROM ({authors})
UNION ALL SELECT 'files', file, count FROM ({files})
UNION ALL SELECT 'types', type, count FROM ({types})"""


SECRET_AUTHORS = "(SELECT DISTINCT file, key, author FROM h)"
VALUE_SUM = "(SELECT sum(change_count) FROM s)"

REDACTED_DOCS = """SELECT doc_id, sha256(r) AS text_hash, r <> text AS modified FROM (
  SELECT doc_id, text, regexp_replace(text, (SELECT p FROM dp), '***REMOVED***', 'g') AS r
  FROM documents)"""

LOG_DATE = "strftime(date, '%Y-%m-%dT%H:%M:%SZ')"

ALT = alternative_rules()
ALT_BASE = f"""WITH c AS ({LINES}), kw AS ({_keywords(ALT)}),
added AS (SELECT * FROM c WHERE sign = '+' AND {_wanted_file(ALT)}),
h AS ({_findings('added', ALT)}),
{SECRETS}"""

TYPE_GROUP = "(SELECT keyword, arg_min(grp, kw_idx) AS grp FROM kw GROUP BY keyword)"

MERGED_SECRETS = """SELECT m.* EXCLUDE (k), kw.keyword AS type FROM (
  SELECT file, key, count(*) AS change_count, CAST(sum(occurrences) AS BIGINT) AS total_occurrences,
    min(first_seen) AS first_seen, max(last_seen) AS last_seen, coalesce(min(kw0), min(kw1)) AS k
  FROM mv GROUP BY file, key) m JOIN kw ON kw.kw_idx = m.k"""

HISTORY_WINS = """SELECT m.* EXCLUDE (k), kw.keyword AS type FROM (
  SELECT file, key,
    count(*) FILTER (in_history OR NOT known) AS change_count,
    CAST(sum(CASE WHEN known THEN history_occurrences ELSE occurrences END) AS BIGINT)
      AS total_occurrences,
    min(CASE WHEN known THEN history_first ELSE first_seen END) AS first_seen,
    max(CASE WHEN known THEN history_last ELSE last_seen END) AS last_seen,
    min(CASE WHEN known THEN kw1 ELSE kw0 END) AS k
  FROM (SELECT *, bool_or(in_history) OVER (PARTITION BY file, key) AS known FROM mv)
  GROUP BY file, key) m JOIN kw ON kw.kw_idx = m.k"""

REPORT_TOP = """top5 AS (SELECT * FROM s ORDER BY change_count DESC, file, key LIMIT 5),
"""

DELTAS = """pk AS (SELECT DISTINCT keyword FROM kw),
occ AS (SELECT commit, file, keyword, CASE WHEN sign = '+' THEN 1 ELSE -1 END AS sg,
    CAST((length(line) - length(replace(line, keyword, ''))) / length(keyword) AS INT) AS n
  FROM c JOIN pk ON contains(line, keyword) WHERE """ + "NOT (" + " OR ".join(
    f"ends_with(file, {_s(e)})" for e in RULES.excluded_extensions
) + """)),
deltas AS (SELECT commit, file, keyword, sum(n * sg) AS delta FROM occ GROUP BY ALL),
"""

INLINE_RULES = RULES.with_patterns(INLINE_ASSIGNMENT)

ORACLE: dict[str, str] = {
    "extract_kv": _base(
        f"SELECT seq, pattern, key, {SHOWN} FROM ({_kv('c', RULES)})"
    ),
    "extract_kv_fallthrough": _base(
        f"SELECT seq, pattern, key, {SHOWN} FROM ({_kv('c', RULES, True)})"
    ),
    "extract_inline": _docs(
        f"SELECT key, {SHOWN}, n FROM (SELECT key, value, count(*) AS n FROM d GROUP BY ALL)"
    ),
    "document_scan": _docs(
        f"SELECT doc_id, file, CAST(line_no AS INT) AS line_no, key, {SHOWN} FROM d"
    ),
    "conversation_scan": f"""WITH kw AS ({_keywords(RULES)}),
l AS (SELECT role, unnest(string_split(text, chr(10))) AS line FROM conversations)
SELECT role, count(*) AS lines,
  count(*) FILTER (EXISTS (SELECT 1 FROM kw WHERE contains(lower(line), keyword))) AS keyword_lines
FROM l GROUP BY role""",
    "page_scan": "WITH l AS (SELECT unnest(string_split(html, chr(10))) AS line FROM pages) "
    f"SELECT key, {_reason('value', RULES)} AS reason, count(*) AS n "
    f"FROM ({_kv('l', INLINE_RULES)}) GROUP BY ALL",
    "filter_ignored_files": _base(
        f"SELECT file, count(*) AS n FROM c WHERE {_wanted_file(RULES)} GROUP BY file"
    ),
    "filter_file_size": "SELECT doc_id, CAST(strlen(text) AS INT) AS size FROM documents "
    "WHERE strlen(text) <= 4096",
    "filter_added_lines": _base(
        "SELECT commit, count(*) AS n FROM c WHERE sign = '+' GROUP BY commit"
    ),
    "keyword_hits": _base(
        "SELECT seq, kw_idx, keyword FROM c JOIN kw ON contains(lower(line), keyword) "
        "WHERE sign = '+'"
    ),
    "keyword_counts": _base(
        "SELECT keyword, count(*) AS n FROM h JOIN kw ON contains(lower(line), keyword) "
        "GROUP BY keyword"
    ),
    "pickaxe_commits": _base(
        "SELECT keyword, count(*) AS touched, count(*) FILTER (delta <> 0) AS changed "
        "FROM deltas GROUP BY keyword",
        DELTAS,
    ),
    "pickaxe_secrets": _base(
        """SELECT file, key, change_count, total_occurrences, kw.keyword AS type FROM (
  SELECT h.file, h.key, count(DISTINCT h.value) AS change_count, count(*) AS total_occurrences,
    min(kw.kw_idx) AS k
  FROM h JOIN kw ON contains(lower(h.line), kw.keyword)
  JOIN deltas d ON d.commit = h.commit AND d.file = h.file AND d.keyword = kw.keyword
    AND d.delta <> 0
  GROUP BY h.file, h.key) g JOIN kw ON kw.kw_idx = g.k""",
        DELTAS,
    ),
    "reject_breakdown": _base(
        f"SELECT {_reason('value', RULES)} AS reason, count(*) AS n "
        f"FROM ({_kv('added', RULES)}) GROUP BY 1"
    ),
    "masked_findings": _base(f"SELECT seq, commit, file, key, CAST(hits AS INT) AS hits, {SHOWN} FROM h"),
    "type_by_keyword": _base("SELECT file, key, type FROM s", SECRETS),
    "type_by_group": _base(
        f"SELECT s.file, s.key, coalesce(g.grp, 'unknown') AS type_group FROM s "
        f"LEFT JOIN {TYPE_GROUP} g ON g.keyword = s.key",
        SECRETS,
    ),
    "findings_dedup": _base(
        f"SELECT file, key, type, commit, author, date, {SHOWN} FROM et", ENTRIES
    ),
    "values_agg": _base(
        f"""SELECT v.* EXCLUDE (value, k), kw.keyword AS type, {SHOWN} FROM (
  SELECT file, key, value, CAST(sum(hits) AS BIGINT) AS occurrences,
    count(DISTINCT commit) AS commit_count, count(DISTINCT author) AS author_count,
    min(kw_first) AS k, min(date) AS first_seen, max(date) AS last_seen
  FROM h GROUP BY file, key, value) v JOIN kw ON kw.kw_idx = v.k"""
    ),
    "value_commits": _base(
        f"SELECT file, key, {SHOWN}, commit, author, CAST(sum(hits) AS BIGINT) AS occurrences "
        "FROM h GROUP BY file, key, value, commit, author"
    ),
    "secrets_agg": _base("SELECT * EXCLUDE (k) FROM s", SECRETS),
    "secrets_alternative_rules": ALT_BASE.rstrip().rstrip(",")
    + "\nSELECT file, key, type, change_count, total_occurrences FROM s",
    "secret_authors": _base("SELECT DISTINCT file, key, author FROM h"),
    "secrets_by_file": _base("SELECT file, key, change_count FROM s", SECRETS),
    "secret_timeline": _base(
        f"""SELECT file, key, row_number() OVER w AS version, {_mask('value')} AS masked,
  sha256(value) AS value_hash, sha256(lag(value) OVER w) AS previous_hash, first_seen, last_seen,
  lead(first_seen) OVER w AS replaced_at, occurrences
FROM (SELECT file, key, value, min(date) AS first_seen, max(date) AS last_seen,
  CAST(sum(hits) AS BIGINT) AS occurrences FROM h GROUP BY file, key, value)
WINDOW w AS (PARTITION BY file, key ORDER BY first_seen, value)"""
    ),
    "scan_summary": _base(
        "SELECT count(*) AS secrets_found, CAST(coalesce(sum(change_count), 0) AS BIGINT) "
        "AS total_values, CAST(coalesce(sum(total_occurrences), 0) AS BIGINT) "
        "AS total_occurrences FROM s",
        SECRETS,
    ),
    "unique_values": _base(
        "SELECT count(*) AS unique_values, count(DISTINCT value) AS global_unique_values "
        "FROM (SELECT DISTINCT file, key, value FROM h)"
    ),
    "stats_entry_authors": _base(_top("et", "author"), ENTRIES),
    "stats_entry_files": _base(_top("et", "file"), ENTRIES),
    "stats_entry_types": _base(_top("et", "type", False), ENTRIES),
    "stats_secret_authors": _base(_top(SECRET_AUTHORS, "author")),
    "stats_secret_files": _base(_top("s", "file"), SECRETS),
    "stats_secret_types": _base(_top("s", "type", False), SECRETS),
    "key_counts": _base(_top("e", "key", False), ENTRIES),
    "file_counts": _base(_top("e", "file", False), ENTRIES),
    "detect_source": _base(
        """SELECT a AS has_current, b AS has_history, CASE WHEN a AND NOT b THEN 'current'
  WHEN b AND NOT a THEN 'history' ELSE 'both' END AS source
FROM (SELECT (SELECT count(*) FROM cur) > 0 AS a, (SELECT count(*) FROM h) > 0 AS b)""",
        SNAPSHOT,
    ),
    "findings_by_date_range": _base(
        """SELECT CAST(date AS DATE) AS day, count(*) AS lines,
  CAST(sum(hits) AS BIGINT) AS occurrences FROM h
WHERE date >= TIMESTAMP '2024-01-08' AND date < TIMESTAMP '2024-01-15' GROUP BY 1"""
    ),
    "gate": _base("SELECT count(*) > 0 AS found, count(*) AS n FROM h"),
    "current_secrets": _base(
        """SELECT c2.file, c2.key, kw.keyword AS type, n AS change_count, n AS total_occurrences
FROM (SELECT file, key, count(DISTINCT value) AS n, min(kw_first) AS k FROM cur
  GROUP BY file, key) c2 JOIN kw ON kw.kw_idx = c2.k""",
        SNAPSHOT,
    ),
    "scan_both_merge": _base(MERGED_SECRETS, SNAPSHOT, MERGED),
    "scan_both_history_wins": _base(HISTORY_WINS, SNAPSHOT, MERGED),
    "scan_both_authors": _base(
        """SELECT file, key, count(DISTINCT author) AS author_count FROM (
  SELECT file, key, author FROM cur UNION ALL SELECT file, key, author FROM h) GROUP BY file, key""",
        SNAPSHOT,
    ),
    "findings_union": _base(
        f"""SELECT file, key, {SHOWN}, commit, author, kw.keyword AS type FROM (
  SELECT *, row_number() OVER (PARTITION BY file, key, value ORDER BY src, kw_first, seq) AS rn
  FROM (SELECT 0 AS src, file, key, value, kw_first, seq, commit, author FROM cur
        UNION ALL SELECT 1, file, key, value, kw_first, seq, commit, author FROM h)) x
JOIN kw ON kw.kw_idx = x.kw_first WHERE rn = 1""",
        SNAPSHOT,
    ),
    "still_live": _base(
        f"""SELECT file, key, {SHOWN}, history_occurrences, history_first AS first_seen,
  history_last AS last_seen FROM mv WHERE in_current AND in_history""",
        SNAPSHOT,
        MERGED,
    ),
    "only_in_history": _base(
        f"SELECT file, key, {SHOWN}, history_occurrences FROM mv WHERE NOT in_current",
        SNAPSHOT,
        MERGED,
    ),
    "values_longest_first": _base(
        f"SELECT CAST(length(value) AS INT) AS n_chars, {SHOWN} FROM u", USABLE
    ),
    "pattern_batches": _base(
        """SELECT CAST(b AS INT) AS batch, CAST(count(*) AS INT) AS n,
  sha256('(' || string_agg(regexp_replace(value, '([\\\\.^$|?*+()\\[\\]{}])', '\\\\\\1', 'g'),
    '|' ORDER BY rn) || ')') AS pattern_hash
FROM (SELECT value, rn, (rn - 1) // 100 AS b FROM (
  SELECT value, row_number() OVER (ORDER BY length(value) DESC, value) AS rn FROM u))
GROUP BY b""",
        USABLE,
    ),
    "redact_plan": _base(
        """SELECT n AS n_values, (n + 99) // 100 AS n_patterns, 'history' AS source,
  (SELECT count(DISTINCT file) FROM h) AS n_files FROM (SELECT count(*) AS n FROM u)""",
        USABLE,
    ),
    "redact_preview": _base(
        f"""SELECT CAST(row_number() OVER (ORDER BY length(value) DESC, value) AS INT) AS rank,
  {_mask('value')} AS masked FROM (SELECT value FROM u ORDER BY length(value) DESC, value LIMIT 10)""",
        USABLE,
    ),
    "redact_lines": _base(
        """SELECT seq, file, sign, r AS redacted, r <> line AS modified FROM (
  SELECT seq, file, sign, line, list_reduce(list_prepend(line, (SELECT list(value
    ORDER BY length(value) DESC, value) FROM u)),
    lambda acc, x: replace(acc, x, '***REMOVED***')) AS r FROM c)""",
        USABLE,
    ),
    "redact_overlaps": """WITH w AS (
  SELECT list(w ORDER BY length(w) DESC, w) AS ws FROM (
    SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{13,}')) AS w FROM documents))
SELECT doc_id, sha256(r) AS text_hash, r <> text AS modified FROM (
  SELECT doc_id, text, list_reduce(list_prepend(text, ws),
    lambda done, x: replace(done, x, '***REMOVED***')) AS r FROM documents, w)""",
    "redact_documents_fold": _docs(REDACTED_DOCS),
    "redact_documents_anchor": _docs(REDACTED_DOCS),
    "redact_documents_pattern": _docs(REDACTED_DOCS),
    "redact_named_files": _docs(
        REDACTED_DOCS + " WHERE source || '/' || doc_id IN (SELECT file FROM d) "
        "AND strlen(text) <= 1048576"
    ).replace("  FROM documents)", "  , source FROM documents)"),
    "redact_summary": _docs(
        f"SELECT count(*) AS texts, count(*) FILTER (modified) AS texts_modified "
        f"FROM ({REDACTED_DOCS})"
    ),
    "redact_residual": "SELECT CAST(0 AS BIGINT) AS values_left, CAST(0 AS BIGINT) AS findings_left",
    "secrets_csv_view": _base(
        f"""SELECT s.file AS File, s.key AS Key, type AS Type, change_count AS ChangeCount,
  total_occurrences AS TotalOccurrences, a.names AS Authors, author_count AS AuthorCount,
  CAST(CAST(first_seen AS DATE) AS VARCHAR) AS FirstSeen,
  CAST(CAST(last_seen AS DATE) AS VARCHAR) AS LastSeen,
  CAST((epoch_us(date_trunc('second', last_seen)) - epoch_us(date_trunc('second', first_seen)))
    // 86400000000 AS INT) AS DaysActive,
  v.masks AS "Values", CAST(0 AS BIGINT) AS Part
FROM s JOIN (SELECT file, key, string_agg(author, ', ' ORDER BY author) AS names
    FROM {SECRET_AUTHORS} GROUP BY file, key) a USING (file, key)
  JOIN (SELECT file, key, string_agg({_mask('value')}, ' | ' ORDER BY first, value) AS masks
    FROM (SELECT file, key, value, min(date) AS first FROM h GROUP BY ALL)
    GROUP BY file, key) v USING (file, key)""",
        SECRETS,
    ),
    "stats_long": _base(
        _stats(
            VALUE_SUM, VALUE_SUM, _top(SECRET_AUTHORS, "author"), _top("s", "file"),
            _top("s", "type", False),
        ),
        SECRETS,
    ),
    "stats_long_entries": _base(
        _stats(
            "(SELECT count(*) FROM et)", VALUE_SUM, _top("et", "author"), _top("et", "file"),
            _top("et", "type", False),
        ),
        SECRETS,
        ENTRIES,
    ),
    "report_authors": _base(
        f"""SELECT author, count, CAST(least(count * 50 // greatest((SELECT count(*) FROM et), 1),
  30) AS INT) AS bar_width FROM ({_top('et', 'author')})""",
        ENTRIES,
    ),
    "report_files": _base(
        f"SELECT substr(file, 1, 50) AS file, count FROM ({_top('et', 'file')})", ENTRIES
    ),
    "report_secrets": _base(
        f"""SELECT {_cut('file', 76)} AS file, {_cut('key', 71)} AS key, type, change_count,
  total_occurrences, {_cut('names', 67)} AS authors,
  CAST(CAST(first_seen AS DATE) AS VARCHAR) AS first_day,
  CAST(CAST(last_seen AS DATE) AS VARCHAR) AS last_day,
  greatest((SELECT count(*) FROM s) - 5, 0) AS remaining
FROM top5 JOIN (SELECT file, key, string_agg(author, ', ' ORDER BY author) AS names
  FROM {SECRET_AUTHORS} GROUP BY file, key) USING (file, key)""",
        SECRETS,
        REPORT_TOP,
    ),
    "report_values": _base(
        f"""SELECT file, key, {_cut(_mask('value'), 40)} AS masked, sha256(value) AS value_hash,
  occurrences, {_cut('names', 20)} AS authors, first_seen
FROM (SELECT file, key, value, CAST(sum(hits) AS BIGINT) AS occurrences,
    string_agg(DISTINCT author, ', ' ORDER BY author) AS names, min(date) AS first_seen
  FROM h SEMI JOIN top5 USING (file, key) GROUP BY file, key, value)""",
        SECRETS,
        REPORT_TOP,
    ),
    "git_log_ingest": _base(
        f"""SELECT commit, author, {LOG_DATE} AS date_raw, file, sign, line, count(*) AS n
FROM c GROUP BY ALL"""
    ),
    "git_log_secrets": _base(
        """SELECT file, key, type, change_count, total_occurrences, author_count,
  strftime(first_seen, '%Y-%m-%dT%H:%M:%SZ') AS first_raw,
  strftime(last_seen, '%Y-%m-%dT%H:%M:%SZ') AS last_raw FROM s""",
        SECRETS,
    ),
    "file_tree_scan": _base(
        f"""SELECT file, key, {SHOWN}, CAST(sum(hits) AS BIGINT) AS occurrences
FROM cur GROUP BY file, key, value""",
        SNAPSHOT,
    ),
    "jsonl_roundtrip": _base(
        f"SELECT file, key, type, commit, author, strftime(date, '%Y-%m-%dT%H:%M:%SZ') AS date_raw, "
        f"{SHOWN} FROM et",
        ENTRIES,
    ),
    "json_roundtrip": _base(
        "SELECT file, key, type, change_count, total_occurrences FROM s", SECRETS
    ),
    "scan_result_roundtrip": _base(
        "SELECT file, key, total_occurrences AS listed_commits, commit_count AS commits, "
        "change_count AS values FROM s",
        SECRETS,
    ),
    "ignored_by_table": _base(
        "SELECT file, count(*) AS n FROM c WHERE NOT ends_with(file, '.md') GROUP BY file"
    ),
    "keyword_groups_hit": _base(
        'SELECT grp AS "group", count(*) AS n FROM h '
        "JOIN kw ON contains(lower(line), keyword) GROUP BY grp"
    ),
    "stream_findings": _base(
        f"SELECT file, key, type, commit, author, date, {SHOWN} FROM et", ENTRIES
    ),
    "stream_current": _base(
        f"SELECT file, key, {SHOWN}, commit, author FROM "
        "(SELECT DISTINCT file, key, value, commit, author FROM cur)",
        SNAPSHOT,
    ),
    "stream_both": _base(
        f"""SELECT file, key, {SHOWN}, commit, author, date, kw.keyword AS type FROM (
  SELECT *, row_number() OVER (PARTITION BY file, key, value ORDER BY src, kw_first, seq) AS rn
  FROM (SELECT 0 AS src, file, key, value, kw_first, seq, commit, author, date FROM cur
        UNION ALL SELECT 1, file, key, value, kw_first, seq, commit, author, date FROM h)) x
JOIN kw ON kw.kw_idx = x.kw_first WHERE rn = 1""",
        SNAPSHOT,
    ),
    "stream_counts": _base(
        " UNION ALL ".join(
            f"SELECT '{s}' AS section, {s} AS name, count(*) AS count FROM et GROUP BY {s}"
            for s in ("author", "file", "type", "key")
        )
        + " UNION ALL SELECT 'total', '', count(*) FROM et",
        ENTRIES,
    ),
    "stream_author_counts": _base(_top("et", "author", False), ENTRIES),
}

ORACLE["stream_days"] = _base(
    "SELECT date_trunc('day', date)::TIMESTAMP AS day, count(*) AS n FROM h GROUP BY 1"
)
ORACLE["csv_roundtrip"] = (
    'SELECT * EXCLUDE ("Part") FROM (' + ORACLE["secrets_csv_view"] + ")"
)

ORACLE["csv_parts_roundtrip"] = _base(
    """SELECT file AS "File", key AS "Key", count(DISTINCT value) AS "ChangeCount",
  CAST(sum(hits) AS BIGINT) AS "TotalOccurrences", count(DISTINCT author) AS authors,
  count(DISTINCT value) AS values FROM h GROUP BY file, key"""
)

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"

# Values as they are listed: those of the first source, then those that only the second has.
_LISTED = """lv AS (SELECT 0 AS src, file, key, value, 1 AS n, 'current' AS authors,
    min(date) AS f, max(date) AS l FROM cur {first} GROUP BY file, key, value
  UNION ALL SELECT 1, file, key, value, CAST(sum(hits) AS BIGINT),
    string_agg(DISTINCT author, ',' ORDER BY author), min(date), max(date)
  FROM h {second} GROUP BY file, key, value),
la AS (SELECT file, key, count(DISTINCT author) AS authors FROM (
  SELECT file, key, author FROM cur {first} UNION ALL SELECT file, key, author FROM h) GROUP BY file, key),
"""
_NESTED = f"""SELECT lv.file, lv.key, m.type, m.change_count, m.total_occurrences,
  CAST(la.authors AS INT) AS authors,
  CAST(row_number() OVER (PARTITION BY lv.file, lv.key ORDER BY src, f, value) - 1 AS INT) AS place, {SHOWN},
  CAST(n AS INT) AS listed_commits, lv.authors AS value_authors,
  {_ISO.format('f')} AS first_raw, {_ISO.format('l')} AS last_raw
FROM lv JOIN la ON la.file = lv.file AND la.key = lv.key
JOIN (@SECRETS) m ON m.file = lv.file AND m.key = lv.key"""
_MERGE = _LISTED.format(
    first="",
    second="WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.file = h.file AND cur.key = h.key AND cur.value = h.value)",
)
_WINS = _LISTED.format(
    first="WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.file = cur.file AND h.key = cur.key)", second=""
)
ORACLE["scan_both_nested"] = _base(_NESTED.replace("@SECRETS", MERGED_SECRETS), SNAPSHOT, MERGED, _MERGE)
ORACLE["scan_both_history_wins_nested"] = _base(_NESTED.replace("@SECRETS", HISTORY_WINS), SNAPSHOT, MERGED, _WINS)
ORACLE["scan_both_nested_parts"] = _base(
    "SELECT lv.file, lv.key, count(*) AS values, CAST(sum(n) AS BIGINT) AS listed_commits, "
    "any_value(la.authors) AS authors, CAST(0 AS BIGINT) AS incomplete "
    "FROM lv JOIN la ON la.file = lv.file AND la.key = lv.key GROUP BY lv.file, lv.key",
    SNAPSHOT,
    _MERGE,
)
ORACLE["scan_both_summary"] = _base(
    "SELECT count(*) AS secrets_found, CAST(sum(change_count) AS BIGINT) AS total_values, "
    f"CAST(sum(total_occurrences) AS BIGINT) AS total_occurrences FROM ({MERGED_SECRETS})",
    SNAPSHOT,
    MERGED,
)
ORACLE["scan_both_history_wins_summary"] = _base(
    "SELECT count(*) AS secrets_found, (SELECT count(*) FROM (SELECT DISTINCT file, key, value FROM cur)) "
    "+ (SELECT count(*) FROM (SELECT DISTINCT file, key, value FROM h)) AS total_values, "
    f"CAST(sum(total_occurrences) AS BIGINT) AS total_occurrences FROM ({HISTORY_WINS})",
    SNAPSHOT,
    MERGED,
)
ORACLE["indented_result_scan"] = _base(
    "SELECT file, key, type, change_count, total_occurrences, commit_count AS commits, "
    "CAST(0 AS BIGINT) AS bad_lines FROM s",
    SECRETS,
)
ORACLE["unique_values_by_sketch"] = _base(
    "SELECT file, count(DISTINCT (key, value)) AS unique_values, "
    "count(DISTINCT value) AS global_unique_values, true AS within_5_percent FROM h GROUP BY file"
)
ORACLE["findings_in_weeks"] = _base(
    "SELECT week, file, count(*) AS lines, CAST(sum(hits) AS BIGINT) AS occurrences FROM h JOIN range(3) r(week) "
    "ON h.date >= DATE '2024-01-01' + CAST(14 * week AS INT) AND h.date < DATE '2024-01-08' + CAST(14 * week AS INT) "
    "GROUP BY week, file"
)
ORACLE["ignored_by_lists"] = """WITH f AS (
  SELECT lang, source || '/' || doc_id || '.' || lang AS file, n_chars FROM documents),
kept AS (SELECT * FROM f WHERE NOT (
  (lang = 'en' AND (starts_with(file, 'src1/') OR starts_with(file, 'src2')))
  OR (lang = 'de' AND ends_with(file, '.de'))
  OR (lang = 'es' AND (starts_with(file, 'src3/') OR file = '*4.es'
    OR file = (SELECT min(file) FROM f WHERE lang = 'es')))
  OR lang = 'fr'))
SELECT lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS n_chars, min(file) AS first FROM kept GROUP BY lang"""
ORACLE["keyword_table_hits"] = """WITH w AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS keyword FROM benchmark),
l AS (SELECT doc_id, lower(unnest(string_split(text, chr(10)))) AS line FROM documents)
SELECT keyword, count(*) AS lines, count(DISTINCT doc_id) AS docs FROM l JOIN w ON contains(line, keyword) GROUP BY keyword"""
ORACLE["secrets_by_keyword_table"] = _base(
    "SELECT file, key, type, change_count, total_occurrences FROM s", SECRETS
)
