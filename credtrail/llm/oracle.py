"""The results of the queries of this folder in DuckDB's SQL, by their definitions."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11 = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      '{_UPPER}', '{_LOWER}') AS key FROM lines),
found AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (
  SELECT k.*, f.owner IS NOT NULL AND f.owner <> k.doc_id AS gone
  FROM keyed k LEFT JOIN found f ON k.key = f.key AND length(k.key) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_ID = "CAST(doc_id AS VARCHAR)"
_NEXT = f"xor(c, CASE WHEN k % 8 = 0 THEN CAST(ascii(substr({_ID}, CAST(k // 8 + 1 AS INT), 1)) AS BIGINT) ELSE 0 END)"

#: CRC-32 of the decimal id, bit by bit.
_CRC = f"""xor(4294967295::BIGINT, list_reduce(
  list_prepend(4294967295::BIGINT, range(0, 8 * strlen({_ID}))),
  lambda c, k: xor({_NEXT} >> 1, 3988292384::BIGINT * ({_NEXT} & 1))))"""

OP12 = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS presented
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, presented) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
  SELECT lang, n, 0 AS lev, pos, leaf AS node FROM placed
  UNION ALL
  SELECT lang, any_value(n), any_value(lev) + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos))
  FROM nodes WHERE (1::BIGINT << lev) < n GROUP BY lang, pos // 2),
subroots AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE pos = 0 AND (1::BIGINT << lev) >= n),
top AS (
  SELECT n, 0 AS lev, pos, subroot AS node FROM subroots
  UNION ALL
  SELECT any_value(n), any_value(lev) + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos))
  FROM top WHERE (1::BIGINT << lev) < n GROUP BY pos // 2),
roots AS (SELECT node AS root FROM top WHERE pos = 0 AND (1::BIGINT << lev) >= n),
rows_ AS (
  SELECT row_number() OVER () AS r, p.*, s.subroot, s.pos AS top_at, s.n AS top_n
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang),
steps AS (
  SELECT r, q.lev AS ord, (rows_.pos >> q.lev) & 1 AS is_right, s.node AS sibling
  FROM rows_ JOIN (SELECT DISTINCT lang, lev FROM nodes WHERE (1::BIGINT << lev) < n) q
    ON rows_.lang IS NOT DISTINCT FROM q.lang
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM rows_.lang AND s.lev = q.lev
    AND s.pos = xor(rows_.pos >> q.lev, 1)
  UNION ALL
  SELECT r, 1000 + q.lev, (rows_.top_at >> q.lev) & 1, s.node
  FROM rows_ CROSS JOIN (SELECT DISTINCT lev FROM top WHERE (1::BIGINT << lev) < n) q
  LEFT JOIN top s ON s.lev = q.lev AND s.pos = xor(rows_.top_at >> q.lev, 1)),
paths AS (
  SELECT r, string_agg(sibling, '' ORDER BY ord) AS proof,
    list(CASE WHEN sibling IS NULL THEN '0' WHEN is_right = 0 THEN '1' || sibling ELSE '2' || sibling END ORDER BY ord) AS path
  FROM steps GROUP BY r),
done AS (
  SELECT rows_.*, root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(presented, coalesce(path, [])), lambda acc, x:
      CASE x[1] WHEN '0' THEN sha256(acc) WHEN '1' THEN sha256(acc || x[2:]) ELSE sha256(x[2:] || acc) END) AS folded_root
  FROM rows_ LEFT JOIN paths USING (r) CROSS JOIN roots)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done
"""

OP13 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'),
                   lambda t: translate(t, '{_UPPER}', '{_LOWER}')) AS terms FROM documents),
words AS (SELECT r, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 3),
groups_ AS (SELECT DISTINCT lang, source FROM docs),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM groups_ g JOIN kept k ON g.lang = k.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL) c
    ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT c.lang, c.source, c.term, c.n,
    1 + (1000000000::HUGEINT * (c.n + 1)) // (sum(c.n) OVER (PARTITION BY c.lang, c.source) + v.v) AS p
  FROM counts c JOIN v ON c.lang = v.lang),
base AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL) JOIN v USING (lang)),
distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
pairs AS (
  SELECT g.lang, g.source, o.source AS item, coalesce(d.value, 0) AS value
  FROM groups_ g JOIN groups_ o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN distances d ON d.lang = g.lang AND d.source = g.source AND d.item = o.source),
more AS (
  SELECT s.lang, s.source, s.term AS item, ((s.p - q) * (s.p - q)) // q AS value
  FROM shares s JOIN base b ON s.lang = b.lang AND s.term = b.term WHERE s.n > 0 AND s.p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value FROM more)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank
FROM ranked QUALIFY part = 'pair' OR rank <= 200
"""

LLM_ORACLE: dict[str, str] = {
    "op11_line_index": OP11,
    "op12_merkle_manifest": OP12,
    "op13_source_divergence": OP13,
}
