"""Personal data: candidates, boosted trees and calibrated thresholds. DataFrame
functions only; the trees are fitted from counts and applied as Columns.

Generators with high recall propose spans. Those of the four base kinds that pass their test
(parts up to 255, Luhn, number of digits) are always kept. Every candidate is described by
bits of format and context. Counts of each combination of bits, over all documents, are
the training set; it has at most ``2 ** len(FEATURES)`` combinations, however large the
corpus. Labels are weak: what passes its test is personal data, what fails is not, and
candidates of the added kinds are labelled where format or context is plain, else not at
all. Trees of depth two are boosted on logistic loss with one half of the documents; on
the other half every added kind gets the lowest threshold that is precise enough.

A candidate of an added kind is selected at its threshold if no base span overlaps
it and no better candidate does.

Defined cases: null text is empty; offsets count code points; matches of one kind do not
overlap, of different kinds they may; without candidates nothing is added; repeated rows
are judged each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("hidden_email", "local_phone", "secret")
KINDS = (*BASE, *ADDED)

# Possessive forms of the patterns, with the same matches: no part can match less and
# still go on. ``\G`` is the end of the match before, from which a word may go on.
WORD = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{WORD})){WORD}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "hidden_email": r"[A-Za-z0-9._-]{2,40} ?[\[(]at[\])] ?[A-Za-z0-9-]{2,40} ?(?:[\[(]dot[\])]|\.) ?[A-Za-z]{2,10}",
    "local_phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r'(?<=(?:token|secret|passwd|password|api_key) ?[=:] ?")[^"\n]{8,200}(?=")',
}
#: Cheap conditions without which a pattern cannot match.
NEEDS = {
    "email": "contains(text, '@')",
    "ip": r"text RLIKE r'[0-9]\.[0-9]'",
    "card": r"text RLIKE r'[0-9][0-9 -]{10}'",
    "phone": "contains(text, '+')",
    "hidden_email": "(contains(text, '(at') OR contains(text, '[at'))",
    "local_phone": r"text RLIKE r'[ .-][0-9]{3}[ .-][0-9]{4}'",
    "secret": r"""(contains(text, '= "') OR contains(text, ': "') OR contains(text, '="') OR contains(text, ':"'))""",
}
SPAN = "struct<kind:int,s:int,e:int,val:string,before:string,after:string>"

DIGITS = "length(regexp_replace(c.val, r'[^0-9]', ''))"
LUHN = (
    "(c.kind = 2 AND {n} BETWEEN 12 AND 19 AND aggregate("
    "transform(split(reverse(regexp_replace(c.val, r'[^0-9]', '')), ''), (d, i) -> "
    "if(d = '', 0, if(i % 2 = 0, int(d), 2 * int(d) - if(int(d) > 4, 9, 0)))), 0, (a, d) -> a + d) % 10 = 0)"
).format(n=DIGITS)
PARTS = (
    "(c.kind = 1 AND forall(split(c.val, r'\\.'), p -> length(ltrim('0', p)) <= 3 "
    "AND coalesce(try_cast(right(concat('0', ltrim('0', p)), 4) AS int), 0) <= 255))"
)
CONTEXT = r"lower(c.before) RLIKE r'(mail|phone|tel|call|card|visa|pay|addr|host|token|secret|passw|key)'"
HEX = "(length(c.val) >= 32 AND NOT c.val RLIKE r'[^0-9a-fA-F]')"

#: A bit for each, from the lowest on.
FEATURES = (
    *(f"c.kind = {i}" for i in range(len(KINDS))),
    LUHN,
    "c.val RLIKE r'^[3-6]'",
    PARTS,
    f"{DIGITS} BETWEEN 9 AND 15",
    f"{DIGITS} BETWEEN 12 AND 19",
    r"c.before RLIKE r'[\p{L}\p{N}]$'",
    r"c.after RLIKE r'[\p{L}\p{N}]'",
    CONTEXT,
    HEX,
    r"c.val RLIKE r'\.[A-Za-z]{2,}$'",
    r"c.val RLIKE r'[()]'",
)
#: The test of each base kind; plain cases of the others; null is not labelled.
LABEL = f"""CASE c.kind
  WHEN 0 THEN 1
  WHEN 1 THEN int({PARTS})
  WHEN 2 THEN int({LUHN})
  WHEN 3 THEN int({DIGITS} BETWEEN 9 AND 15)
  WHEN 4 THEN 1
  WHEN 5 THEN CASE WHEN {CONTEXT} THEN 1 WHEN c.before RLIKE r'[\\p{{L}}\\p{{N}}]$' THEN 0 END
  WHEN 6 THEN CASE WHEN {HEX} THEN 1 WHEN c.val RLIKE r'^[a-z ]+$' THEN 0 END
END"""

ROUNDS, RATE, SHRINK, PRECISION = 12, 0.5, 1.0, 0.99


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once, though used often: a generator of one row."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def candidates(docs: DataFrame) -> DataFrame:
    """Add ``found``: all candidates of ``text``, from ``docs`` with a text that is not null."""
    pieces = {}
    for kind in KINDS:
        pattern = F.lit(PATTERNS[kind])
        needed = F.expr(NEEDS[kind])
        pieces[f"v_{kind}"] = F.when(needed, F.regexp_extract_all("text", pattern, F.lit(0)))
    rows = _once(docs, **pieces)
    hit = {k: F.coalesce(F.size(f"v_{k}"), F.lit(0)) > 0 for k in KINDS}
    gaps = {f"g_{k}": F.when(hit[k], F.split("text", PATTERNS[k], -1)) for k in KINDS}
    rows = _once(rows, **gaps)
    spans = [F.expr(_spans(i, k)) for i, k in enumerate(KINDS)]
    rows = _once(rows, found=F.concat(*spans))
    return rows.drop(*pieces, *gaps)


def _spans(number: int, kind: str) -> str:
    v, g = f"element_at(v_{kind}, i)", f"element_at(g_{kind}, i)"
    start = f"a.p + length({g})"
    return f"""CASE WHEN size(v_{kind}) > 0 THEN aggregate(
      sequence(1, size(v_{kind})),
      named_struct('p', 0, 'o', cast(array() AS array<{SPAN}>)),
      (a, i) -> named_struct('p', {start} + length({v}), 'o', concat(a.o, array(named_struct(
        'kind', {number}, 's', {start}, 'e', {start} + length({v}), 'val', {v},
        'before', right({g}, 24), 'after', left(element_at(g_{kind}, i + 1), 1))))),
      a -> a.o) ELSE cast(array() AS array<{SPAN}>) END"""


def described(rows: DataFrame) -> DataFrame:
    """Replace ``found`` by spans with their bits and label."""
    bits = " + ".join(f"int(coalesce({f}, false)) * {1 << i}" for i, f in enumerate(FEATURES))
    spans = F.expr(f"transform(found, c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e, 'bits', {bits}, 'label', {LABEL}))")
    return _once(rows, spans=spans).drop("found")


class Trees:
    """Boosted trees of depth two on bits, and a threshold for each added kind."""

    def __init__(self):
        self.trees: list[tuple[int, int, int, tuple[float, ...]]] = []
        self.thresholds: dict[int, float] = {}

    def fit(self, bits: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        on = (bits[:, None] >> np.arange(len(FEATURES)) & 1).astype(bool)
        score = np.zeros(len(bits))
        for _ in range(ROUNDS if len(bits) else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (label - p), weight * p * (1 - p)
            root = _split(on, g, h, np.ones(len(bits), bool))
            low = _split(on, g, h, ~on[:, root])
            high = _split(on, g, h, on[:, root])
            leaf = 2 * on[:, root] + np.where(on[:, root], on[:, high], on[:, low])
            values = tuple(float(RATE * g[leaf == i].sum() / (h[leaf == i].sum() + SHRINK)) for i in range(4))
            self.trees.append((root, low, high, values))
            score += np.array(values)[leaf]

    def scores(self, bits: np.ndarray) -> np.ndarray:
        bit = lambda i: (bits >> i & 1).astype(int)
        total = np.zeros(len(bits))
        for root, low, high, values in self.trees:
            total += np.array(values)[2 * bit(root) + np.where(bit(root), bit(high), bit(low))]
        return total

    def calibrate(self, bits: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """The lowest score from which on enough of a kind's labelled spans are right."""
        score = self.scores(bits)
        for kind in range(len(BASE), len(KINDS)):
            mine = (bits >> kind & 1).astype(bool)
            for least in np.unique(score[mine]):
                kept = mine & (score >= least)
                if weight[kept & (label == 1)].sum() >= PRECISION * weight[kept].sum() and least > 0:
                    self.thresholds[kind] = float(least)
                    break

    def score_sql(self, bits: str) -> str:
        bit = lambda i: f"({bits} & {1 << i}) <> 0"
        trees = [
            f"if({bit(r)}, if({bit(h)}, {v[3]!r}D, {v[2]!r}D), if({bit(low)}, {v[1]!r}D, {v[0]!r}D))"
            for r, low, h, v in self.trees
        ]
        return " + ".join(trees) or "0D"


def _split(on: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> int:
    """The bit whose two sides gain most."""
    g1, h1 = (on & rows[:, None]).T @ g, (on & rows[:, None]).T @ h
    g0, h0 = g[rows].sum() - g1, h[rows].sum() - h1
    return int(np.argmax(g1**2 / (h1 + SHRINK) + g0**2 / (h0 + SHRINK)))


def fit(docs: DataFrame) -> Trees:
    """From the candidates of all documents, counted by their bits."""
    text = docs.select(F.col("doc_id"), "text").where("text is not null")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")
    rows = described(candidates(text)).select(half, F.inline("spans")).where("label is not null")
    counts = rows.groupBy("half", "bits", "label").count().collect()
    table = np.array([tuple(r) for r in counts], np.int64).reshape(-1, 4)
    table = table[np.lexsort(table.T)]
    trees, learn = Trees(), table[:, 0] == 0
    trees.fit(table[learn, 1], table[learn, 2], table[learn, 3].astype(float))
    trees.calibrate(table[~learn, 1], table[~learn, 2], table[~learn, 3].astype(float))
    return trees


def selected(docs: DataFrame, trees: Trees) -> DataFrame:
    """Add ``base`` and ``spans``, arrays of ``(s, kind, e)`` in order; columns of these
    names are replaced, others are left alone."""
    names = [c for c in docs.columns if c not in ("base", "spans")]
    own = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)]
    rows = docs.select(*own, F.coalesce("text", F.lit("")).alias("text"))
    rows = described(candidates(rows)).withColumnRenamed("spans", "all")
    span = "named_struct('s', c.s, 'kind', c.kind, 'e', c.e)"
    base = F.expr(f"array_sort(transform(filter(all, c -> c.kind < {len(BASE)} AND c.label = 1), c -> {span}))")
    limits = "".join(f" WHEN {k} THEN {t!r}D" for k, t in trees.thresholds.items())
    limit = f"CASE c.kind{limits} END" if limits else "cast(null AS double)"
    more = F.expr(
        f"filter(transform(filter(all, c -> c.kind >= {len(BASE)}), c -> named_struct('s', c.s, 'kind', c.kind, "
        f"'e', c.e, 'score', {trees.score_sql('c.bits')}, 'least', {limit})), c -> c.score >= c.least)"
    )
    rows = _once(rows, base=base, _more=more)
    alone = F.expr(
        "transform(filter(_more, c -> NOT exists(base, b -> b.s < c.e AND c.s < b.e) AND NOT exists(_more, b -> "
        "b.s < c.e AND c.s < b.e AND (b.score > c.score OR (b.score = c.score AND (b.s < c.s OR "
        f"(b.s = c.s AND b.kind < c.kind)))))), c -> {span})"
    )
    rows = _once(rows, spans=F.array_sort(F.concat("base", alone)))
    return rows.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)), "base", "spans")


def joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    one = f"concat(element_at(array({names}), c.kind + 1), ':', c.s, ':', c.e)"
    return F.expr(f"array_join(transform({spans}, c -> {one}), ',')")


def count_of(kind: str) -> Column:
    return F.expr(f"size(filter(base, c -> c.kind = {KINDS.index(kind)}))").cast("bigint")


def redacted(docs: DataFrame, trees: Trees) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; of
    overlapping spans, the whole stretch by the kind of the first."""
    names = ", ".join(f"'[{k}]'" for k in KINDS)
    built = F.expr(
        f"""aggregate(spans, named_struct('at', 0, 'o', ''), (a, c) -> named_struct(
          'at', greatest(a.at, c.e),
          'o', if(c.s < a.at, a.o, concat(a.o, substring(text, a.at + 1, c.s - a.at),
                element_at(array({names}), c.kind + 1)))),
          a -> concat(a.o, substring(text, a.at + 1, length(text))))"""
    )
    own = [F.col(f"`{c}`").alias("text" if c == "text" else f"_r{i}") for i, c in enumerate(docs.columns)]
    rows = selected(docs.select(*own), trees)
    text = F.when(F.size("spans") > 0, built).otherwise(F.col("text"))
    return rows.select(
        *((text if c == "text" else F.col(f"_r{i}")).alias(c) for i, c in enumerate(docs.columns))
    )
