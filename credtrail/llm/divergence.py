"""How far the sources of a language differ in their words, and by which words.

Terms are counted in one pass over the texts, combined in the workers before they are shuffled.
The term-major index has a row for each kept (language, term): the sources that hold it.
The distance of two sources sums over all kept terms, most of which neither holds. It is taken
as if every source held nothing but its own terms (zero baselines, from the few distinct counts
that a source has), and then corrected for the terms that two sources share: by Gustavson's
scheme each source scatters its terms through the index into a dense accumulator with a place for
each peer. A block of the index is a task of bounded size, and leaves one row for each pair of
sources, not one for each pair of postings.

Defined cases: null text, language and source are empty texts; every row counts as a document, also
a repeated one; texts without a term count for their group only; a language without kept terms
has distances of 0. Only ``text``, ``lang`` and ``source`` are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credtrail.llm.common import batches, written
from credtrail.plans.sizing import broadcast_if_small

#: A term is kept that so many documents of its language hold.
LEAST_DOCS = 3
#: Probabilities count in parts of this.
UNIT = 1_000_000_000
#: Rows that the list of a group's terms has.
TOP_TERMS = 200
#: Bytes of text whose terms a worker holds before it hands on their counts.
HELD_BYTES = 32 << 20
#: Postings of one block of the index.
BLOCK_POSTINGS = 1 << 18
#: Sources of one language that meet all their peers in one task.
CHUNK = 64

# ASCII letters become small, other ASCII becomes a blank, and the rest stays.
_TERMS = bytes(
    b | 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256)
)

_COUNTS = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())]
)


def terms(text: bytes) -> list[bytes]:
    """Runs of letters and of bytes beyond ASCII, ``A-Z`` made small."""
    return text.translate(_TERMS).split()


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by group and term, of some megabytes of text at a time. A row without a term
    says that the group is there."""

    def rows() -> Iterator[tuple]:
        n, docs, held = defaultdict(Counter), defaultdict(Counter), 0

        def out() -> Iterator[tuple]:
            for (lang, source), found in n.items():
                yield lang, source, None, 0, 0
                in_docs = docs[lang, source]
                for term, k in found.items():
                    yield lang, source, term, k, in_docs[term]

        for batch in parts:
            columns = [batch.column("lang").to_pylist(), batch.column("source").to_pylist()]
            for lang, source, text in zip(*columns, batch.column("text").cast(pa.binary()).to_pylist()):
                found = terms(text)
                n[lang, source].update(found)
                docs[lang, source].update(set(found))
                held += len(text) + 64
                if held >= HELD_BYTES:
                    yield from out()
                    n.clear(), docs.clear()
                    held = 0
        yield from out()

    yield from batches(rows(), _COUNTS, lambda r: 64 + len(r[2] or b""))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``, and one row with a null term for every group."""
    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = texts.mapInArrow(_counted, "lang string, source string, term binary, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, vocabulary: Column) -> Column:
    """``1 + floor(UNIT * (count + 1) / (total + vocabulary))``, in two steps that no long
    overflows below 10 ** 13."""
    high = F.lit(100_000) * (count + 1)
    whole = total + vocabulary
    quotient = F.call_function("div", high, whole)
    return 1 + quotient * 10_000 + F.call_function("div", (high % whole) * 10_000, whole)


def difference(p: Column, q: Column) -> Column:
    """``floor((p - q) ** 2 / q)``"""
    return F.call_function("div", (p - q) * (p - q), q)


def term_index(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, total, postings``: one row for each kept term, as many postings as the
    language has sources that hold it."""
    rows = counts.where("term is not null").groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"),
        F.sum("n").alias("total"),
        F.collect_list(F.struct("source", "n")).alias("postings"),
    )
    return rows.where(F.col("docs") >= least_docs).drop("docs")


def _scatter(block: pa.Table) -> pa.Table:
    """What the terms of a block add to each pair of sources, beyond the zero baselines."""
    lang = block.column("lang")[0].as_py()
    term = block.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    at, p, p0 = (block.column(c).to_numpy() for c in ("at", "p", "p0"))
    by_term = np.lexsort((at, term))
    term, at, p, p0 = term[by_term], at[by_term], p[by_term], p0[by_term]
    n_peers = int(block.column("n_sources")[0].as_py())
    starts = np.searchsorted(term, np.arange(term[-1] + 2))
    by_source = np.argsort(at, kind="stable")
    edges = [0, *(np.flatnonzero(np.diff(at[by_source])) + 1).tolist(), len(at)]
    found = []
    for a, b in zip(edges, edges[1:]):
        rows = by_source[a:b]
        accumulator, met = np.zeros(n_peers, np.int64), np.zeros(n_peers, bool)
        first, lengths = starts[term[rows]], np.diff(starts)[term[rows]]
        # The postings of a source's terms, some at a time.
        for piece in np.array_split(np.arange(len(rows)), 1 + int(lengths.sum()) // BLOCK_POSTINGS):
            if not len(piece):
                continue
            n = lengths[piece]
            places = np.repeat(first[piece] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            mine, zero = np.repeat(p[rows[piece]], n), p0[rows[0]]
            q, q0 = p[places], p0[places]
            gain = (mine - q) ** 2 // q - (mine - q0) ** 2 // q0 - (zero - q) ** 2 // q + (zero - q0) ** 2 // q0
            np.add.at(accumulator, at[places], gain)
            met[at[places]] = True
        peers = np.flatnonzero(met)
        own = int(at[rows[0]])
        found.append((np.full(len(peers), own), peers, accumulator[peers]))
    a, b, gain = (np.concatenate(x) for x in zip(*found))
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": a, "b": b, "value": gain})


def divergence(docs: DataFrame, top: int = TOP_TERMS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """``lang, source, part, item, value, rank``: the other sources of the language (``pair``) and
    the terms that a source has more of than its language (``term``), largest value first."""
    counts = written(term_counts(docs), "term-counts")
    index = written(term_index(counts), "term-index")
    langs = index.groupBy("lang").agg(
        F.count("*").alias("vocabulary"),
        F.sum("total").alias("lang_total"),
        F.sum(F.size("postings")).alias("n_postings"),
    )
    flat = index.select("lang", "term", "total", F.inline("postings"))
    own = flat.groupBy("lang", "source").agg(F.sum("n").alias("own_total"), F.count("*").alias("own_terms"))
    sources = counts.where("term is null").select("lang", "source")
    in_lang = Window.partitionBy("lang")
    sources = sources.join(own, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("own_total", "own_terms", "vocabulary", "lang_total", "n_postings")),
    )
    none = F.lit(0).cast("bigint")
    sources = sources.select(
        "*",
        # One row a source: its place in the accumulators of its language.
        (F.row_number().over(in_lang.orderBy("source")) - 1).cast("bigint").alias("at"),
        F.count("*").over(in_lang).alias("n_sources"),
        F.when(F.col("vocabulary") > 0, share(none, F.col("own_total"), F.col("vocabulary"))).otherwise(1).alias("p0"),
    )
    sources = written(sources, "sources")
    facts = broadcast_if_small(sources)
    blocks = F.ceil(F.col("n_postings") / F.lit(block_postings))
    postings = flat.join(facts, ["lang", "source"]).select(
        "lang", "term", "source", "n", "total", "at", "n_sources", "p0", "vocabulary", "lang_total",
        share(F.col("n"), F.col("own_total"), F.col("vocabulary")).alias("p"),
        F.pmod(F.xxhash64("term"), blocks).alias("block"),
    )
    postings = written(postings, "postings")
    pairs = _pairs(sources, postings)
    shared = share(F.col("total"), F.col("lang_total"), F.col("vocabulary"))
    listed = postings.withColumn("q", shared).where("p > q").select(
        "lang", "source", F.col("term").cast("string").alias("item"), difference(F.col("p"), F.col("q")).alias("value")
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    # A limit on the rank is applied before the shuffle as well.
    listed = listed.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", F.row_number().over(by_value))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.withColumn("part", F.lit("pair")).select(*columns).unionByName(
        listed.withColumn("part", F.lit("term")).select(*columns)
    )


def _pairs(sources: DataFrame, postings: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every two sources of a language."""
    known = postings.groupBy("lang", "at", "p").agg(F.count("*").alias("n"))
    # One entry for each distinct count of a source.
    known = known.groupBy("lang", "at").agg(F.collect_list(F.struct("p", "n")).alias("known"))
    rows = sources.join(known, ["lang", "at"], "left").select(
        "lang", "source", "at", "n_sources", "p0", "own_terms", "vocabulary", F.coalesce("known", F.array()).alias("known")
    )
    rows = written(rows, "baselines")
    part = F.call_function("div", F.col("at"), F.lit(CHUNK))
    left = rows.select("lang", part.alias("part"), F.struct("at", "source", "p0", "own_terms", "vocabulary", "known").alias("s"))
    last = F.call_function("div", F.col("n_sources") - 1, F.lit(CHUNK))
    right = rows.select(
        "lang", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part"),
        F.struct("at", "source", "p0", "own_terms", "known").alias("t"),
    )
    met = left.join(right, ["lang", "part"]).where(F.col("s.at") != F.col("t.at"))
    zero = F.lit(0).cast("bigint")
    p0, q0 = F.col("s.p0"), F.col("t.p0")
    mine = F.aggregate(F.col("s.known"), zero, lambda sum_, x: sum_ + x["n"] * difference(x["p"], q0))
    theirs = F.aggregate(F.col("t.known"), zero, lambda sum_, x: sum_ + x["n"] * difference(p0, x["p"]))
    rest = (F.col("s.vocabulary") - F.col("s.own_terms") - F.col("t.own_terms")) * difference(p0, q0)
    base = F.when(F.col("s.vocabulary") > 0, mine + theirs + rest).otherwise(zero)
    base = met.select(
        "lang", F.col("s.at").alias("a"), F.col("t.at").alias("b"), base.alias("value"),
        F.col("s.source").alias("source"), F.col("t.source").alias("item"),
    )
    inputs = postings.select("lang", "block", "term", "at", "p", "p0", "n_sources")
    gains = inputs.groupBy("lang", "block").applyInArrow(_scatter, "lang string, a bigint, b bigint, value bigint")
    gains = gains.where("a <> b").withColumns({"source": F.lit(None).cast("string"), "item": F.lit(None).cast("string")})
    summed = base.unionByName(gains).groupBy("lang", "a", "b").agg(
        F.sum("value").alias("value"), F.max("source").alias("source"), F.max("item").alias("item")
    )
    return summed.select("lang", "source", "item", "value")
