"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts, up to ``ORDER`` bytes long; a context is kept
where it was seen often enough, so the order varies from place to place. A byte that a context
knows is coded with its count, any other after an escape (method C: as many escapes as
distinct bytes) by the next shorter context, known bytes excluded. Statistics are
frozen: the code length of a text is the sum over its bytes, and the language with
the shortest code wins.

The trees are laid out as tables: the last bytes give a state (the longest context
in any tree), and state and next byte give the bits for all languages at once.

Fitted on a bounded sample of the labelled rows: ``SAMPLE_DOCS`` documents of each language,
chosen by a hash of id and text, each whole.

Defined cases: text that is null or has no letter is ``und`` with score 0, and so is all
text if no row can be learned from; ties go to the language first in order; rows with a
null label aren't learned from. The score is the share of the winner if the code
lengths are taken as probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credtrail.llm.common import PASS_BYTES, extended, slices

ORDER = 3
SAMPLE_DOCS = 1_500
#: A context is kept from so many occurrences in a language on.
MIN_SEEN = 12
UNDETERMINED = "und"
#: Bytes that are scored at once; the scratch arrays are some fifty times as large for four languages.
SCORED_BYTES = 1 << 18
#: Longer tables of symbols than this would not fit; rarer bytes share one.
MAX_SYMBOLS = 127


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """``languages``; ``symbol`` of each byte; ``state`` by the last symbols;
    ``bits[state * symbols + symbol]`` for each language."""

    def __init__(self, languages, symbol, state, bits):
        self.languages, self.symbol, self.state, self.bits = languages, symbol, state, bits

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= SCORED_BYTES):
                size += len(texts[last]) + ORDER
                last += 1
            out[first:last] = self._pass(texts[first:last])
            first = last
        return out

    def _pass(self, texts: list[bytes]) -> np.ndarray:
        k = int(self.symbol.max()) + 1
        total = np.zeros((len(texts), len(self.languages)))
        pad = b"\n" * ORDER
        raw = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)
        ends = np.cumsum([len(t) + ORDER for t in texts])
        starts = ends - np.array([len(t) for t in texts])
        # A single very long text goes in slices, so scratch arrays stay small.
        for at in range(0, len(raw), SCORED_BYTES):
            lo = max(0, at - ORDER)
            s = self.symbol[raw[lo : at + SCORED_BYTES]].astype(np.int32)
            context = s[: len(s) - ORDER].copy()
            for i in range(1, ORDER):
                context = context * k + s[i : len(s) - ORDER + i]
            cell = self.state[context] * k + s[ORDER:]
            sums = np.zeros((len(cell) + 1, len(self.languages)))
            np.cumsum(self.bits[cell], axis=0, dtype=np.float64, out=sums[1:])
            a = np.clip(starts - lo - ORDER, 0, len(cell))
            b = np.clip(ends - lo - ORDER, 0, len(cell))
            total += sums[b] - sums[a]
        return total


def fit(docs: DataFrame, label: str = "lang") -> Model | None:
    """Count the contexts of the sample on the executors and lay out the trees."""
    rows = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return None
    share = F.lit(1.0)
    for language, n in counts.items():
        share = F.when(F.col(label) == language, min(1.0, SAMPLE_DOCS / n)).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(place < share).select(F.col(label).alias("lang"), "text")
    grams = sample.mapInArrow(_grams, "lang string, gram bigint, n bigint")
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Bounded by the sample: languages times SAMPLE_DOCS texts.
    found = grams.toArrow()
    return _laid_out(sorted(counts), *(found.column(i).combine_chunks() for i in range(3)))


def _grams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ORDER + 1 bytes and how often each language has them."""
    for part in parts:
        by_language: dict[str, list[bytes]] = {}
        for language, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            by_language.setdefault(language, []).append(text.encode())
        for language, texts in by_language.items():
            held, size = [], 0
            for n, t in enumerate(texts, 1):
                held.append(t)
                size += len(t)
                if size < PASS_BYTES and n < len(texts):
                    continue
                pad = b"\n" * ORDER
                for at in range(0, len(blob := b"".join(pad + t for t in held)), PASS_BYTES):
                    raw = np.frombuffer(blob[max(0, at - ORDER) : at + PASS_BYTES], np.uint8)
                    if len(raw) <= ORDER:
                        continue
                    gram = np.zeros(len(raw) - ORDER, np.int64)
                    for i in range(ORDER + 1):
                        gram = gram << 8 | raw[i : len(raw) - ORDER + i]
                    gram, n_seen = np.unique(gram, return_counts=True)
                    columns = [pa.array([language] * len(gram)), pa.array(gram), pa.array(n_seen)]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])
                held, size = [], 0


def _laid_out(languages: list[str], langs: pa.Array, grams: pa.Array, ns: pa.Array) -> Model:
    which = np.searchsorted(languages, np.array(langs.to_pylist(), dtype=object)) if len(langs) else np.zeros(0, int)
    gram, n = grams.to_numpy(zero_copy_only=False).astype(np.int64), ns.to_numpy(zero_copy_only=False).astype(float)
    # Symbols: one for each of the bytes seen most, one for all others.
    seen = np.bincount((gram & 255).astype(int), weights=n, minlength=256)
    common = np.argsort(-seen, kind="stable")[: min(MAX_SYMBOLS, int((seen > 0).sum()))]
    symbol = np.zeros(256, np.uint8)
    symbol[np.sort(common)] = np.arange(1, len(common) + 1)
    k = len(common) + 1
    others = max(1, 256 - len(common))
    parts = [symbol[(gram >> (8 * (ORDER - i))) & 255].astype(np.int64) for i in range(ORDER + 1)]

    # Order by order: states of the kept contexts, and the chance of each symbol there.
    uniform = np.full(k, 1 / 256)
    uniform[0] = others / 256
    chance = {(): None}
    tables = []  # per order: sorted context codes, chances [language, context, symbol]
    for order in range(ORDER + 1):
        code = np.zeros(len(gram), np.int64)
        for i in range(ORDER - order, ORDER):
            code = code * k + parts[i]
        seen_in = [np.bincount(code[which == j], n[which == j], minlength=k**order) for j in range(len(languages))]
        kept = np.flatnonzero(np.max(seen_in, axis=0) >= MIN_SEEN) if order else np.array([0])
        place = np.full(k**order, -1)
        place[kept] = np.arange(len(kept))
        p = np.empty((len(languages), len(kept), k))
        for j in range(len(languages)):
            mine = (which == j) & (place[code] >= 0)
            c = np.bincount(place[code[mine]] * k + parts[ORDER][mine], n[mine], minlength=len(kept) * k)
            c = c.reshape(len(kept), k)
            if order == 0:
                lower = np.broadcast_to(uniform, c.shape)
            else:
                codes, before = tables[-1]
                lower = before[j][np.searchsorted(codes, kept % k ** (order - 1))]
            total, distinct = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            free = np.where(c > 0, 0, lower)
            rest = free.sum(1, keepdims=True)
            escape = np.where(rest > 0, distinct, 0) / np.maximum(total + np.where(rest > 0, distinct, 0), 1)
            coded = c / np.maximum(total + np.where(rest > 0, distinct, 0), 1)
            coded = coded + np.where(c > 0, 0, escape * free / np.maximum(rest, 1e-300))
            # A language without the context stays with its shorter one.
            p[j] = np.where(seen_in[j][kept][:, None] >= (MIN_SEEN if order else 1), coded, lower)
        tables.append((kept, p))

    # A state for each kept context whose suffixes are kept as well (they occur as often).
    first = np.cumsum([0, *(len(codes) for codes, _ in tables)])
    every = np.arange(k**ORDER)
    state = np.zeros(k**ORDER, np.int32)
    for order, (codes, _) in enumerate(tables):
        place = np.full(k**order, -1)
        place[codes] = np.arange(len(codes))
        here = place[every % k**order]
        state = np.where(here >= 0, first[order] + here, state).astype(np.int32)
    joint = np.concatenate([p for _, p in tables], axis=1)
    bits = -np.log2(np.maximum(joint, 1e-12))
    bits[:, :, 0] += np.log2(others)  # one of the bytes that share a symbol
    return Model(languages, symbol, state, np.ascontiguousarray(bits.transpose(1, 2, 0).reshape(-1, len(languages)), np.float32))


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to the columns."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*names)
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    letter = "_letter"
    while letter.lower() in (c.lower() for c in docs.columns):
        letter += "_"
    flagged = docs.withColumn(letter, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in (x for p in parts for x in slices(p, text)):
            letters = part.column(letter).to_pylist()
            texts = [t.encode() if y else b"" for t, y in zip(part.column(text).to_pylist(), letters, strict=True)]
            lengths = model.code_lengths(texts)
            best = lengths.argmin(axis=1) if len(texts) else np.zeros(0, int)
            ahead = np.exp2(np.maximum(lengths.min(axis=1, keepdims=True) - lengths, -1000.0))
            score = (1 / ahead.sum(axis=1)).tolist()
            pred = [model.languages[b] if y else UNDETERMINED for b, y in zip(best, letters, strict=True)]
            score = [x if y else 0.0 for x, y in zip(score, letters, strict=True)]
            columns = [part.column(n) for n in names] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score"])

    return flagged.mapInArrow(run, extended(docs, "lang_pred string, score double"))
