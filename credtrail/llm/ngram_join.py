"""Jaccard self-join of shingle sets by a partition of the universe.

Two sets of sizes a and b with a similarity of 0.8 or more differ in at most (a + b) / 9
tokens. Documents fall into bands by size, and in a band the hash range is cut into
segments: so many that two similar sets must agree on one of them. An *exact*
segment has one signature, the sum of its mixed token hashes; a *one-deletion* segment also
has those with one token taken away, so it stands for two differences. With n0 exact
and n1 one-deletion segments, of which the k exact ones that tell least may be left out, the
pair is found if ``n0 - k + 2 * n1 > differences``. Both sets leave out by the same order
of signatures, so of the k + 1 they share, the one that tells most is kept by both.

Which n0 and n1 are best is a matter of cost: signatures to write against accidental
meetings, mostly of segments that are empty. :func:`allocated` weighs them for each band by
its number of documents; :func:`spared` adds exact segments to leave out until the empty
ones of the smallest sets are among them.

Sets are classes: equal sets have one key (a 64-bit hash of the set), and only classes are
compared. In a bucket (classes with a common signature) every class is first compared
with the least one, which ties groups of near copies together without all their pairs.
Only buckets that are still in several components then have their remaining
pairs of different components compared, once for all buckets of the same members. Pairs first
pass a sketch: each token turns over one of ``64 * SKETCH`` bits, and two sets differ in at
least as many tokens as their sketches do in bits, so what is refused cannot be similar. Large
sets fill such a sketch, so pairs then pass a finer one, of ``FINE`` bits a token or more.
The rest is compared exactly, on whole sets; only texts of these pairs are shuffled.

Defined cases: no words: empty set, no links, own component; null ids take part,
but never name a component; repeated rows and copies share a class; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credtrail.llm.common import mixed, written
from credtrail.llm.components import components
from credtrail.llm.shingles import shingle_set, word_hashes
from credtrail.plans.sizing import broadcast_if_small

#: Similarity as a fraction.
NEEDED, WHOLE = 80, 100
#: Documents, chosen by a hash, among which frequent shingles are looked for, and the share
#: of them that makes one frequent. Steers which segments are left out, never what is found.
SAMPLE_DOCS, FREQUENT = 2_000, 0.01
#: Bits of the map of the classes that take part in a pair; fixed, whatever the data.
MAP_BITS = 1 << 26
#: Words of 64 bits in a sketch.
SKETCH = 8
SKETCHED = [f"s{i}" for i in range(SKETCH)]
#: Bits of the finer sketch for each token, rounded up to a power of two.
FINE = 2
#: Standard deviations of the number of empty segments that are left out beyond its mean,
#: and the least tokens a segment may have on average for that.
SPARED, THINNEST = 4, 2.5
#: Classes of which a task remembers that it has passed them on.
SEEN = 100_000


def band_edges(most: int = 1 << 40) -> list[int]:
    """Least sizes of the bands: similar sets are in the same or neighbouring bands."""
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, edges[-1] * WHOLE // NEEDED))
    return edges


EDGES = band_edges()


def differences(band: int) -> int:
    """Most tokens in which similar sets differ, one of which is in ``band`` and the other
    there or in the next one."""
    small = EDGES[band + 1] - 1
    large = small * WHOLE // NEEDED
    return (small + large) * (WHOLE - NEEDED) // (WHOLE + NEEDED)


def allocated(band: int, docs: int) -> tuple[int, int, int]:
    """``n0, n1, k`` of least cost for a band with so many documents."""
    most, size = differences(band), EDGES[band + 1] - 1
    best = None
    for n1 in sorted({(most // 2 + 1) * i // 16 for i in range(17)}):
        k = 0
        for _ in range(3):  # segments left out: about twice the empty ones
            n0 = max(0, most + 1 + k - 2 * n1)
            s = size / (n0 + n1)
            k = min(n0, math.ceil(2 * n0 * math.exp(-s))) if n0 else 0
        n0 = max(k, most + 1 + k - 2 * n1)
        s = size / (n0 + n1)
        written_out = n0 - k + n1 * (1 + s)
        by_chance = (n0 * math.exp(-2 * s) ** 2 if k else n0 * math.exp(-2 * s)) + n1 * math.exp(-2 * s) * (1 + 2 * s)
        cost = docs * written_out + docs * docs / 2 * by_chance
        if best is None or cost < best[0]:
            best = cost, (n0, n1, k)
    return spared(best[1], EDGES[band])


def spared(plan: tuple[int, int, int], least: int) -> tuple[int, int, int]:
    """The plan with more exact segments to leave out, so that the empty segments of sets of
    ``least`` tokens are. An empty segment that stays meets those of unrelated sets, in pairs
    that grow with the square of the documents. As many signatures are written as before."""
    n0, n1, k = plan
    if not n0:
        return plan
    kept = n0 - k
    while least >= THINNEST * (kept + k + n1 + 1):
        s = least / (kept + k + n1)
        empty = (kept + k) * math.exp(-s)
        if k >= empty + SPARED * math.sqrt(empty * (1 - (1 + s) * math.exp(-s))):
            break
        k += max(1, k // 16)
    return kept + k, n1, k


def set_key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def signatures(tokens: np.ndarray, band: int, plan: tuple[int, int, int], frequent: np.ndarray) -> np.ndarray:
    """Signatures of a sorted set in the segments of ``band``."""
    n0, n1, k = plan
    n = np.uint64(n0 + n1)
    segment = ((tokens >> np.uint64(32)) * n >> np.uint64(32)).astype(np.int64)
    parts = mixed(tokens + np.uint64(1))
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(parts, dtype=np.uint64)])
    ends = np.searchsorted(segment, np.arange(n0 + n1 + 1))
    sums = running[ends[1:]] - running[ends[:-1]]
    salt = mixed(np.uint64(band << 32) + np.arange(n0 + n1, dtype=np.uint64) + np.uint64(1 << 60))
    full = mixed(sums ^ salt)
    exact = full[:n0]
    if k:
        telling = np.ones(len(tokens), np.int64)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
            telling[frequent[at] == tokens] = 0
        seen = np.concatenate([[0], np.cumsum(telling)])
        worth = (seen[ends[1:]] - seen[ends[:-1]])[:n0]
        exact = exact[np.lexsort((exact, worth))[k:]]
    out = [exact, full[n0:]]
    if n1:
        mine = segment >= n0
        out.append(mixed((sums[segment[mine]] - parts[mine]) ^ salt[segment[mine]]))
    return np.concatenate(out)


def band_of(size: int) -> int:
    return int(np.searchsorted(EDGES, size, side="right")) - 1


def plans_for(docs: DataFrame) -> tuple[dict[int, tuple[int, int, int]], int]:
    """Allocation of every band, from text lengths: a word takes about six bytes. Only the
    cost depends on that estimate. Also the number of documents."""
    length = F.floor(F.log2(F.greatest(F.octet_length("text") / 6, F.lit(1.0))) * 4)
    rows = docs.where(F.col("text").isNotNull()).groupBy(length.alias("q")).count().collect()
    about = np.zeros(len(EDGES))
    for q, n in rows:
        about[band_of(max(1, int(2 ** (q / 4))))] += n
    near = np.convolve(about, [1, 1, 1], "same")
    plans = {b: allocated(b, int(near[b]) + 1) for b in range(min(len(EDGES) - 1, 80))}
    return plans, sum(n for _, n in rows)


def frequent_shingles(docs: DataFrame, total: int) -> np.ndarray:
    """Shingles of many documents in a bounded sample; there are at most ``1 / FREQUENT``
    times as many as a document has on average."""
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    place = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1 << 30)) / float(1 << 30)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()
        for part in parts:
            for text in part.column(0).to_pylist():
                tokens = shingle_set(text, known).view(np.int64)
                if len(tokens):
                    yield pa.RecordBatch.from_arrays([pa.array(tokens)], ["token"])

    found = docs.where(place < share).select("text").mapInArrow(run, "token bigint")
    least = max(3, int(FREQUENT * min(total, SAMPLE_DOCS)))
    rows = found.groupBy("token").count().where(F.col("count") >= least).select("token").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))


def buckets(docs: DataFrame) -> DataFrame:
    """``sig, center, member``: classes with a common signature, each beside the least."""
    plans, total = plans_for(docs)
    frequent = frequent_shingles(docs, total)
    shared = docs.sparkSession.sparkContext.broadcast((plans, frequent))

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (plans, frequent), known, passed = shared.value, word_hashes(), set()
        held, size = [], 0
        for part in parts:
            for text in part.column(0).to_pylist():
                tokens = shingle_set(text, known)
                if not len(tokens) or (key := set_key(tokens)) in passed:
                    continue
                if len(passed) < SEEN:
                    passed.add(key)
                band = band_of(len(tokens))
                for b in (band, band - 1) if band else (band,):
                    sigs = signatures(tokens, b, plans[b], frequent)
                    held.append((sigs, key))
                    size += len(sigs)
                if size > 100_000:
                    yield _signed(held)
                    held, size = [], 0
        if held:
            yield _signed(held)

    signed = docs.select("text").mapInArrow(sign, "sig bigint, key bigint")
    laid = signed.repartition("sig").sortWithinPartitions("sig", "key")
    return laid.mapInArrow(_stars, "sig bigint, center bigint, member bigint")


def _signed(held: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
    sigs = np.concatenate([s for s, _ in held]).view(np.int64)
    keys = np.repeat(np.array([k for _, k in held], np.int64), [len(s) for s, _ in held])
    return pa.RecordBatch.from_arrays([pa.array(sigs), pa.array(keys)], ["sig", "key"])


def _stars(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by signature and key; only the last row is carried along."""
    last = None
    for part in parts:
        if not part.num_rows:
            continue
        sig, key = (part.column(i).to_numpy() for i in (0, 1))
        if last is not None:
            sig, key = np.append(last[0], sig), np.append(last[2], key)
        starts = np.append(True, sig[1:] != sig[:-1])
        center = key[np.maximum.accumulate(np.where(starts, np.arange(len(sig)), 0))]
        if last is not None:
            end = len(sig) if starts[1:].sum() == 0 else 1 + int(np.argmax(starts[1:]))
            center[:end] = last[1]
        new = np.append(last is None, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])) & (key != center)
        if new.any():
            columns = [pa.array(x[new]) for x in (sig, center, key)]
            yield pa.RecordBatch.from_arrays(columns, ["sig", "center", "member"])
        last = sig[-1], center[-1], key[-1]


def class_map(pairs: DataFrame) -> np.ndarray:
    """Bits of the classes in ``pairs (a, b)``, as words of 64. Some other class may share a
    bit; that costs time only."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    bit = F.pmod(F.col("key"), F.lit(MAP_BITS))
    words = keys.groupBy((bit / 64).cast("int").alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(pmod(key, 64) AS int)))").alias("bits")
    )
    found = words.toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def sketch(tokens: np.ndarray, bits: int = 64 * SKETCH) -> bytes:
    """Parity of the tokens in each bit, little-endian; ``bits`` is a power of two."""
    odd = np.bincount((tokens >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fine_sketch(tokens: np.ndarray) -> bytes:
    """A sketch of a size that goes with the set."""
    return sketch(tokens, max(64 * SKETCH, 1 << (FINE * len(tokens) - 1).bit_length()))


def bits_apart(one: bytes, other: bytes) -> int:
    """Bits in which sketches differ; the larger is folded to the size of the smaller."""
    a, b = (np.frombuffer(x, np.uint64) for x in sorted((one, other), key=len))
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def classed(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``doc_id, n_shingles, key``, and for classes in the map, from each task once,
    ``text`` and sketches (``s0, s1, …`` and ``fine``)."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, known, passed = shared.value, word_hashes(), set()
        for part in parts:
            sizes, keys, texts, bits, fine = [], [], [], [], []
            for text in part.column(1).to_pylist():
                tokens = shingle_set(text, known)
                key = set_key(tokens) if len(tokens) else None
                bit = 0 if key is None else key % MAP_BITS
                take = key is not None and key not in passed and wanted[bit // 64] >> (bit % 64) & 1
                if take and len(passed) < SEEN:
                    passed.add(key)
                sizes.append(len(tokens))
                keys.append(key)
                texts.append(text if take else None)
                bits.append(sketch(tokens) if take else bytes(8 * SKETCH))
                fine.append(fine_sketch(tokens) if take else None)
            words = np.frombuffer(b"".join(bits), np.int64).reshape(-1, SKETCH)
            columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(texts, pa.string())]
            columns += [pa.array(np.ascontiguousarray(words[:, i])) for i in range(SKETCH)]
            columns.append(pa.array(fine, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "key", "text", *SKETCHED, "fine"])

    kinds = "doc_id bigint, n_shingles bigint, key bigint, text string"
    kinds += "".join(f", {s} bigint" for s in SKETCHED) + ", fine binary"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, kinds)


def possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that sizes and sketches allow to be similar."""
    for side in ("a", "b"):
        own = sketches.select(F.col("key").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n_shingles", *SKETCHED)))
        pairs = pairs.join(own, side)
    return pairs.where(_fits("a", "b")).select("a", "b")


def _fits(one: str, other: str) -> Column:
    a, b = F.col(f"n_shingles_{one}"), F.col(f"n_shingles_{other}")
    apart = sum(F.bit_count(F.col(f"{s}_{one}").bitwiseXOR(F.col(f"{s}_{other}"))) for s in SKETCHED)
    return (WHOLE * F.least(a, b) >= NEEDED * F.greatest(a, b)) & (
        apart * (WHOLE + NEEDED) <= (a + b) * (WHOLE - NEEDED)
    )


def of_ends(pairs: DataFrame, classes: DataFrame, *columns: str) -> DataFrame:
    """``key`` and ``columns`` of each class in ``pairs (a, b)`` once. What no pair needs is
    left before the shuffle. ``pairs`` must be written."""
    keys = written(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "ends")
    return classes.join(broadcast_if_small(keys), "key", "left_semi").select("key", *columns).dropDuplicates(["key"])


def narrowed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that the finer sketches allow to be similar."""
    own = of_ends(pairs, classes, "n_shingles", "fine")
    for side in ("a", "b"):
        pairs = pairs.join(own.withColumnsRenamed({c: f"{c}_{side}" for c in ("n_shingles", "fine")} | {"key": side}), side)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            total = part.column("n").to_pylist()
            sketches = (part.column(f"fine_{side}").to_pylist() for side in ("a", "b"))
            keep = [
                bits_apart(a, b) * (WHOLE + NEEDED) <= n * (WHOLE - NEEDED)
                for a, b, n in zip(*sketches, total, strict=True)
            ]
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sized = pairs.select("a", "b", (F.col("n_shingles_a") + F.col("n_shingles_b")).alias("n"), "fine_a", "fine_b")
    return sized.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar, with ``classes (key, text, …)`` one row or
    more for each class. Rows of one ``a`` follow each other, so its set is made once."""
    pairs = written(narrowed(pairs, classes), "narrowed")
    texts = of_ends(pairs, classes, "text")
    left = pairs.join(texts.withColumnsRenamed({"key": "b", "text": "text_b"}), "b")
    both = left.join(texts.withColumnsRenamed({"key": "a", "text": "text_a"}), "a")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, mine = word_hashes(), None, None
        for part in parts:
            keep = []
            columns = [part.column(n) for n in ("a", "text_a", "text_b")]
            for a, text_a, text_b in zip(columns[0].to_pylist(), columns[1], columns[2].to_pylist(), strict=True):
                if last != a:
                    last, mine = a, shingle_set(text_a.as_py(), known)
                other = shingle_set(text_b, known)
                common = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(WHOLE * common >= NEEDED * (len(mine) + len(other) - common))
            yield part.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def open_pairs(found: DataFrame, nodes: DataFrame, checked: DataFrame, sketches: DataFrame) -> DataFrame:
    """Possible pairs in buckets that span several components, of different components and
    not yet compared. Members of a bucket's largest component meet the others only. The
    sketch is part of the join's condition, so refused pairs never become rows."""
    label = nodes.select(F.col("node").alias("member"), "root")
    pairs = checked.join(nodes.withColumnsRenamed({"node": "a", "root": "root_a"}), "a", "left")
    pairs = pairs.join(nodes.withColumnsRenamed({"node": "b", "root": "root_b"}), "b", "left")
    apart = pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(
        F.col("a").alias("center"), F.col("b").alias("member")
    )
    apart = written(apart, "apart")
    open_sigs = found.join(broadcast_if_small(apart), ["center", "member"]).select("sig").distinct()
    open_sigs = written(open_sigs, "open")
    rows = found.join(broadcast_if_small(open_sigs), "sig", "left_semi")
    # Similar sets meet in many buckets; of those with the same members one is enough.
    alike = rows.groupBy("sig").agg(
        F.min("center").alias("center"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("member")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "member")).alias("y"),
    )
    single = written(alike.groupBy("center", "n", "x", "y").agg(F.min("sig").alias("sig")).select("sig"), "single")
    rows = found.join(broadcast_if_small(single), "sig", "left_semi")
    rows = rows.select("sig", F.explode(F.array("center", "member")).alias("member")).distinct()
    rows = rows.join(label, "member", "left").withColumn("root", F.coalesce("root", "member"))
    rows = written(rows, "rest")
    sizes = rows.groupBy("sig", "root").count()
    largest = sizes.groupBy("sig").agg(F.max_by("root", F.struct("count", "root")).alias("top"))
    own = sketches.withColumnsRenamed({"key": "member"})
    rows = rows.join(own, "member")
    outside = rows.join(largest, "sig").where("root <> top")
    sides = {}
    for side, part in (("a", outside), ("b", rows)):
        names = {c: f"{c}_{side}" for c in ("member", "root", "n_shingles", *SKETCHED)}
        sides[side] = part.withColumnsRenamed(names)
    apart = (F.col("root_a") != F.col("root_b")) & (
        (F.col("root_b") == F.col("top")) | (F.col("member_a") < F.col("member_b"))
    )
    left, right = sides["a"], sides["b"].withColumnRenamed("sig", "sig_b")
    met = left.join(right, (F.col("sig") == F.col("sig_b")) & apart & _fits("a", "b"))
    met = met.select(
        F.least("member_a", "member_b").alias("a"), F.greatest("member_a", "member_b").alias("b")
    ).distinct()
    return met.join(checked, ["a", "b"], "left_anti")


def similar_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs (doc_id, text)``."""
    docs = docs.select("doc_id", "text")
    found = written(buckets(docs), "buckets")
    pairs = found.select(F.col("center").alias("a"), F.col("member").alias("b")).distinct()
    pairs = written(pairs, "pairs")
    rows = written(classed(docs, class_map(pairs)), "classes")
    first = rows.where("text is not null")
    sketches = first.select("key", "n_shingles", *SKETCHED).distinct()
    near = written(possible(pairs, sketches), "near")
    links = written(verified(near, first), "links")
    nodes = components(links)
    rest = written(open_pairs(found, nodes, pairs, sketches), "near")
    if not rest.isEmpty():
        nodes = components(links.unionByName(verified(rest, first)))
    return _grouped(rows.select("doc_id", "n_shingles", "key"), nodes)


def _grouped(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    classes = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    classes = classes.join(nodes, F.col("key") == F.col("node"), "left")
    classes = classes.select("key", "least", F.coalesce("root", "key").alias("root"))
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(names, "root").select("key", "component_id")
    out = rows.join(named, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
