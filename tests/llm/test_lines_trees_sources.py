"""Repeated lines, the manifest and the divergence of sources against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from credtrail.llm import divergence, line_index, merkle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACE = " \t\n\x0b\x0c\r"


def sentence(seed: int, n: int = 6) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))


HOT = sentence(0)
LONG = "\n".join(sentence(s) for s in range(40, 400))
ROWS = [
    (3, f"{HOT}\nshort\n{sentence(1)}", "en", "a", 7),
    (1, f"  {HOT.upper()}\t\r\n\n{HOT}\nshort", "en", "b", None),
    (2, None, None, None, 0),
    (4, "", "de", "a", 0),
    (5, f"\n\n{HOT}\n", "en", None, 5),
    (6, "ÄÖÜäöüßÄÖÜ\nÄÖÜäöüßÄÖ", "de", "b", 1),
    (7, "äöüäöüßäöü\nÄÖÜäöüßÄÖÜ\nÄÖÜäöüßÄÖ", "de", "b", 1),
    (8, LONG, "en", "a", len(LONG)),
    (9, LONG + "\nand one more line", "en", "a", 1),
    (9, LONG + "\nand one more line", "en", "a", 1),
    (None, f"{HOT}\nonly without an id", "fr", "c", 2),
    (None, "only without an id", None, "c", 2),
    (10, " " + HOT, "fr", "", 2),
    (-11, HOT + " extra", "fr", "c", 9223372036854775807),
] + [(i, f"{HOT}\n{sentence(i % 5 + 500)}", "es", f"s{i % 4}", i) for i in range(100, 160)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DOCS).repartition(5)
    names = ("kept", "n_lines", "tree", "at", "node", "term", "p", "_dropped", "digest", "value", "rank")
    return df.withColumns({c: F.lit("x") for c in names})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- lines -------------------------------------------------------------------------------


def key_of(line: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))


def plain_lines() -> list[tuple]:
    held = defaultdict(set)
    for doc_id, text, *_ in ROWS:
        for line in (text or "").split("\n"):
            held[key_of(line)].add(float("inf") if doc_id is None else doc_id)
    out = []
    for doc_id, text, *_ in ROWS:
        me = float("inf") if doc_id is None else doc_id
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(k := key_of(x)) < 10 or len(held[k]) < 2 or min(held[k]) == me]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("carried_bytes", [1 << 20, -1])
@pytest.mark.parametrize("shard_keys", [1 << 17, 7])
def test_lines(docs, carried_bytes, shard_keys):
    got = line_index.deduplicated(docs, shard_keys=shard_keys, carried_bytes=carried_bytes, probes=40)
    assert set(docs.columns) <= set(got.columns)
    rows = got.select("doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, rows), key=str) == plain_lines()


@pytest.mark.parametrize("carried_bytes", [1 << 20, -1])
def test_lines_of_nothing(empty, carried_bytes):
    assert line_index.deduplicated(empty, carried_bytes=carried_bytes).collect() == []


@pytest.mark.parametrize("n", [1, 2, 63, 5000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, (2 * n, 2)).astype(np.uint64)
    keys[1::2, 0] = keys[::2, 0]  # equal first halves
    shard = line_index.Shard(line_index.perfect_hash(keys), b"", b"", b"")
    assert sorted(shard.slots(keys).tolist()) == list(range(2 * n))


def test_index_counts_documents(docs):
    index, n_shards = line_index.line_index(docs)
    row = index.first()
    assert n_shards == 1
    keys = line_index.as_numbers(line_index.digests([HOT.encode()]))
    shard = line_index.Shard(row["levels"], row["fingerprints"], row["counts"], row["owners"])
    with_hot = sum(any(key_of(x) == HOT for x in (r[1] or "").split("\n")) for r in ROWS)
    assert shard.counts[shard.slots(keys)].tolist() == [with_hot]
    assert shard.owner_of(keys)[1].tolist() == [1]
    foreign = line_index.as_numbers(line_index.digests([b"a line that is nowhere"]))
    assert not shard.owner_of(foreign)[0].any()


# -- the manifest ------------------------------------------------------------------------


def plain_field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row: tuple, more: int = 0) -> str:
    doc_id, text, lang, source, n_chars = row
    n_chars = None if n_chars is None else n_chars + more
    return sha("".join(plain_field(v) for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes: list[str]) -> tuple[str, list[list[tuple]]]:
    """The root, and for each leaf the steps ``(sibling, is it before)``."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            other = a ^ 1
            steps[i].append((nodes[other] if other < len(nodes) else None, a % 2 == 1))
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        at = [a // 2 for a in at]
    return nodes[0], steps


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    found, roots = [], []
    for lang in langs:
        group = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        root, steps = plain_tree([plain_leaf(r) for r in group])
        roots.append(root)
        found.append((group, steps))
    root, above = plain_tree(roots)
    out = []
    for (group, steps), subroot, top in zip(found, roots, above):
        for row, path in zip(group, steps):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = plain_leaf(row, int(changed))
            for sibling, before in path + top:
                node = sha(node) if sibling is None else sha(sibling + node if before else node + sibling)
            proof = "".join(s for s, _ in path + top if s)
            out.append((row[0], plain_leaf(row), subroot, root, proof, node))
    return sorted(out, key=str)


def manifest_rows(df, levels: int) -> list[tuple]:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    more = [F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in fields]
    own = [F.col(c) for c in fields]
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    shown = F.when(changed, merkle.row_hash(more)).otherwise(merkle.row_hash(own))
    made = merkle.manifest(df, own, presented=shown, levels=levels)
    rows = merkle.proofs(made).select("id", "leaf", "subroot", "root", "proof", "folded_root")
    return sorted(map(tuple, rows.collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 3, 8])
def test_manifest(docs, levels):
    assert manifest_rows(docs, levels) == plain_manifest(ROWS)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 17, 33, 64, 65])
def test_manifest_of_sizes(spark, n):
    rows = [(i, str(i), "en", None, i) for i in range(n)]
    assert manifest_rows(spark.createDataFrame(rows, DOCS), 2) == plain_manifest(rows)


def test_manifest_of_nothing(empty):
    made = merkle.manifest(empty, [F.col("doc_id")])
    assert made.root is None and merkle.proofs(made).collect() == []


def test_only_some_levels_are_stored(docs):
    made = merkle.manifest(docs, [F.col("doc_id"), F.col("text")], levels=3)
    # 60 leaves of the largest group: 8 blocks of 8, and one block over these.
    assert len(made.groups.blocks) == 2
    assert made.groups.blocks[0].where("n = 60").count() == 8
    assert made.groups.blocks[1].where("n = 60").select(F.size("items")).first()[0] == 8


# -- the divergence ----------------------------------------------------------------------


def plain_divergence(rows: list[tuple], least: int = 3, top: int = 200) -> list[tuple]:
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in found]
        counts[lang, source].update(found)
        in_docs[lang].update(set(found))
        groups.add((lang, source))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= least]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        mine = [s for g, s in groups if g == lang]
        p = {s: shares(counts[lang, s]) for s in mine}
        q = shares(sum((counts[lang, s] for s in mine), Counter()))
        for s in mine:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in mine if o != s]
            more = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", more)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                cut = len(items) if part == "pair" else top
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items[:cut], 1)]
    return sorted(out)


@pytest.mark.parametrize("block_postings", [1 << 18, 3])
def test_divergence(docs, block_postings, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 2)
    got = divergence.divergence(docs, block_postings=block_postings).collect()
    assert sorted(map(tuple, got)) == plain_divergence(ROWS)


def test_divergence_cuts_only_the_list_of_terms(spark):
    r = random.Random(5)
    names = [sentence(i, 1) for i in range(60)]
    rows = [(i, " ".join(r.choices(names, k=r.randint(0, 300))), "en", f"s{i % 9}", 0) for i in range(90)]
    got = divergence.divergence(spark.createDataFrame(rows, DOCS), top=4).collect()
    assert sorted(map(tuple, got)) == plain_divergence(rows, top=4)


def test_divergence_of_nothing(empty):
    assert divergence.divergence(empty).collect() == []


def test_terms():
    text = "Don't STOP ÄÖ-é1x\x00y_z　w"
    want = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
    assert [t.decode() for t in divergence.terms(text.encode())] == want


def test_share_does_not_overflow(spark):
    n, total, v = 9_000_000_000_000, 9_999_999_999_999, 12_345
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(v))).first()
    assert row[0] == 1 + 10**9 * (n + 1) // (total + v)
