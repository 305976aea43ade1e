"""Each operator against a plain version, on small tables with nulls, empty and long
texts, ties, repeated rows and columns of clashing names."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from credtrail.llm import bpe, chat, langid, ngram_join, permutation, pii, repeats, reshard, tiling, warc
from credtrail.llm.components import components
from credtrail.llm.queries import LLM_QUERIES
from credtrail.llm.shingles import shingle_set, word_hashes
from credtrail.plans.storage import new_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


BASE = words(1, 120)
TEXTS = [
    None, "", "   \n", "...", "one", "One TWO", "one two", BASE, BASE, BASE.upper(),
    BASE + " extra", BASE.replace("a", "x", 1), words(2, 60) + " " + words(3, 60),
    words(3, 60) + " " + words(2, 60), words(4, 3000), "ab" * 900, "é" * 700 + words(5, 50),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (7, BASE, None, None, None), (None, "no id", "en", "s", 1)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_warc(spark):
    page = "<p>" + "x" * 40_000 + "WARC/1.1\r\nWARC/1.1\r\n</p>é"
    rows = [(1, "http://a/\r\nb c", page), (2, None, page), (3, "u", None), (4, "u", ""), (5, "u", "b"), (5, "u", "b"), (None, "u", "b")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = new_path(spark, "warc")
    warc.write_archive(warc.deduplicated(pages), path, segment_bytes=1000, chunk_bytes=64)
    got = warc.payload_facts(warc.reassembled(warc.read_records(spark, path))).collect()
    want = []
    for page_id, same in ((1, 2), (2, None), (3, 4), (4, None), (5, None), (5, None), (None, 5)):
        raw = {1: page, 2: page, 3: "", 4: ""}.get(page_id, "b").encode()
        want.append((page_id, len(raw), warc.bare_sha1(raw), "revisit" if same else "response", same))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_warc_refuses_broken_archives(spark):
    path = new_path(spark, "warc")
    record = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 9\r\n\r\nshort"
    spark.createDataFrame([(record,)], "r string").write.option("lineSep", "\r\n\r\n").text(path)
    with pytest.raises(Exception, match="do not fit its length"):
        warc.read_records(spark, path).collect()


def test_similar_groups(docs, empty):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.similar_groups(docs).collect()}
    known, rows = word_hashes(), [(r.doc_id, r.text) for r in docs.collect()]
    sets = [shingle_set(t, known) for _, t in rows]
    name = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                n = len(np.intersect1d(a, b))
                if n and 100 * n >= 80 * (len(a) + len(b) - n):
                    name[i] = name[j] = min(name[i], name[j])
    for i, (doc_id, _) in enumerate(rows):
        assert got[doc_id, len(sets[i])] == rows[name[i]][0]
    assert ngram_join.similar_groups(empty).count() == 0


def test_every_similar_pair_shares_a_signature():
    r = np.random.default_rng(3)
    plans = {b: ngram_join.allocated(b, 10 ** r.integers(1, 6)) for b in range(30)}
    assert any(p[1] for p in plans.values()) and any(p[2] for p in plans.values())
    for _ in range(300):
        size = int(r.integers(1, 400))
        tokens = r.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
        a = np.unique(tokens[:size])
        b = np.unique(np.append(a[int(r.integers(0, size // 5 + 1)) :], tokens[size : size + int(r.integers(0, size // 5 + 1))]))
        n = len(np.intersect1d(a, b))
        if 100 * n < 80 * (len(a) + len(b) - n):
            continue
        bands = [{x, x - 1} & set(plans) for x in map(ngram_join.band_of, (len(a), len(b)))]
        few = np.sort(a[:5])
        shared = [
            set(ngram_join.signatures(a, x, plans[x], few).tolist()) & set(ngram_join.signatures(b, x, plans[x], few).tolist())
            for x in bands[0] & bands[1]
        ]
        assert any(shared)


def test_empty_segments_are_left_out():
    r = np.random.default_rng(5)
    for band in (20, 26, 30, 32):
        size, (n0, n1, k) = ngram_join.EDGES[band], ngram_join.allocated(band, 100_000)
        assert n0 - k + 2 * n1 > ngram_join.differences(band)
        for _ in range(200):
            tokens = r.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
            taken = np.unique((tokens >> np.uint64(32)) * np.uint64(n0 + n1) >> np.uint64(32))
            assert n0 - np.count_nonzero(taken < n0) <= k


def test_finer_sketches_bound_the_difference():
    r = np.random.default_rng(6)
    for n, m in ((0, 900), (1, 1), (300, 300), (3000, 2500), (100, 4000)):
        both, a, b = (r.integers(0, 1 << 63, x, dtype=np.uint64) for x in (n, m, max(1, m // 2)))
        a, b = np.unique(np.append(both, a)), np.unique(np.append(both, b))
        one, other = ngram_join.fine_sketch(a), ngram_join.fine_sketch(b)
        assert ngram_join.bits_apart(one, other) <= len(np.setxor1d(a, b))
        assert ngram_join.bits_apart(one, other) == ngram_join.bits_apart(other, one)
        assert ngram_join.bits_apart(one, one) == 0
    assert ngram_join.bits_apart(one, other) > 1500


def test_texts_of_unrelated_documents_are_not_compared(spark, monkeypatch):
    passage, tried = words(70, 900), []
    rows = [(i, f"{passage} {words(1000 + i, 2500)}") for i in range(24)]
    rows += [(100, rows[3][1] + " more"), (101, rows[4][1].upper()), (102, "  " + rows[3][1])]
    plain = ngram_join.of_ends

    def noted(pairs, classes, *columns):
        tried.extend((columns, tuple(r)) for r in pairs.collect())
        return plain(pairs, classes, *columns)

    monkeypatch.setattr(ngram_join, "of_ends", noted)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {**{i: i for i in range(24)}, 100: 3, 101: 4, 102: 3}
    # Pairs met by the passage, and refused before their texts were joined.
    assert len({p for c, p in tried if "fine" in c}) > 1
    assert len({p for c, p in tried if "text" in c}) == 1


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 3), (60, 50), (50, 60), (None, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50}


def test_language(spark, empty):
    rows = [(i, words(i, 30) if i % 2 else words(i, 30).translate(str.maketrans("abcdefghij", "klmnopqrst")), "ab" if i % 2 else "kl") for i in range(200)]
    learn = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(learn.where(~langid.held_out(F.col("doc_id"))))
    odd = spark.createDataFrame([(1000, None, "ab"), (1001, "123 !", "ab"), (1002, "aé" * 40_000, None)], learn.schema)
    got = {r.doc_id: r for r in langid.predict(learn.unionByName(odd).withColumn("score", F.lit("clash")), model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001)] == [("und", 0.0)] * 2
    assert got[1002].lang_pred == "ab" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.fit(empty) is None
    assert langid.predict(learn, None).where("lang_pred = 'und' and score = 0").count() == len(rows)


def test_code_lengths_are_those_of_the_tree(spark):
    text = words(9, 200)
    model = langid.fit(spark.createDataFrame([(0, text, "a")], "doc_id bigint, text string, lang string"))
    seen = Counter()
    raw = (b"\n" * 3 + text.encode())
    for i in range(3, len(raw)):
        seen[raw[i - 3 : i], raw[i]] += 1

    def counts(context):
        out = Counter()
        for (c, b), n in seen.items():
            if c.endswith(context):
                out[b] += n
        return out

    def chance(context, byte, barred=frozenset()):
        c = counts(context)
        if context and sum(c.values()) < langid.MIN_SEEN:
            return chance(context[1:], byte)
        n, d = sum(c.values()), len(c)
        if byte in c:
            return c[byte] / (n + d)
        if not context:
            return d / (n + d) / (256 - d)
        free = sum(chance(context[1:], b) for b in range(256) if b not in c)
        return d / (n + d) * chance(context[1:], byte) / free

    part = b"\n\n\n" + b"abcab zq"
    want = sum(-np.log2(chance(part[i - 3 : i], part[i])) for i in range(3, len(part)))
    assert model.code_lengths([part[3:]])[0, 0] == pytest.approx(want, rel=1e-4)


def test_reshard(docs, empty):
    placed, changed = reshard.reshard(docs.withColumn("old", F.lit(0)), "old", 3)
    rows = reshard.with_slots(placed.withColumn("text_crc32", F.crc32("text"))).collect()
    size = Counter()
    for r in rows:
        size[r.shard] += r["size"]
    largest = max(r["size"] for r in rows)
    assert len(rows) == len(TEXTS) + 2 and max(size.values()) - min(size.values()) <= 2 * largest
    for shard in size:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert reshard.reshard(empty.withColumn("old", F.lit(0)), "old", 3)[0].count() == 0


def test_flow_moves_the_fewest_bytes():
    r = random.Random(5)
    for _ in range(50):
        n, m = r.randint(1, 5), r.randint(1, 5)
        supply = [r.randint(0, 40) for _ in range(n)]
        demand = reshard.even_capacities(sum(supply), m)
        flow = reshard.minimum_cost_flow(supply, demand)
        for i in range(n):
            assert sum(x for (a, _), x in flow.items() if a == i) == supply[i]
        for j in range(m):
            assert sum(x for (_, b), x in flow.items() if b == j) == demand[j]
        kept = sum(x for (i, j), x in flow.items() if i == j)
        assert kept == sum(min(a, b) for a, b in zip(supply, demand))


def test_chat(spark):
    odd = "\\### Assistant: </turn> <turn:user> \\l \\\\ ok"
    rows = [(1, 0, "system", None), (1, 1, "user", odd), (1, 2, "assistant", odd), (1, 3, "user", ""), (1, 4, "assistant", "é"), (2, 0, "user", "x"), (2, 0, "user", "x"), (None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat.format_turns(turns)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    whole = "".join(f"{role}\n{text or ''}\n" for c, _, role, text in rows if c == 1)
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_sha256) == (5, sha(whole), sha(odd + "é"))
    assert (got[1].loss_chars, got[1].n_examples, got[2].n_turns, got[2].loss_chars) == (len(odd) + 1, 2, 2, 0)
    assert got[None].turns_sha256 == sha("\n\n")
    examples = {(r.conv_id, r.example_no): r for r in chat.expand(formatted).collect()}
    last = examples[1, 1]
    assert last.text.startswith(examples[1, 0].text) and last.text[last.loss_start : last.loss_end] == "é"
    assert chat.digests(chat.format_turns(turns.limit(0))).count() == 0


def test_chat_examples_hold_their_contexts(spark, monkeypatch):
    """An example is a row, or several, with all turns before it; what is read back comes from those."""
    rows = [(c, t, "assistant" if t % 3 else "user", f"<{c}\\{'é' * (t % 5)}") for c in (1, None) for t in range(14)]
    rows += [(2, t, "user", "x") for t in range(3)] + [(1, 5, "assistant", "again")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat.format_turns(turns)
    pieces = {}
    for r in sorted(formatted.collect(), key=lambda r: r.turn_no):
        pieces.setdefault(r.conv_id, []).append(r)
    whole = {r.conv_id: r for r in chat.digests(formatted).collect()}
    monkeypatch.setattr(chat, "PART", 60)
    table = pa.RecordBatch.from_pylist([r.asDict() for c in pieces for r in pieces[c]], chat._arrow(chat.FORMATTED))
    made = [r for b in chat._expand(iter([table])) for r in b.to_pylist()]
    for c, own in pieces.items():
        for r in own:
            if r.example_no is None:
                continue
            parts = [m for m in made if (m["conv_id"], m["example_no"]) == (c, r.example_no)]
            text = "".join(m["text"] for m in sorted(parts, key=lambda m: m["start"]))
            assert text == "".join(o.piece for o in own if o.turn_no <= r.turn_no)
            assert text[parts[0]["loss_start"] : parts[0]["loss_end"]] == r.piece[len("<turn:assistant>") : -len("</turn>\n")]
            assert len(parts) > 1 or len(text) < 200
    examples = spark.createDataFrame([tuple(m.values()) for m in made], chat.EXPANDED)
    assert {r.conv_id: r for r in chat.read_back(examples).collect()} == whole
    assert (whole[1].n_turns, whole[1].n_examples, whole[2].n_turns, whole[2].n_examples) == (15, 10, 3, 0)
    broken = examples.withColumn("text", F.when(F.expr("example_no = 7 and start = 0"), F.regexp_replace("text", "user", "usex")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="do not continue"):
        chat.read_back(broken).collect()


def test_op5_reads_examples(spark, tmp_path):
    rows = [(1, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(8)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    done = LLM_QUERIES["op5_prefix_targets"](spark, str(tmp_path))
    (path,) = {p.rsplit("/", 1)[0] for p in done.inputFiles()}
    stored = spark.read.parquet(path).where("conv_id = 1").orderBy("example_no").collect()
    assert [r.text.count("<turn:") for r in stored] == [2, 4, 6, 8]
    assert {r.conv_id: (r.n_turns, r.n_examples) for r in done.collect()} == {1: (8, 4), -7: (2, 1)}


def test_nearest(spark):
    r = np.random.default_rng(1)
    vectors = [r.normal(size=8).tolist() for _ in range(300)] + [[1.0] * 8] * 100
    rows = list(enumerate(vectors)) + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0]), (None, [1.0] * 8), (1004, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = permutation.search(df, F.col("vec_id") % 20 == 0, 5).collect()
    m, hits = np.array(vectors), 0
    for q in range(0, 400, 20):
        score = m @ m[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(400), -np.round(score, 9)))[:5].tolist()
        mine = sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)
        assert [x.rank for x in mine] == [1, 2, 3, 4, 5]
        assert all(abs(x.score - m[q] @ m[x.vec_id]) < 1e-9 for x in mine)
        hits += len({x.vec_id for x in mine} & set(best))
    assert hits >= 0.9 * 100 and {x.query_id for x in got} == set(range(0, 400, 20))
    assert permutation.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_tiling(spark, docs, empty):
    items = spark.createDataFrame([(1, words(2, 60) + " " + words(3, 60)), (2, "one two"), (3, None), (4, "!"), (5, words(8, 30))], "item_id bigint, text string")
    ways = [tiling.judged(docs.withColumn("coverage", F.lit("clash")), items, limit) for limit in (1 << 30, 0)]
    ways = [sorted(map(str, w.select("doc_id", "n_items", "item_id", "coverage").collect())) for w in ways]
    assert ways[0] == ways[1]
    got = {r.doc_id: r for r in tiling.judged(docs, items).collect()}
    assert [got[i].item_id for i in (12, 13, 6)] == [1, 1, 2]  # 13: the halves the other way round
    assert all(got[i].n_items == 0 for i in (0, 1, 3, 14))
    assert tiling.judged(empty, items).count() == 0
    assert tiling.judged(docs, items.limit(0)).where("n_items > 0").count() == 0


def test_tiles_are_disjoint_and_greedy():
    a, b = np.array([1, 2, 3, 9, 1, 2, 3, 4, 5], np.uint64), np.array([1, 2, 3, 4, 5, 1, 2, 3], np.uint64)
    assert sorted(tiling.tiles(a, b, 2)) == [(0, 5, 3), (4, 0, 5)]


@pytest.mark.parametrize(("length", "rounds"), [(40, 1), (40, 2), (400, 1)])
def test_repeats(docs, empty, length, rounds):
    got = sorted((str(tuple(r)) for r in repeats.removed(docs, length, rounds).collect()))
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    want = []
    for doc_id, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append(str((doc_id, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())))
    assert got == sorted(want)
    assert repeats.removed(empty, length, rounds).count() == 0


PERSONAL = [
    "1.2.3.4.5.6.7.8 a@b.c%x@y.z a@b.c.d@e.f 300.1.1.1 000255.1.1.1 4111-1111 1111 1111 +1 (2) +123456789 x",
    "a" * 50_000 + "@b.c " + "1" * 40 + " 0000000000000000 1.1.1.99999999999", "ñ 12.12.12.12 +1 (123) 555-1234+44 12345678",
    "a.b-c@d-e.f-g.h@@ 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "4111 1111 1111 1111 1 1", None, "", 'token = "0123456789abcdef0123456789abcdef01"',
]


def base_spans(text: str) -> str:
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum((2 * int(c) - 9 * (c > "4")) if i % 2 else int(c) for i, c in enumerate(s[::-1])) % 10 == 0

    tests = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    found = [(m.start(), n, k, m.end()) for n, (k, p, ok) in enumerate(tests) for m in re.finditer(p, text) if ok(m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_personal_data(spark, docs, empty):
    learn = spark.createDataFrame([(i, t) for i, t in enumerate(PERSONAL * 9)], "doc_id bigint, text string")
    trees = pii.fit(learn)
    rows = learn.withColumns({"spans": F.lit("clash"), "found": F.lit(1), "all": F.lit(2)})
    for r in pii.selected(rows, trees).select("text", "found", pii.joined("base").alias("b"), pii.joined("spans").alias("s")).collect():
        assert r.b == base_spans(r.text or "") and r.found == 1
        assert ("secret" in r.s) == ("token" in (r.text or ""))
    clean = {r.doc_id: r.text for r in pii.redacted(learn, trees).collect()}
    assert clean[5] is None and clean[6] == "" and clean[7] == 'token = "[secret]"' and clean[2].startswith("ñ [ip] [phone][phone]")
    assert pii.selected(empty, pii.fit(empty)).count() == 0


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_tokens(spark, docs, empty, ranks):
    odd = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(90, "a" * 3000 + "　\x85\x1c\t x 日本語🙂 ''s 123abc!!\r\n\n  "), (91, "abababab" * 99)], "doc_id bigint, text string"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(odd.withColumn("ids", F.lit("clash")), ranks, public_tokenizers.PATTERN)
    for r in bpe.decode(encoded, ranks, as_text=True).collect():
        assert r.ids == encoding.encode_ordinary(r.text or "") and r.decoded == (r.text or "")
    for r in bpe.with_id_digest(bpe.decode(encoded, ranks)).collect():
        ids = encoding.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), bpe.id_bytes(ids)) and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.decode(bpe.encode(empty, ranks, public_tokenizers.PATTERN), ranks).count() == 0


def test_transducer_equals_merging(ranks):
    machine, r = bpe.Transducer(ranks), random.Random(2)
    for _ in range(300):
        word = bytes(r.choice(b"aeinorst \xc3\xa9'0\n") for _ in range(r.randint(1, 40)))
        assert list(machine.tokens_of(word)) == machine.merged(word)


def test_pairs_equal_merging(ranks):
    """The short test for neighbours against the definition, for tokens that words of all kinds give."""
    machine, r = bpe.Transducer(ranks), random.Random(3)
    tokens = [t for t in ranks if len(t) < 12 and machine._is_whole(t)]
    short = [t for t in tokens if len(t) < 4]
    for _ in range(30_000):
        a, b = r.choice(r.choice([tokens, short])), r.choice(r.choice([tokens, short]))
        assert machine._is_pair(a, b) == (machine.merged(a + b) == [a, b])


def test_transducer_with_few_states(ranks, monkeypatch):
    """Emptying the table in the middle of a word changes nothing, nor does forgetting words."""
    monkeypatch.setattr(bpe, "MAX_STATES", 5)
    machine, r = bpe.Transducer(ranks), random.Random(4)
    kept = bpe.Words(machine, 6)
    words_ = ["".join(r.choice("aeinorst é'0") for _ in range(r.randint(1, 90))) for _ in range(60)]
    for w in words_ + words_:
        want = b"".join(ranks[t].to_bytes(4, "little") for t in machine.merged(w.encode()))
        assert kept[w] == want or ranks[w.encode()].to_bytes(4, "little") == kept[w]


def test_utf8_stream():
    raw = "aé日🙂퟿".encode() + b"\xff\xc3(\xe2\x82"
    for step in (1, 2, 3, 5):
        stream = bpe.Utf8Stream()
        text = "".join(stream.feed(raw[i : i + step]) for i in range(0, len(raw), step)) + stream.end()
        assert text == raw.decode("utf-8", "replace")
