"""The queries of this folder, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credtrail.llm import (
    bpe, chat, divergence, langid, line_index, merkle, ngram_join, permutation, pii, repeats, reshard, tiling, warc,
)
from credtrail.llm.common import small_batches, table, written
from credtrail.llm.oracle import LLM_ORACLE as LLM_ORACLE
from credtrail.plans.storage import new_path

CONTROL_TEXT = r"\### Assistant: </turn> ok"
SHARDS, OLD_SHARDS = 24, 32


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives in segments, read back and put together."""
    path = new_path(spark, "warc")
    warc.write_archive(warc.deduplicated(table(spark, sf_dir, "pages")), path)
    # Payloads are decoded and checked; only their facts are kept.
    read = written(warc.reassembled(warc.read_records(spark, path)).drop("payload"), "records")
    return warc.payload_facts(read)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose five-word shingles are similar."""
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~out))
    return langid.predict(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")


def op4_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by source made into shards of equal size; the files are written and read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    docs = docs.withColumn("old_shard", F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS)).cast("int"))
    placed, changed = reshard.reshard(docs, "old_shard", SHARDS)
    path = new_path(spark, "shards")
    reshard.rewrite(placed, changed, path)
    # Shards that do not change keep their old files; here these are the input.
    facts = ["doc_id", "size", F.coalesce(F.crc32("text"), F.lit(0).cast("bigint")).alias("text_crc32"), "old_shard", "shard"]
    kept = placed.where(~F.col("shard").isin(changed)).select(*facts)
    new = spark.read.schema(placed.schema).parquet(path).select(*facts) if changed else kept
    rows = reshard.with_slots(new.unionByName(kept) if changed else kept)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )


def op5_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted, every assistant turn an example with all before it, and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    extra = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    examples = chat.expand(chat.format_turns(turns.unionByName(extra)))
    # Examples repeat those before them; this codec looks back far enough to tell.
    return chat.read_back(written(examples, "examples", compression="zstd"))


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest neighbours of every twentieth vector."""
    return permutation.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each document covers an item of the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = tiling.judged(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "item_id", "coverage")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left when strings of 400 bytes that occur elsewhere are removed."""
    small_batches(spark)
    rows = repeats.removed(table(spark, sf_dir, "documents"))
    return rows.withColumn("has_repeats", F.col("n_removed") > 0)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, base kinds and those that the trees add."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pii.selected(docs, pii.fit(docs))
    counts = [pii.count_of(k).alias(f"n_{k}") for k in pii.BASE]
    return rows.select("doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"), (pii.joined("spans") != "").alias("has_personal_data"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the bytes they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text")
    decoded = bpe.decode(encoded, ranks, digests=True)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of smaller id holds as well."""
    kept = line_index.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof for every document, tried on a copy in which some are changed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    # One more in a type that no count outgrows.
    more = [F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in fields]
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    own = [F.col(c) for c in fields]
    presented = F.when(changed, merkle.row_hash(more)).otherwise(merkle.row_hash(own))
    rows = merkle.proofs(merkle.manifest(docs, own, presented=presented))
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ, and their own terms."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc, op2_ngram_jaccard, op3_language, op4_reshard, op5_prefix_targets,
        op6_permutation_index, op7_string_tiling, op8_repeats, op9_pii, op10_byte_bpe,
        op11_line_index, op12_merkle_manifest, op13_source_divergence,
    )
}
