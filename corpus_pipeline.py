"""A corpus made ready for training: five stages, each a table written and read again.

Rows keep the columns of ``documents`` until the last stage. Defined cases: null texts and
texts without a letter go in the first stage; documents with a null id are judged like
others and never dropped as copies; an empty table runs through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credtrail.llm import bpe, langid, ngram_join, pii, tiling
from credtrail.llm.common import small_batches, table, written
from credtrail.plans.sizing import broadcast_if_small

#: Share of the winning language below which a document is rejected.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    small_batches(spark)
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    kept = langid.predict(docs, model).where(
        (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    )
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays."""
    small_batches(spark)
    groups = ngram_join.similar_groups(docs)
    copies = groups.where("doc_id <> component_id").select("doc_id").distinct()
    copies = written(copies, "copies")
    return docs.join(broadcast_if_small(copies), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover an item of the benchmark go."""
    small_batches(spark)
    judged = tiling.judged(docs, table(spark, sf_dir, "benchmark"))
    return judged.where(F.col("n_items") == 0).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` counts the new text."""
    clean = pii.redacted(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to its bytes."""
    small_batches(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    # The text stays behind; its digest is what the decoded bytes are held against.
    own = F.sha2(F.coalesce("text", F.lit("")), 256).alias("own")
    rows = docs.select("doc_id", "lang", "source", own, "text")
    # Smaller tables than by default: this stage shares its executors with others.
    encoded = bpe.encode(rows, ranks, public_tokenizers.PATTERN, max_words=50_000, max_states=15_000).drop("text")
    # Written in between: encoding and decoding then take turns in the same Python workers.
    return bpe.decode(written(encoded, "encoded"), ranks).select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
        (F.sha2("decoded", 256) == F.col("own")).alias("round_trip"),
    )


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Language, tiling, trees and tokens are beyond SQL; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
