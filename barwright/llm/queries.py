"""The queries of this subpackage: opN_<name>(spark, sf_dir) on whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fingerprints, language, mixing, oracles, quality, sharding, token_files, whitening
from .collocations import collocations
from .common import table
from .line_dedup import dedup_lines
from .ngram_join import ngram_join
from .substring_dedup import substring_dedup


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; the folder is $BARWRIGHT_TOKENIZERS, or that of the installed package."""
    if folder := os.environ.get("BARWRIGHT_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def bucket_of_id(n: int) -> F.Column:
    """crc32(doc_id as text) mod n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents: 5-word shingles, Jaccard of 0.8 or more."""
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded to Arrow files of equal-length sequences, and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = token_files.write_token_files(docs, tokenizer_file("word_bpe_49k.json"), end_id=2, by_word=True)
    return token_files.read_token_files(spark, parts)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of documents, learned from the labels outside the held-out fold; held_out is null for a null id."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels.where(bucket_of_id(5) != 0))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (bucket_of_id(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes, by source targets."""
    return mixing.report(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts."""
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rendered and masked, read back from the output."""
    text = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_conversations(rows, tokenizer_file("byte_bpe_50k.json")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that 50-word windows of earlier documents repeat."""
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 shards of near equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that 10-word windows of benchmark items cover."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents, learned from documents outside the held-out fold; held_out is null for a null id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit_language(docs.where(bucket_of_id(4) != 2))
    found = language.identify_language(docs, model)
    return found.select("doc_id", (bucket_of_id(4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 components of every embedding, whitened; a deviation that isn't a long is null."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"), most=16)
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest collocations of each language."""
    return collocations(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, without those that ten documents have."""
    rows = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_ngram_join, op2_token_files, op3_quality, op4_mixing, op5_fingerprints, op6_chat, op7_substring_dedup, op8_sharding, op9_decontaminate, op10_language, op11_whitening, op12_collocations, op13_line_dedup, pipeline)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
