"""A corpus pipeline of five stages on documents. Each stage takes (spark, docs, sf_dir) and works on all that the one
before kept; run() writes each stage's rows as Parquet in the shared folder and reads them for the next.

Nulls and empty texts: the classifier scores them as empty texts, the join leaves them unlinked, decontamination
finds nothing in them, the mix takes them as often as its rate says, and sharding counts a null text as 0 bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm import decontaminate, mixing, ngram_join, quality, sharding
from barwright.llm.common import free_names, table, written
from barwright.llm.queries import bucket_of_id

KEEP_SCORE = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents with a quality score of at least 0.3."""
    model = quality.fit_quality(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(bucket_of_id(5) != 0))
    score = free_names(docs.columns, "_score")[0]
    return quality.score_quality(docs, model, score_col=score).where(F.col(score) >= KEEP_SCORE).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of near duplicates the document of the smallest id."""
    return ngram_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: benchmark passages are cut out; documents that are mostly such passages go."""
    out = decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document as often as its source's rate takes it."""
    return mixing.emit(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: shard and slot of every row of the mix."""
    return sharding.shard(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("mix", mix_sources),
    ("shard", deal_shards),
]

#: The classifier's compressed sizes have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
