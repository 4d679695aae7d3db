"""A corpus pipeline over documents: toxicity, near-duplicates, benchmark decontamination, personal data, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import byte_bpe, decontamination, ngram_join, pii, toxicity
from pagewright.llm.common import forget, table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of a Jaccard similarity of 0.8 or more connect, the document with the smallest id stays."""
    return ngram_join.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of contaminated documents; one that has no other word goes."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, text): texts as ids, and what the ids decode to."""
    coded = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.col("decoded").cast("string").alias("text"))


STAGES = [("toxicity", toxic), ("n-gram join", near_duplicates), ("decontamination", benchmark), ("personal data", personal_data), ("byte-level BPE", tokens)]

#: No SQL: a trained model decides in the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage wrote goes when the next one has read it."""
    docs, earlier = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if earlier is not None:
            forget(earlier)
        earlier = docs
    return STAGES[-1][1](spark, docs, sf_dir)
