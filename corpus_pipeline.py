"""A training-data pipeline over `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what goes on; run() writes each result as Parquet in the shared checkpoint folder
and reads it again for the next. All stages but the last return the columns of `documents`.

1. language_id drops documents without a language.
2. toxicity drops documents whose probability of a grade over zero reaches the threshold.
3. simhash_dedup keeps one document of each group of near copies (five-word shingles, similarity 0.8 or more).
4. decontamination removes benchmark passages, and documents that mostly consist of them.
5. sentencepiece encodes the texts, decodes them again and tells whether they come back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corelode.llm import decontam, language_id, sentencepiece_codec, simhash, toxicity
from corelode.llm.common import shared_path, table
from corelode.llm.queries import TOKENIZER


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.drop_unidentified(docs, language_id.learn(docs))


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_texts(docs, TOKENIZER)


STAGES = [
    ("language_id", by_language),
    ("toxicity", by_toxicity),
    ("simhash_dedup", without_copies),
    ("decontamination", without_leaks),
    ("sentencepiece", encoded),
]

#: Iterative and learned stages: SQL can't express them. The tests hold them against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
