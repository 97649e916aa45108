"""From raw documents to sharded training text: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import decontaminate, language, mixing, ngram_join, queries, sharding
from plumbline.llm.shared import free_prefix, read, written


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those of no letter or no text go."""
    made = free_prefix(docs.columns)
    found = language.identify(docs, language.train(docs), spans=False, prefix=made)
    return found.where(F.col(f"{made}lang_pred") != language.UNKNOWN).select(*_own(docs))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one of the smallest id."""
    rows = docs.select(F.struct(*_own(docs)).alias("row"), "doc_id", "text")
    return ngram_join.keep_one(rows).select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    made = free_prefix(docs.columns)
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"), prefix=made)
    return found.where(~F.col(f"{made}contaminated")).select(*_own(docs))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights takes them."""
    return mixing.mixed(docs, queries.MIX_WEIGHTS, queries.MIX_MOST)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return queries.shard_columns(sharding.shard(docs, queries.SHARDS))


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each_class),
    ("benchmark_decontamination", without_benchmark),
    ("mixing", mixed_sources),
    ("sharding", sharded),
]

#: Predicted languages cannot be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
