"""A corpus pipeline of five stages over `documents`; part of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daybook.llm import decontam, jaccard, mixing, quality, suffix
from daybook.llm.common import Scratch, swept, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts fail them. Repeated rows stay or go together; no rows give none."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays; texts without words are in no group."""
    return jaccard.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 400 bytes that stand elsewhere too are cut from the texts; no document goes."""
    return suffix.remove_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, and without items all stay."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document that is left: nothing of null and empty texts. A null source is a source; no rows give none."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_sources),
]

#: No stage's rows follow from SQL alone: the first one's weights hang on Spark's hash function.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage is written and read again; what led to it is removed, and so is the stage before."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = swept(lambda stage=stage, docs=docs, k=k: scratch.table(stage(spark, docs, sf_dir), str(k)))
        if k:
            scratch.drop(str(k - 1))
    return docs
