"""From documents to packed sequences: the stages of a training corpus.

Each stage takes what its predecessor kept and, but for the last, returns the columns
of documents. Between stages the rows are written as Parquet to the folder that all
executors share and read again, which also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspan.llm import langid, linefreq, mixing, packing, simhash
from cohortspan.llm.common import documents, prepare, scratch


#: Share of a source's documents above which the line stage drops a line. On the given tables a
#: source repeats its planted line on 8.6 to 13.2 % of its documents, any other on 4.8 % at most.
LINE_RATIO = 0.06
#: Chunks and pieces in each generation of the tokenizer's cache.
CACHE = (100_000, 250_000)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, whose language is a guess or which are unlike all languages, go."""
    prepare(spark)
    return langid.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a large share of a source's documents repeat go."""
    prepare(spark)
    return linefreq.drop_lines(docs, max_ratio=LINE_RATIO)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    prepare(spark)
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once per use, in training order; a source's uses come near its target."""
    prepare(spark)
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences.

    Workers still hold what earlier stages left, so the tokenizer's cache is smaller than alone.
    """
    prepare(spark)
    return packing.packed(docs, cache=CACHE)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("mix_sources", mixture),
    ("best_fit_packing", packing_stage),
]

#: Hashing, tokenizers and learned models are beyond SQL; tests/llm check the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
