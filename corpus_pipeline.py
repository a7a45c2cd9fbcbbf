"""A corpus pipeline: quality rules, exact dedup, near dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents its predecessor kept. All but
the last return the columns of ``documents``. Stages tell rows apart by id and text, so a row without
an id or with one that repeats goes on its own account; of rows that repeat an id and its text, exact
dedup keeps one. Nulls, empty texts and empty tables have the results stated by each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.functions.scratch import cut, drop, released
from gristmill.llm.exact_dedup import drop_exact_duplicates
from gristmill.llm.mixing import mix
from gristmill.llm.near_dedup import drop_near_duplicates
from gristmill.llm.packing import pack
from gristmill.llm.quality_rules import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified step reject go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component (similarity 0.8 or more) the document with the smallest id stays."""
    return drop_near_duplicates(docs, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mix of nine tenths of the tokens, as flat over sources as no repetition allows, in permuted blocks."""
    return mix(docs, ordered=True, budget_share=0.9, entropy_share=None, max_repeat=1.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    import public_tokenizers

    path = public_tokenizers.path
    return pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: Tokenizer ids, sketches and exact binomial tests have no SQL; tests/llm checks run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with released() as keep:  # a stage's own tables go once its result is written
            docs = keep(cut(stage(spark, before, sf_dir), name))
        drop(before)
    return docs
