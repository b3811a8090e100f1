"""A corpus pipeline of five stages: language ID, line dedup, near-dedup, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs, so
a stage never starts from another's lineage. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quaver.llm import decontamination, language_id, line_dedup, minhash_dedup, packing
from quaver.llm.common import materialize, release, scope
from quaver.plans.session import ship


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def staged(f: Stage) -> Stage:
    """When a stage begins, the one before is written out, so what that left in the shared folder can go."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        release(spark, "stage")
        with scope("stage"):
            return f(spark, docs, sf_dir)

    return run_stage


@staged
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: the ones that evidence of text, declared language and source puts in none go."""
    return language_id.keep_identified(docs, declared="lang", host="source")


@staged
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template recurs in ten documents or more; the first keeps its line."""
    return line_dedup.drop_recurring_lines(docs)


@staged
def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each group of near duplicates (five words a shingle, similarity 0.8)."""
    return minhash_dedup.drop_near_duplicates(docs)


@staged
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item: the limit of coverage is zero."""
    return decontamination.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), max_coverage=0.0)


@staged
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, each with the corpus's mixture of sources."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: The tokenizer of the last stage, for one, can't be told in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        with scope(f"after {k}"):
            docs = materialize(out, f"stage-{name}")
        release(spark, f"after {k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
