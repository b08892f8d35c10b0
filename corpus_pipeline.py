"""A training-data pipeline: quality, toxicity, near copies, mixing, tokens. Each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bpe import tokenized
from gridloom.llm.common import Scratch, free_name
from gridloom.llm.jaccard import one_of_each
from gridloom.llm.mixing import OUTPUTS, in_mixed_order, mix
from gridloom.llm.quality import fit_quality, score_quality
from gridloom.llm.toxicity import fit_toxicity, score_toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality is at least a half."""
    name = free_name(docs, "quality_score")
    return score_quality(docs, fit_quality(docs, _labels(spark, sf_dir)), out=name).where(F.col(name) >= 0.5).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below a half."""
    name = free_name(docs, "toxic_score")
    return score_toxicity(docs, fit_toxicity(docs, _labels(spark, sf_dir)), out=name).where(F.col(name) < 0.5).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity of 0.8 or more)."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the sources' schedule. Columns with an output's name wait under a free one."""
    own = {c: free_name(docs, f"own_{c}") for c in docs.columns if c.lower() in OUTPUTS}
    return in_mixed_order(mix(docs.withColumnsRenamed(own))).select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of each document, with its slot, source_rank and mixed, in their order.

    A table that is written and read again has no order. The schedule follows from the documents alone, so it is made again.
    """
    placed = in_mixed_order(mix(docs.select("doc_id", "text", "source")))
    return tokenized(placed, public_tokenizers.path("byte_bpe_50k.json"), ("slot", "source_rank", "mixed"))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_copies", near_copies), ("mixing", mixing), ("tokens", tokens)]

#: Trained networks decide what stays, so SQL can't give these rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as work:
        for name, stage in STAGES[:-1]:
            write = work.result if name == STAGES[-2][0] else work.keep
            docs, before = write(stage(spark, docs, sf_dir), name), docs
            work.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
