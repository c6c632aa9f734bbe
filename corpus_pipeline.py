"""A corpus through five operators: quality rules, near-duplicates, benchmark passages, mixture, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataquill.llm.common import discard, materialise, scratch
from strataquill.llm.op02_tokens import encode_corpus
from strataquill.llm.op05_mix import mix_documents
from strataquill.llm.op06_decontaminate import decontaminate
from strataquill.llm.op09_simhash import near_dedup
from strataquill.llm.op10_quality import quality_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, from domains that pass theirs."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such passages go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, by the target weights, each document at most once."""
    return mix_documents(docs, fraction=0.8, max_epochs=1)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file's digests: doc_id, start, n_tokens, ids_crc32.

    Python workers outlive their stage, so the encoders remember less than they would alone."""
    return encode_corpus(docs, remember=400_000, slice_bytes=4_000_000)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture), ("tokens", tokens)]

#: SQL can express neither shingle sets nor the token file; a test holds the whole run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's result is written to the shared folder and read again, so a lost executor costs one stage. What a
    stage wrote in between and the result before it are deleted; the last result and the token file stay."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = materialise(stage(spark, docs, sf_dir), name)
            keep(docs)
        if before is not None:
            discard(before)
        before = docs
    return docs
