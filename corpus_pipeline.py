"""A corpus run: each stage is one operator, written as Parquet and read again as the next one's documents.

Toxic documents go, then exact copies, then near copies (one of each group stays), then sources are mixed to their
quotas (a document taken twice is there twice), then everything is packed. All stages but the last return the columns
of ``documents``; each looks at all that its predecessor kept. Null and empty texts, repeated rows and empty tables have
the results that the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import common, exact, mixing, packing, simhash, toxicity
from gleaner.llm.tokens import public


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("source_mix", mixed),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = common.keep(stage(spark, docs, sf_dir), name)
        if before is not None:  # what a stage has read goes once its result is written
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned scores, fingerprints and tokenizers are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None
