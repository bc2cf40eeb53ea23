"""Corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a
DataFrame; all but the last return the columns of ``docs`` unchanged. Between stages the rows are
written as Parquet to the shared folder and read again, so a lost executor costs one stage at most.

1. toxicity: rows of an expected severity of ``reject_at`` or more go.
2. exact dedup: of equal texts the row with the largest doc_id stays.
3. near dup: of each component of texts alike (five words, 0.8) the row with the smallest doc_id stays.
4. mixing: under-represented domains are repeated so that expected tokens meet tempered targets; every row
   stays at least once.
5. packing: pieces of at most 1024 tokens, best-fit into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tableproof.llm import exact_dedup, mixing, near_dup, packing, toxicity
from tableproof.llm.queries import domain_of_label
from tableproof.session import materialize


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    p = toxicity.OrdinalParams()
    model = toxicity.train(docs, _labels(spark, sf_dir), p)
    return docs.where(toxicity.severity(F.col("text").cast("string"), model, p)[0] < p.reject_at)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first_copies(docs, exact_dedup.new_index(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one_per_component(docs, near_dup.Jaccard(words=5, percent=80))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    p = mixing.MixParams(least=1.0)
    model = mixing.train_domains(docs, _labels(spark, sf_dir), domain_of_label(), p)
    rows = mixing.mixed(docs, mixing.fit_rates(docs, model, p=p))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("mix.copies")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: No stage but exact dedup can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that the stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
