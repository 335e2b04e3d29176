"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents.  All stages but the
last return the columns of ``documents``.

Cases: rows with null fields pass through each stage by its operator's rules;
repeated rows become one in the exact stage, and the mixing stage gives a row as
often as its rate says; texts of any length are whole in each stage; ties go to
the smallest id; extra columns pass through all stages but the last; an empty
table stays empty (without labelled documents mixing leaves every row, and
without a language to learn the first stage does).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, language_id, mixing, ngram_join
from plumbline.llm import queries as q
from plumbline.storage import written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that can be told go; all others stay."""
    return language_id.determined(docs, language_id.fit(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id stays."""
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return ngram_join.representatives(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says, so that the output meets the target shares."""
    labels = q.domain_labels(q.read(spark, sf_dir, "labels"))
    if docs.select("doc_id").join(labels.where("domain is not null").select("doc_id"), "doc_id", "left_semi").isEmpty():
        return docs
    return mixing.repeated(docs, mixing.rates(docs, labels, q.DOMAIN_SHARES))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces and their places in sequences of 1024 tokens."""
    return q.packed_digests(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: No SQL: the stages fit models and draw hash signatures. tests/llm checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
