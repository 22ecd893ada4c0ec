"""From documents to packed sequences: quality, language, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is
written and read again as the next stage's docs. All but the last return the columns of documents.

Every stage takes all rows, decides each by its own text, and keeps columns of any name. Null and empty
texts: quality scores them by zero statistics; language drops them, having none; near duplicates keep
them; packing gives them the end id. Rows without a doc_id take part in all stages, but near duplicates
keep them without comparing. Repeated rows are scored alike; near duplicates keep one row of a doc_id,
that with the first hash of its text. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexspan.llm import _spark, _tokens, decontaminate, jaccard_join, langid, packing, quality
from lexspan.llm.queries import held_out
from lexspan.ship import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores at least 0.3."""
    ship(spark)
    model = quality.fit(docs.where(~held_out()), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones have."""
    ship(spark)
    return langid.accepted(docs, langid.fit(docs.where(~held_out())))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship(spark)
    return jaccard_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    ship(spark)
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    ship(spark)
    return packing.pack(docs, _tokens.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The learned stages and the packing cannot be written in SQL; tests hold the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = _spark.written(docs, name)
    return docs
