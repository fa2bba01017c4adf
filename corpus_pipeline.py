"""A training-corpus pipeline over ``documents``.

Quality and toxicity classifiers reject documents, one document of each near-duplicate
group stays, documents with benchmark windows go, and the rest is packed. Each stage
works on all that its predecessor kept; all but the last return the columns of
documents. Columns that documents may have besides are carried along, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import decontaminate, packing, quality, setsketch, toxicity
from lodestore.llm.common import discard, free_name, materialise, table, written

#: Documents with a lower score for quality, or a score of at least this for toxicity, go.
LEAST_QUALITY, TOXIC = 0.3, 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = quality.scorer(spark, quality.fit(docs, table(spark, sf_dir, "labels")))
    mark = free_name(docs, "quality_score")
    return docs.withColumn(mark, score(F.col("text"))).where(F.col(mark) >= LEAST_QUALITY).drop(mark)


def keep_nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = quality.scorer(spark, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    mark = free_name(docs, "toxic_score")
    return docs.withColumn(mark, score(F.col("text"))).where(F.col(mark) < TOXIC).drop(mark)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicate texts (``setsketch.one_of_each``)."""
    return setsketch.one_of_each(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", keep_nontoxic),
    ("near_dedup", keep_distinct),
    ("decontamination", keep_clean),
    ("packing", pack),
]

#: Classifiers and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        discard(spark, since, keep=1)  # what the stage wrote on its way, and its input
    return STAGES[-1][1](spark, docs, sf_dir)
