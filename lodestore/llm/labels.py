"""Labelled training rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, materialise

#: Classifiers are fitted on at most about this many labelled rows, drawn by a hash of
#: the id. The sample is small enough to be broadcast and to be summed on the driver.
SAMPLE = 20_000


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod ``modulus`` is ``remainder``; false for null."""
    return F.coalesce(bucket_of("doc_id", modulus) == remainder, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, sample: int = SAMPLE) -> DataFrame:
    """A stored table (doc_id, text, y, fold) of labelled documents outside the held-out
    bucket; ``fold`` 0..4 is another hash of the id. Rows without id or label are not
    learned from; of several labels for an id the largest counts."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(modulus, remainder))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    share = min(1.0, sample / max(1, known.count()))
    order = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    chosen = known.where(order < share).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(5)).cast("int"))
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(texts.join(F.broadcast(chosen), "doc_id"), "training")
