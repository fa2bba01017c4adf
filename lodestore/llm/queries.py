"""The registered queries of this subpackage; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, licenses, lm, media, packing, quality, setsketch, toxicity, warc
from .common import table


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"))).drop("record_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op4_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = media.with_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    read = docs.select("doc_id", media.utf8_length(F.col("text")).alias("n_bytes"), media.read_png("media").alias("read"))
    return read.select("doc_id", "n_bytes", "read.*")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = chat.format_pairs(chat.neighbour_pairs(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return formatted.select(
        F.col("pair_id").alias("conv_id"), F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt",
        "chosen_completion", spans("chosen_mask").alias("chosen_mask"), "rejected_completion", spans("rejected_mask").alias("rejected_mask"),
    )


def op8_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.NearDuplicates(table(spark, sf_dir, "documents")).classes()


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.summary(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc_bundles, op2_toxicity, op3_trie_lm, op4_png_media, op5_best_fit_packing, op6_quality, op7_preference_chat, op8_setsketch_dedup, op9_decontamination, op10_license_scan)}
