"""Ids of all 64 bits, negative and absent ones in one batch, through all operators."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestore.llm import chat, decontaminate, licenses, lm, media, packing, quality, setsketch, toxicity, warc

from .conftest import prose

IDS = [2**53 + 1, 2**53 + 3, 2**63 - 1, 2**63 - 3, -(2**63), -5, None, 7]
SAME = prose(1, 80)


@pytest.fixture(scope="module")
def docs(spark):
    """The first two texts are equal; one batch holds all rows."""
    rows = [(i, SAME if k < 2 else prose(k, 60)) for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("my.col", F.lit("x"))


def ids(df, column="doc_id"):
    return sorted((r[0] for r in df.select(column).collect()), key=lambda x: (x is None, x))


WANT = sorted(IDS, key=lambda x: (x is None, x))


def test_documents(spark, docs, labels):
    bench = spark.createDataFrame([(2**53 + 1, prose(7, 60)), (2**53 + 3, prose(7, 60))], "item_id long, text string")
    for out in (
        toxicity.score_documents(docs, labels), quality.score_documents(docs, labels), lm.score_documents(docs), packing.pack_documents(docs),
        decontaminate.summary(docs, bench), licenses.scan_licenses(docs), media.with_media(docs).select("doc_id", media.read_png("media").alias("r")),
    ):
        assert ids(out) == WANT
    hit = decontaminate.summary(docs, bench).where("contaminated").collect()
    assert [(r["doc_id"], r["n_items"]) for r in hit] == [(7, 2)]


def test_near_duplicates(docs):
    got = {r["doc_id"]: r["component_id"] for r in setsketch.NearDuplicates(docs).classes().collect()}
    assert got == {i: 2**53 + 1 if i == 2**53 + 3 else i for i in IDS}


def test_pages(spark):
    rows = [(i, "u\r\nWARC-Type: x", f"<p>{SAME}" if k in (0, 1, 2) else f"<p>{prose(k, 60)}") for k, i in enumerate(IDS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).withColumn("digest", F.lit("clash"))
    archives = warc.write_archives(pages)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_archives(archives).collect()}
    assert got == {i: ("revisit", 2**53 + 1) if k in (1, 2) else ("response", None) for k, i in enumerate(IDS)}
    assert [r["page_id"] for r in warc.fetch(archives, [2**63 - 3]).collect()] == [2**63 - 3]


def test_conversations(spark):
    rows = [(i, k, r, f"{k}") for i in IDS for k, r in enumerate(("user", "assistant"))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert ids(chat.format_pairs(chat.neighbour_pairs(turns)), "pair_id") == WANT[:-1]


def test_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(7, 60))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    less = lambda *gone: [i for i in WANT if i not in gone]
    for name, want in (("near_dedup", less(2**53 + 3)), ("decontamination", less(7)), ("packing", WANT)):
        out = stages[name](spark, docs, str(tmp_path))
        assert ids(out) == want
        assert name == "packing" or out.columns == docs.columns
    assert set(ids(stages["quality"](spark, docs, str(tmp_path)))) <= set(IDS)


def test_one_of_each(spark):
    """Unlike texts of one id, rows without id and rows without words all stay."""
    a, b, c = prose(11, 50), prose(12, 50), prose(13, 50)
    rows = [(5, a, "x"), (5, b, "x"), (4, b, "y"), (4, b, "x"), (4, b, "x"), (None, c, "x"), (None, c, "y"), (9, c, "y"), (None, prose(14, 50), "x"), (8, None, "x"), (8, None, "x"), (None, " ", "x")]
    got = setsketch.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 7
    assert {(r["doc_id"], r["text"]) for r in got} == {(5, a), (4, b), (9, c), (None, prose(14, 50)), (8, None), (None, " ")}
