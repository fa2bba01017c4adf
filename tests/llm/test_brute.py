"""Licenses, packing and the whole pipeline against plain Python."""

import random
import re
from collections import Counter

import corpus_pipeline
from lodestore.llm import licenses, packing, quality, toxicity
from lodestore.llm.queries import QUERIES

from ..conftest import DATA
from .conftest import edited, prose
from .test_operators import ALNUM, SPACE, brute_classes, low, rows_of

SPACES = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200C))) + "    　﻿"
BREAKS = "\n\r\x0b\x0c\x85  "
BLANKS = "".join(c for c in SPACES if c not in BREAKS)


def scanned(text, table):
    """Labels and score by trying every rule everywhere, without any prefilter."""
    tidy = re.sub(rf'[{BLANKS}]*[{BREAKS}][{SPACES}/*#;%>|!"<-]*(?:(?:dnl|rem)[ \t]+)?', "\n", low(text))
    tidy = re.sub(f"[{BLANKS}]+", " ", tidy)
    found = [(m.start(), m.end(), p, label, sure) for p, label, rule, sure in table for m in rule.finditer(tidy)]
    kept = [d for d in found if not any(e[0] <= d[0] and d[1] <= e[1] and (e[2] > d[2] or e[2] == d[2] and e[1] - e[0] > d[1] - d[0]) for e in found)]
    words = ALNUM.findall(low(text))
    base = {label for label, p in licenses.PHRASES.items() if any(tuple(words[k : k + len(p)]) == p for k in range(len(words)))}
    return ",".join(sorted(base | {d[3] for d in kept})), 1.0 if base else max((d[4] for d in kept), default=0.0)


def test_licenses_without_prefilter(spark):
    table = [(r["priority"], r["label"], re.compile(r["pattern"], re.ASCII), r["confidence"]) for r in licenses.rules()]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    seen = set()
    for r in rows_of(QUERIES["op10_license_scan"](spark, DATA)):
        want = scanned(docs[r["doc_id"]], table)
        assert (r["labels"], round(r["score"], 9)) == (want[0], round(want[1], 9)), r["doc_id"]
        seen |= set(r["labels"].split(","))
    assert len(seen) > 3


def test_joint_lengths_beat_a_sweep():
    """Lengths chosen by what is to come cost no more than any one preferred length."""
    better = 0
    for seed, (least, most) in enumerate([(300, 700), (600, 3000), (350, 390), (100, 8192), (1, 2)]):
        rng = random.Random(seed)
        sizes = [rng.randint(least, most) for _ in range(1500)]
        order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
        joint = packing._trial(sizes, order, packing.LENGTHS, packing._opener(sizes, packing.LENGTHS))[0]
        sweep = min(packing._trial(sizes, order, packing.LENGTHS, lambda size, _, p=p: next(x for x in packing.LENGTHS if x >= max(size, p)))[0] for p in packing.LENGTHS)
        assert joint <= sweep * 1.001
        better += joint < sweep
    assert better >= 2


def test_packed_copies(spark):
    """Rows that repeat one another fill several shards."""
    docs = spark.createDataFrame([(7, "a b c")], "doc_id long, text string").crossJoin(spark.range(45_000)).select("doc_id", "text")
    got = packing.pack_documents(docs)
    assert got.count() == 45_000 and got.selectExpr("split(bin_id, '-')[0] AS shard").distinct().count() == 3


def test_pipeline(spark, tmp_path):
    rows = [(k, prose(k, 60 + k)) for k in range(60)] + [(100 + k, edited(prose(k, 60 + k), 60)) for k in range(0, 30, 3)] + [(200, prose(5, 65)), (5, prose(5, 65)), (None, prose(6, 66)), (201, None), (202, ""), (203, prose(77, 9000)), (None, "no id here")]
    rows += [(300 + k, " ".join(["IDIOT stupid loser"] * 20)) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(k, int(k % 5 > 0), int(k % 7 == 0)) for k in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    item = " ".join(prose(8, 68).split()[20:45])
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))

    def kept(rows, module, column, keep):
        made = spark.createDataFrame(rows, "doc_id long, text string")
        model = module.fit(made, labels)
        return [r for r, s in zip(rows, model.score([t for _, t in rows]), strict=True) if keep(min(max(s, 0), 1))]

    rows = kept(rows, quality, "quality", lambda s: s >= corpus_pipeline.LEAST_QUALITY)
    rows = kept(rows, toxicity, "toxic", lambda s: s < corpus_pipeline.TOXIC)
    home = brute_classes([(k, t) for k, (_, t) in enumerate(rows)])
    groups = {}
    for k, (i, t) in enumerate(rows):
        if not SPACE.findall(t or ""):
            groups[f"wordless {k}"] = (i, t)
        else:
            groups[home[k]] = min(groups.get(home[k], (i, t)), (i, t), key=lambda r: (r[0] is None, r[0]))
    windows = [ALNUM.findall(item)[k : k + 10] for k in range(16)]
    text_of = lambda t: f" {' '.join(ALNUM.findall(low(t)))} "
    clean = [(i, t) for i, t in groups.values() if not any(f" {' '.join(w)} " in text_of(t) for w in windows)]
    assert len(clean) < len(groups) < len(rows)
    want = Counter()
    for i, t in clean:
        want[i] += len(SPACE.findall(t or "")) + 1
    got = Counter()
    for r in rows_of(corpus_pipeline.run(spark, str(tmp_path))):
        got[r["doc_id"]] += r["size"]
    assert got == want
