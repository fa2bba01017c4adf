"""The operators against brute force, on awkward rows and on the small tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
import corpus_pipeline
from lodestore.llm import chat, common, decontaminate, licenses, lm, media, packing, quality, setsketch, textscan, toxicity, warc
from lodestore.llm.components import connected_components
from lodestore.llm.oracles import ORACLES
from lodestore.llm.queries import QUERIES

from ..conftest import DATA
from ..test_queries import same
from .conftest import awkward_rows, prose

SPACE, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert same(spark, QUERIES[name], ORACLES[name])


def test_all_registered():
    names = registered.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_scan():
    texts = [t for _, t in awkward_rows()]
    for table, pattern in ((textscan.SPACE, SPACE), (textscan.ALNUM, ALNUM)):
        scan, seen = textscan.Scan(texts, table), {}
        for k, t in enumerate(texts):
            words = pattern.findall(low(t))
            hashes = scan.hashes[scan.offsets[k] : scan.offsets[k + 1]].tolist()
            assert len(words) == len(hashes)
            for w, h in zip(words, hashes, strict=True):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def shingles(text):
    w = SPACE.findall(low(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(rows):
    sets, home = [(i, shingles(t)) for i, t in rows if i is not None], {i: i for i, _ in rows if i is not None}

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            both = len(s & t)
            if both and 100 * both >= 75 * len(s | t):
                x, y = sorted((find(a), find(b)))
                home[y] = x
    return {i: find(i) for i in home}


def test_near_duplicates(awkward):
    got, want = rows_of(setsketch.NearDuplicates(awkward).classes()), brute_classes(awkward_rows())
    assert len(got) == len(awkward_rows())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]])
    sizes = {(i, len(shingles(t))) for i, t in awkward_rows()}
    assert {(r["doc_id"], r["n_shingles"]) for r in got} == sizes


def test_near_duplicates_of_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    want = brute_classes(docs)
    assert {r["doc_id"]: r["component_id"] for r in rows_of(QUERIES["op8_setsketch_dedup"](spark, DATA))} == want


def test_chain_of_links_across_components(spark):
    """Neighbours in a chain are linked, its ends are not; all of it is one class."""
    base = prose(1, 300).split()
    rows = [(k, " ".join(base[: 300 - 25 * k] + prose(1000, 300).split()[: 25 * k])) for k in range(9)]
    got = {r["doc_id"]: r["component_id"] for r in rows_of(setsketch.NearDuplicates(spark.createDataFrame(rows, "doc_id long, text string")).classes())}
    assert got == brute_classes(rows) and len(set(got.values())) == 1


def test_sketch_estimates():
    rng = np.random.default_rng(5)
    for share in (0.5, 0.75, 0.9):
        a = rng.integers(1, 1 << 63, 4000, dtype=np.uint64)
        b = np.concatenate((a[: int(4000 * share)], rng.integers(1, 1 << 63, 4000 - int(4000 * share), dtype=np.uint64)))
        true = share / (2 - share)
        s = setsketch.sketches([np.unique(a), np.unique(b), np.unique(np.concatenate((a, b)))])
        assert abs(setsketch.estimate(s[:1], s[1:2], np.array([4000.0]), np.array([4000.0]))[0] - true) < 0.11
        assert (np.maximum(s[0], s[1]) == s[2]).all()  # sketches merge by maximum


def test_components(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in rows_of(connected_components(links))}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


@pytest.mark.parametrize("bits", [27, 4])
def test_decontamination(spark, awkward, bits, monkeypatch):
    """Also with a sieve so small that it lets nearly everything through to the join."""
    monkeypatch.setattr(decontaminate, "LEAST_BITS", min(bits, 16))
    monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
    items = [(1, " ".join(prose(4, 44).split()[5:30])), (2, "x" * 200_000), (3, None), (4, ""), (None, prose(4, 44)), (5, "ONE, two!"), (6, "one-two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = [(str(i), w[k : k + 10]) for i, t in items if i is not None for w in [ALNUM.findall(low(t))] if w for k in range(max(1, len(w) - 9))]
    want = Counter()
    for i, t in awkward_rows():
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for item, win in windows:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(item)
        want[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    got = decontaminate.summary(awkward, bench)
    assert Counter(map(tuple, got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())) == want
    clean = decontaminate.drop_leaks(awkward, bench)
    assert clean.columns == awkward.columns and clean.count() == sum(n for k, n in want.items() if not k[5])


def test_language_model(spark, awkward):
    rows, words, pairs, triples = awkward_rows(), Counter(), Counter(), Counter()
    tokens = [SPACE.findall(low(t)) + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    for t, h in zip(tokens, held, strict=True):
        if not h:
            line = ["<>", "<>", *t]
            words.update(t)
            pairs.update(zip(line, line[1:], strict=False))
            triples.update(zip(line, line[1:], line[2:], strict=False))
    n, v = sum(words.values()), len(words)
    words["<>"] = words[None]

    def chance(a, b, c, shown=lambda x: x):
        k = lambda x: min(lm.CAP, lm.CAP * x**-lm.FALL) if x else 1.0
        uv, vw = pairs[a, b], shown(pairs[b, c])
        if triples[a, b, c]:
            return (1 - k(uv)) * (triples[a, b, c] - lm.CUT) / uv
        two = (1 - k(words[b])) * (vw - lm.CUT) / words[b] if vw else k(words[b]) * (words[c] + 1) / (n + v + 1)
        return k(shown(uv)) * two

    def score(t):
        line = ["<>", "<>", *t]
        coded = lambda x: lm.COUNTS[lm.count_codes(np.array([x]))[0]]
        return sum(math.log10(chance(*x, coded)) for x in zip(line, line[1:], line[2:], strict=False))

    for context in (("<>", "<>"), tuple(tokens[0][:2]), (tokens[1][3], "never seen"), ("never", "seen")):
        assert sum(chance(*context, w) for w in words if w != "<>") <= 1 + 1e-9

    def key(r):
        return str(r[0]), r[2], r[3]

    got = sorted((tuple(r) for r in lm.score_documents(awkward, shards=5).collect()), key=key)
    want = sorted(((i, h, len(t), sum(words[w] > 0 for w in t), n, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in t), score(t)) for (i, _), h, t in zip(rows, held, tokens, strict=True)), key=key)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and g[6] == pytest.approx(w[6], rel=5e-3)


def test_elias_fano():
    rng = np.random.default_rng(3)
    for universe, values in ((1 << 41, [0, 0, 5, 5, 1 << 40]), (10, [3]), (1 << 32, np.unique(rng.integers(0, 1 << 32, 5000))), (1 << 50, np.arange(3000) + (1 << 49)), (3001, np.arange(3001)), (1 << 36, np.sort(rng.integers(0, 64, 2000)))):
        v = np.array(values, np.uint64)
        coded = lm.EliasFano.encode(v, universe)
        assert (coded.get(np.arange(len(v))) == v).all()
        ranges = np.zeros(len(v), np.int64), np.full(len(v), len(v), np.int64)
        assert (v[coded.find(v, *ranges)] == v).all()
        others = np.setdiff1d(rng.integers(0, universe, 500, dtype=np.uint64), v)
        assert (coded.find(others, np.zeros(len(others), np.int64), np.full(len(others), len(v), np.int64)) == -1).all()


def test_trie():
    rng = np.random.default_rng(3)
    pairs = np.unique(rng.integers(0, 50, 900, dtype=np.uint64) << lm.BITS | rng.integers(0, 200, 900, dtype=np.uint64))
    below = np.unique(rng.integers(0, len(pairs), 5000) * 1000 + rng.integers(0, 1000, 5000))
    home, thirds = below // 1000, (below % 1000).astype(np.uint32)
    counts = rng.integers(1, 1000, len(home))
    totals = np.maximum(np.bincount(home, counts, len(pairs)), 1)
    trie = lm.Trie(pairs, totals, home, thirds, counts)
    assert (trie.places(pairs) == np.arange(len(pairs))).all()
    value = trie.value(trie.successors(home, thirds))
    assert np.abs(value - np.log10(counts - lm.CUT) - lm.seen_weight(totals[home])).max() <= trie.step / 2 + 1e-9
    others = np.setdiff1d(rng.integers(0, 60, 500, dtype=np.uint64) << lm.BITS | np.uint64(7), pairs)
    assert (trie.places(others) == -1).all() and (trie.successors(home, thirds + np.uint32(1000)) == 0).all()
    none = lm.Trie(pairs[:0], totals[:0], home[:0], thirds[:0], counts[:0])
    assert (none.places(pairs) == -1).all() and (none.successors(none.places(pairs), np.zeros(len(pairs), np.uint32)) == 0).all()


def test_media(awkward):
    got = media.with_media(awkward.select("doc_id", "text")).select("doc_id", "media", media.read_png("media").alias("r")).select("doc_id", "media", "r.*").collect()
    want = Counter()
    for i, t in awkward_rows():
        p = media.pad((t or "").encode())
        want[i, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r[0], r[2], r[3], r[4]) for r in got) == want
    broken = bytearray(bytes(got[0]["media"]))
    broken[-20] ^= 1
    with pytest.raises((media.MediaError, zlib.error)):
        media.decode(bytes(broken))


def test_png_filters():
    """Rows filtered in each of the five ways come back."""
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (10, 64), dtype=np.uint8)
    kinds, lines = np.array([0, 1, 2, 2, 3, 4, 4, 1, 2, 3]), np.empty_like(image)
    for y in range(10):
        for x in range(64):
            a, b = int(image[y, x - 1]) if x else 0, int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            paeth = min(((abs(a + b - c - v), k, v) for k, v in enumerate((a, b, c))))[2]
            lines[y, x] = (int(image[y, x]) - [0, a, b, (a + b) // 2, paeth][kinds[y]]) & 255
    assert (media._unfilter(kinds, lines) == image).all()


def test_warc(spark):
    long_, other = "<p>é</p>" * 50, "<b>" * 60
    rows = [(5, "u", long_), (3, "u", long_), (9, None, long_), (3, "u", long_), (None, "u", long_), (7, "u", "short"), (8, "u", "short"), (10, "u", None), (11, "u", ""), (12, "v", other)]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    read = warc.read_archives(archives)
    got = Counter(tuple(r) for r in read.drop("record_id").collect())
    assert read.select("record_id").distinct().count() == len(rows)
    want = Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        again = p is not None and h == long_ and p > 3
        want[p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 3 if again else None] += 1
    assert got == want
    assert {bytes(r["payload"]) for r in warc.fetch(archives, [12]).collect()} == {other.encode()}
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_seek_table():
    frames = [b"a" * 10, b"b" * 7]
    assert warc.seek_table(warc.seal(frames, [100, 70])) == [(0, 10, 100), (10, 7, 70)]


def test_license_gates(spark):
    """Each rule's own example is found without any other word that opens the gate."""
    examples = [("grant", n, f"released under the {n}") for n in ("mit", "isc", "wtfpl", "zlib", "mpl 2.0", "apache 2.0")]
    examples += [("bare", n, n) for n in ("Apache-2.0", "mpl-2.0", "EPL-2.0", "bsl-1.0", "cecill-2.1", "ASL 2.0", "gfdl-1.3", "osl-3.0", "upl-1.0", "psf-2.0", "odbl", "0BSD", "LGPL-2.1", "agplv3", "busl-1.1", "CC0")]
    examples += [("said", "mit", 'x: "license": "MIT"'), ("said", "isc", "License: ISC"), ("other", "copyright", "Copyright 2020\nApache-2.0")]
    docs = spark.createDataFrame([(k, text) for k, (_, _, text) in enumerate(examples)] + [(100, "wir kommen mit dem Zug"), (101, "permit example discuss replace accept")], "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan_licenses(docs).collect()}
    alias = {"mpl 2.0": "mpl-2.0", "apache 2.0": "apache-2.0", "asl 2.0": "apache-2.0", "odbl": "odbl-1.0", "agplv3": "agpl-3.0", "cc0": "cc0-1.0"}
    for k, (_, name, _) in enumerate(examples):
        assert alias.get(name.lower(), name.lower()) in got[k], examples[k]
    assert "apache-2.0" in got[len(examples) - 1]
    assert got[100] == got[101] == {""}
    table = licenses.rules()
    alone = spark.createDataFrame([(" ".join(s).upper(),) for r in table for s in r["need"]], "text string")
    assert alone.where(~licenses._gated(alone["text"], F.lower("text"), table)).collect() == []
    assert licenses.needed(r"ab(?:cd|ef)? ?gh[ij]k{2,}|x-1\.0") == [["ab", "gh"], ["x-1.0"]]


def test_licenses_in_wrapped_text(spark):
    texts = {
        1: ("under the terms of the GNU Lesser General Public\nLicense as published by", "lgpl,unknown-license"),
        2: ("# Neither the name of the copyright holder nor the names of its\n# contributors may be used to endorse or promote", "bsd-3-clause"),
        3: (" * Apache License,\r\n * Version 2.0", "apache-2,apache-2.0"),
        4: ("GNU  Lesser\tGeneral Public License", "lgpl"),
        5: ("// Redistribution and use in source\n// and binary  forms", "bsd"),
        6: ("released under MIT\nISC license", "isc,mit"),  # a line break may end a reference
        7: ("gnu affero general\n-- public license v3", "agpl-3.0"),
        8: ("Released under the\n\n mpl 2.0. " + "filler " * 3000 + "gnu general\npublic license", "gpl,mpl-2.0"),
    }
    docs = spark.createDataFrame([(k, text) for k, (text, _) in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs).collect()}
    assert got[1] in ("lgpl", "lgpl,unknown-license")
    assert {k: got[k] for k in texts if k > 1} == {k: want for k, (_, want) in texts.items() if k > 1}


def test_licenses(spark, awkward):
    texts = ["Released UNDER the, MIT license. under the mit license", "Apache License, Version 2.0", "x\nCC BY-NC 4.0 here", "SPDX-License-Identifier: GPL-3.0", "Redistribution and use in source and binary forms", None, "", "nothing", "distributed under the GNU Lesser General Public License v2.1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["labels"], got[0]["score"]) == (2, 1, 5, "mit", 1.0)
    assert got[1]["labels"] == "apache-2,apache-2.0" and got[2]["labels"] == "cc-by-nc,cc-by-nc-4.0"
    assert got[3]["labels"] == "gpl-3.0" and got[4]["labels"] == "bsd" and got[8]["labels"] == "lgpl-2.1"
    assert [got[k]["labels"] for k in (5, 6, 7)] == ["", "", ""] and got[5]["n_words"] == 0
    line = "the gnu affero general public license v3 and later the gnu general public license, and once more gnu general public license, gpl-3.0"
    again = spark.createDataFrame([(1, line), (2, line.replace(", gpl-3.0", "")), (3, "gpl-3.0 " * 3 + "mpl-2.0"), (4, "SPDX-License-Identifier: MIT; see the license terms")], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(again).collect()}
    assert got == {1: "agpl-3.0,gpl,gpl-3.0", 2: "agpl-3.0,gpl", 3: "gpl-3.0,mpl-2.0", 4: "mit,unknown-license"}  # matches after a suppressed or a first one count
    assert licenses.scan_licenses(awkward).count() == len(awkward_rows())
    assert len(licenses.rules()) > 200
    for r in rows_of(QUERIES["op10_license_scan"](spark, DATA).join(documents(spark).select("doc_id", "text"), "doc_id")):
        words = ALNUM.findall(low(r["text"]))
        at = {label: [k for k in range(len(words)) if tuple(words[k : k + len(p)]) == p] for label, p in licenses.PHRASES.items()}
        places = sum(at.values(), [])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(k for k, v in at.items() if v))


def test_packing(spark, awkward):
    rng = random.Random(4)
    sizes = [rng.randint(1, 8192) for _ in range(300)] + [8192, 1]
    bins, places, final = packing.best_fit(sizes)
    used = Counter()
    for s, b, p in sorted(zip(sizes, bins, places, strict=True), key=lambda x: (x[1], x[2])):
        assert p == used[b]
        used[b] += s
    assert all(min(x for x in packing.LENGTHS if x >= used[b]) == final[b] for b in range(len(final)))
    single = sum(packing.cost(min(x for x in packing.LENGTHS if x >= s)) for s in sizes)
    assert sum(map(packing.cost, final)) <= single
    want = Counter((i, len(SPACE.findall(t or "")) + 1) for i, t in awkward_rows())
    got = rows_of(packing.pack_documents(awkward))
    assert sum(r["size"] for r in got) == sum(n * k for (_, n), k in want.items())
    assert all(r["place"] + r["size"] <= r["bin_length"] for r in got)


def test_chat(spark):
    t = lambda *x: [{"role": r, "text": s} for r, s in x]
    rows = [(1, t(("user", "hi"), ("assistant", "a")), t(("user", "hi"), ("assistant", "b"))), (2, t(("user", "q")), t(("user", "q"))), (3, None, t(("user", "q"))), (4, t(("system", "s"), ("user", "q")), t(("user", "q")))]
    pairs = spark.createDataFrame(rows, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r["pair_id"]: r for r in chat.format_pairs(pairs).collect()}
    assert got[1]["prompt"] == "<|user|>\nhi<|end|>\n" and got[1]["chosen_completion"] == "<|assistant|>\na<|end|>\n"
    span = got[1]["chosen_mask"][0]
    assert got[1]["chosen_completion"][span["start"] : span["end"]] == "a<|end|>\n"
    assert (got[2]["prompt_turns"], got[2]["chosen_completion"], got[2]["rejected_completion"]) == (1, "", "")
    assert got[3]["prompt_turns"] == 0 and got[3]["chosen_completion"] == "" and got[4]["prompt_turns"] == 0
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (None, 0, "user", "y"), (2, None, None, "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.format_pairs(chat.neighbour_pairs(turns)).count() == 1
    assert chat.format_pairs(chat.neighbour_pairs(turns.limit(0))).count() == 0


def accuracy(spark, name, label):
    scored = QUERIES[name](spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out")
    right = scored.where(F.col("predicted") == F.col(label)).count()
    return right / scored.count()


def test_held_out_accuracy(spark):
    assert accuracy(spark, "op6_quality", "quality") > 0.95
    assert accuracy(spark, "op2_toxicity", "toxic") > 0.9


@pytest.mark.parametrize(("module", "modulus", "remainder"), [(quality, 5, 0), (toxicity, 4, 2)])
def test_classifiers(spark, awkward, labels, module, modulus, remainder):
    for known in (labels, labels.limit(0)):
        got = rows_of(module.score_documents(awkward, known))
        assert len(got) == len(awkward_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder) for r in got)
    assert module.score_documents(awkward.limit(0), labels).count() == 0


def test_isotonic():
    x, y = np.array([1, 2, 2, 3, 4, 5.0]), np.array([0, 1, 0, 0, 1, 1])
    knots, values = quality.isotonic(x, y)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all()


def test_restore(spark):
    plain = " ".join("the idiot was stupid and the loser is pathetic trash".split() * 50)
    model = toxicity.character_model(spark.createDataFrame([(plain,)], "text string"))
    for said, meant in (("an 1d10t is", "idiot"), ("so stuuuupid", "stupid"), ("l o s e r talk", "loser"), ("p@thetic", "pathetic"), ("tr4sh!", "trash"), ("st" + "u" * 500 + "pid", "stupid"), ("plain," * 8 + "1d10t", "plain idiot"), ("plain," * 20 + "1d10t", "plain idiot"), ("plain," * 4000 + "1d10t", "plain idiot"), ("id€ot", "ideot"), ("ѕtuріd", "stupid"), ("ІDІОT х", "idiot"), ("l0ѕer", "loser"), (" ".join("loser" * 40), "loserloser")):
        assert meant in toxicity.restore(said, model)
    for same_ in ("the loser is", "what%%% ever&&& 2024", "", "see http://a.b/c", "это и в с у него", "το νερό"):
        assert toxicity.restore(same_, model) == same_
    assert toxicity.restore(None, model) == ""


def test_restore_mixed_disguises(spark):
    plain = " ".join("the idiot was stupid and a loser is a pathetic address trash".split() * 50)
    model = toxicity.character_model(spark.createDataFrame([(plain,)], "text string"))
    pure = [("so i d i o t", "idiot"), ("l-o-s-e-r", "loser")]
    mixed = [("i d 1 0 t", "idiot"), ("l 0 s e r", "loser"), ("s t u p 1 d", "stupid"), ("l  o  s  e  r", "loser"), ("l,o,s,e,r", "loser"), ("l/o/s/e/r", "loser"), ("l.o-s.e-r", "loser")]
    mixed += [("iiddiioott", "idiot"), ("stuupiid", "stupid"), ("a l o s e r", "loser"), ("i d i o t  l o s e r", "loser")]
    for said, meant in pure + mixed:
        assert meant in toxicity.restore(f"so {said} there", model).split(), said
    assert "address" in toxicity.restore("the address", model).split()
    for same_ in ("1 2 3 4", "see http://a.b/c", "x 12 y 13 z"):
        assert toxicity.restore(same_, model) == same_


@pytest.mark.parametrize("empty", [True, False])
def test_stages(spark, awkward, labels, tmp_path, empty):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(4, 44))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = awkward.limit(0) if empty else awkward
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == awkward.columns
            assert out.count() <= docs.count()
    assert len(corpus_pipeline.STAGES) == 5


def test_other_operators_on_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (setsketch.NearDuplicates(none).classes(), lm.score_documents(none), decontaminate.summary(none, bench), packing.pack_documents(none), licenses.scan_licenses(none)):
        assert out.count() == 0


def test_no_shuffle_files_pile_up(spark):
    """What written tables and components shuffled on their way is gone when they are there."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    there = lambda: {x for x in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before, mode = there(), spark.conf.get(common._FILE_CLEANUP)
    common.materialise(connected_components(spark.createDataFrame([(1, 2), (3, 2), (5, 4)], "a long, b long")), "components")
    until = time.time() + 20
    while (left := there() - before) and time.time() < until:  # files are deleted in the background
        time.sleep(0.2)
    assert not left and spark.conf.get(common._FILE_CLEANUP) == mode
