"""Benchmark decontamination by a prefix-filtered join of word windows (operator 9).

A benchmark item gives windows of ten consecutive words. Containment must be exact, so
one necessary token decides: each window's prefix is its word that is rarest in the whole
corpus. Benchmark and documents meet in joins, so neither is ever held in one place:

1. windows  items become distinct windows, told by two 64-bit prints of their words;
2. rarity   the corpus counts of the windows' words, aggregated per batch; each window's
            rarest word, the first one of several, is its anchor;
3. scan     a document position is a candidate if its word may be an anchor, and a window
            of the anchor's place and length starts and ends inside the document
            (positional and length bounds). Words, places and lengths are tested on a bit
            sieve, whose size is bounded whatever the benchmark; it only spares shuffling;
4. join     candidates meet windows on the anchor and print, and are verified by the
            second print of all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import free_name, materialise
from .textscan import ALNUM, Scan, chunks, mix

WINDOW = 10
#: Bits of a sieve: 16 a key, between these powers of two (16 MB at most).
LEAST_BITS, MOST_BITS = 16, 27
_PAGE = 16
_FACTORS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _prints(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row of words; the length counts too."""
    out = []
    for factor in _FACTORS:
        total = np.full(len(words), words.shape[1], np.uint64)
        for k in range(words.shape[1]):
            total = total * np.uint64(factor) + words[:, k]
        out.append(mix(total).view(np.int64))
    return out[0], out[1]


def _window_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i, j in chunks(batch["text"]):
            scan = Scan(batch["text"].iloc[i:j].tolist(), ALNUM)
            for k, item in enumerate(batch["item"].iloc[i:j]):
                words = scan.hashes[scan.offsets[k] : scan.offsets[k + 1]]
                if len(words):
                    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(words, min(WINDOW, len(words))))
                    one, two = _prints(rows)
                    yield pd.DataFrame({"item": item, "print": one, "check": two, "words": list(rows.view(np.int64))})


class Sieve:
    """Bits of hashed keys: a key that was put in is always found, others seldom."""

    def __init__(self, bits: int, pages: dict[int, bytes]):
        self.shift = np.uint64(64 - bits)
        self.bytes = np.zeros(max(1 << bits, 1 << _PAGE) >> 3, np.uint8)
        for page, data in pages.items():
            self.bytes[page << (_PAGE - 3) : (page + 1) << (_PAGE - 3)] = np.frombuffer(data, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys >> self.shift
        return (self.bytes[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0

    @classmethod
    def build(cls, keys: DataFrame) -> Sieve:
        """From a column ``key`` of 64-bit hashes. Executors make pages of bits; those
        together are at most 2**MOST_BITS bits, which is what the driver gets."""
        bits = min(MOST_BITS, max(LEAST_BITS, (16 * keys.count()).bit_length()))
        slots = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("slot")).distinct()

        def page(_: tuple, group: pd.DataFrame) -> pd.DataFrame:
            number, marks = int(group["slot"].iloc[0]) >> _PAGE, np.zeros(1 << _PAGE, bool)
            marks[group["slot"].to_numpy(np.int64) & ((1 << _PAGE) - 1)] = True
            return pd.DataFrame({"page": [number], "bits": [np.packbits(marks, bitorder="little").tobytes()]})

        pages = slots.groupBy(F.shiftright("slot", _PAGE)).applyInPandas(page, "page long, bits binary").collect()
        return cls(bits, {r["page"]: bytes(r["bits"]) for r in pages})


def _placed(word: np.ndarray, place: np.ndarray | int, length: np.ndarray | int) -> np.ndarray:
    """The sieve key of an anchor word with its place in a window of some length."""
    spot = np.asarray(place, np.uint64) * np.uint64(16) + np.asarray(length, np.uint64) + np.uint64(1)
    return mix(word ^ (spot * np.uint64(0x9E3779B97F4A7C15)))


def _count_batches(sieve):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, j in chunks(batch["text"]):
                found = Scan(batch["text"].iloc[i:j].tolist(), ALNUM).hashes
                word, n = np.unique(found[sieve.value.has(found)], return_counts=True)
                yield pd.DataFrame({"word": word.view(np.int64), "n": n})

    return count


def _key_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        word = batch["anchor"].to_numpy(np.int64).view(np.uint64)
        keys = np.concatenate((word, _placed(word, batch["place"].to_numpy(np.int64), batch["length"].to_numpy(np.int64))))
        yield pd.DataFrame({"key": keys.view(np.int64)})


def _candidates(scan: Scan, sieve: Sieve, lengths: list[int]) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Starts (in the scan), length and anchors of windows that may occur."""
    at = np.flatnonzero(sieve.has(scan.hashes))
    low, high = scan.offsets[scan.doc[at]], scan.offsets[scan.doc[at] + 1]
    for length in lengths:
        for place in range(length):
            start = at - place
            may = (start >= low) & (start + length <= high)
            may[may] = sieve.has(_placed(scan.hashes[at[may]], place, length))
            if may.any():
                yield start[may], length, scan.hashes[at[may]]


_CANDIDATE = "start int, length int, anchor long, print long, check long"


def _scan_batches(sieve, lengths: list[int], name: str):
    def scan_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, j in chunks(batch["text"]):
                scan = Scan(batch["text"].iloc[i:j].tolist(), ALNUM)
                found: list[list[tuple]] = [[] for _ in range(j - i)]
                for start, length, anchor in _candidates(scan, sieve.value, lengths):
                    for lot in np.array_split(np.arange(len(start)), len(start) // 100_000 + 1):
                        one, two = _prints(scan.hashes[start[lot][:, None] + np.arange(length)])
                        doc = scan.doc[start[lot]]
                        values = (start[lot] - scan.offsets[doc], anchor[lot].view(np.int64), one, two)
                        for d, s, a, p, q in zip(doc.tolist(), *(v.tolist() for v in values), strict=True):
                            found[d].append((s, length, a, p, q))
                yield pd.DataFrame({"row": np.arange(row, row + j - i), name: batch[name].iloc[i:j], "n_words": np.diff(scan.offsets), "found": found})
                row += j - i

    return scan_texts


def _scanned(docs: DataFrame, benchmark: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``docs`` (a text column ``name``, and text) with their candidates, as a
    table (row, ``name``, n_words, found); the windows with their anchors (print, check,
    anchor); and the windows of the items (item, print, check)."""
    spark, text = docs.sparkSession, F.col("text").cast("string").alias("text")
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), text)
    windows = materialise(items.mapInPandas(_window_batches, "item string, print long, check long, words array<long>"), "windows")
    once = windows.groupBy("print", "check").agg(F.first("words").alias("words"))
    placed = once.select("print", "check", F.size("words").alias("length"), F.posexplode("words").alias("place", "word"))
    wanted = Sieve.build(placed.select(F.col("word").alias("key")).distinct())
    counts = docs.select(text).mapInPandas(_count_batches(spark.sparkContext.broadcast(wanted)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "word")).alias("rarest")
    anchored = placed.join(counts, "word", "left").groupBy("print", "check", "length").agg(rarest)
    anchored = materialise(anchored.select("print", "check", "length", F.col("rarest.word").alias("anchor"), F.col("rarest.place").alias("place")), "anchors")
    lengths = sorted(r["length"] for r in anchored.select("length").distinct().collect())  # ten at most
    keys = anchored.select("anchor", "place", "length").distinct().mapInPandas(_key_batches, "key long").distinct()
    sieve = spark.sparkContext.broadcast(Sieve.build(keys))
    schema = f"row long, `{name}` string, n_words long, found array<struct<{', '.join(c.replace(' ', ':') for c in _CANDIDATE.split(', '))}>>"
    scanned = materialise(docs.select(F.col(f"`{name}`"), text).mapInPandas(_scan_batches(sieve, lengths, name), schema), "scanned")
    return scanned, anchored, windows


def _hits(scanned: DataFrame, anchored: DataFrame, name: str) -> DataFrame:
    """Candidates that are windows: row, ``name``, start, length, print and check."""
    found = scanned.where(F.size("found") > 0).select("row", name, F.explode("found").alias("f")).select("row", name, "f.*")
    return found.join(anchored.select("anchor", "print", "check"), ["anchor", "print", "check"])


def _covered(spans: Column) -> Column:
    """Size of the union of intervals (start, length)."""

    def step(state: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        more = F.greatest(end - F.greatest(x["start"], state["reach"]), F.lit(0))
        return F.struct((state["total"] + more).cast("long").alias("total"), F.greatest(state["reach"], end).alias("reach"))

    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("reach")), step, lambda s: s["total"])


def summary(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row.

    Null or wordless texts have no words and no hits; rows repeat as they come; items
    without id are ignored; equal items each count; an empty benchmark hits nothing.
    Columns besides doc_id and text are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("name"), "text")
    scanned, anchored, windows = _scanned(rows, benchmark, "name")
    hits = materialise(_hits(scanned, anchored, "name"), "hits")
    spans = hits.groupBy("row").agg(_covered(F.collect_set(F.struct("start", "length"))).alias("n_hit"))
    items = hits.select("row", "print", "check").distinct().join(windows.select("print", "check", "item").distinct(), ["print", "check"])
    items = items.select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    joined = scanned.select("row", "name", "n_words").join(spans.join(items, "row"), "row", "left")
    listed, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        F.col("name").cast("long").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns. Texts
    are told apart by a 128-bit digest; a null text has no words and stays."""
    mark = free_name(docs, "leak")
    key = F.md5(F.col("text").cast("string").cast("binary"))
    scanned, anchored, _ = _scanned(docs.select(key.alias("name"), "text"), benchmark, "name")
    leaks = _hits(scanned, anchored, "name").select(F.col("name").alias(mark)).distinct()
    return docs.join(leaks, key == F.col(mark), "left_anti")
