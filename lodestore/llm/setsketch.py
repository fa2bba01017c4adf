"""Near-duplicate classes by SetSketch registers (operator 8).

A document's set is its distinct word shingles. A SetSketch has ``REGISTERS``
registers; each holds the exponentially spaced level of the smallest point that any
element throws into it. An element throws points as a Poisson process in ascending
order, truncated where all registers of the document are filled, so that a long
document costs little more than one pass over its shingles. Equal sets have equal
registers, registers merge by maximum, and two registers are equal with a
probability close to the Jaccard similarity.

1. Texts with equal sets (128-bit digest of the sorted shingles) form a class, a node.
2. Nodes that agree on a band of four registers share a bucket.
3. The first round pairs each member with its bucket's smallest node. Pairs whose sizes
   can't be similar enough are left out, the others confirmed on the full sets; confirmed
   links give components.
4. The second round looks into buckets that still hold several components. A bucket's
   members are dealt into lots by size (a ratio of 4/3 a bin, so that a partner is in the
   same or the next bin) and by whether they belong to the bucket's largest component,
   whose members needn't meet each other. Lots of up to 512 members meet in pairs of lots,
   each a row group of its own. There pairs of different components get a joint likelihood
   estimate from their sketches, and each node's likeliest partner is confirmed.
5. The third round does the same once more with the components that are left. All pairs
   whose estimate isn't hopeless are confirmed, and as there may be very many of them, they
   are where they were found: members with such a partner bring their texts to the pair of
   lots, and links alone leave it. Pairs within a component can't change the result; all
   others that could link are tested.

Full sets are confirmed from texts: compressed, they take half the room of hashed sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORD, discard, free_name, materialise, text_id, written
from .components import connected_components
from .textscan import SPACE, Scan, chunks, fold, mix, runs_start

REGISTERS, ROWS, BANDS = 384, 4, 48
BASE, RATE, TOP = 1.001, 20.0, 65535
SHINGLE = 5
#: A pair whose estimate is below the threshold by more than this many standard
#: errors isn't confirmed; a true pair at the threshold itself is lost with a chance of 1e-6.
ERRORS = 5.0
#: Members of a lot of an open bucket, and shingles of all its members, about.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; a text of fewer words
    has its whole sequence as the only one, a text without words has none."""
    scan = Scan(texts, SPACE)
    folded = fold(scan.hashes, width)
    inside = runs_start(scan.offsets, width)
    owner = scan.doc[inside] if len(inside) else inside
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    folded = folded[inside] if len(inside) else folded[:0]
    sets = []
    for i in range(len(texts)):
        n = scan.offsets[i + 1] - scan.offsets[i]
        if n >= width:
            sets.append(np.unique(folded[cuts[i] : cuts[i + 1]]))
        elif n:
            sets.append(fold(scan.hashes[scan.offsets[i] : scan.offsets[i + 1]], int(n), 0x2545F4914F6CDD1D))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def _throw(elements: np.ndarray, owner: np.ndarray, limit: np.ndarray, lowest: np.ndarray) -> None:
    """Lower ``lowest`` (documents x registers, flat) to the points of the elements up
    to their documents' limits. Points come in blocks, longer as fewer elements go on."""
    at, number = np.zeros(len(elements)), 0
    while len(elements):
        block = int(min(4096, max(1, 40_000 // len(elements))))
        steps = (np.arange(number + 1, number + block + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        drawn = mix(elements[:, None] + steps[None, :])
        gap = -np.log1p(-((drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / REGISTERS
        gap[:, 0] += at
        point = np.cumsum(gap, axis=1) if block > 1 else gap
        register = (drawn & np.uint64(0x7FF)) * np.uint64(REGISTERS) >> np.uint64(11)
        keep = point <= limit[owner][:, None]
        cell = (owner * REGISTERS)[:, None] + register.astype(np.int64)
        np.minimum.at(lowest, cell[keep], point[keep])
        on = keep[:, -1]
        elements, owner, at, number = elements[on], owner[on], point[on, -1], number + block


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (uint16) of each set; an empty set has zeros."""
    sizes = np.array([len(s) for s in sets], np.int64)
    lowest = np.full((len(sets), REGISTERS), np.inf)
    todo, reach = np.flatnonzero(sizes), 14.0
    while len(todo):
        elements = np.concatenate([sets[i] for i in todo])
        owner = np.repeat(np.arange(len(todo)), sizes[todo])
        part = np.full(len(todo) * REGISTERS, np.inf)
        _throw(elements, owner, reach / sizes[todo], part)
        lowest[todo] = part.reshape(len(todo), REGISTERS)
        todo, reach = todo[np.isinf(lowest[todo]).any(axis=1)], reach * 2
    out = np.zeros(lowest.shape, np.uint16)
    some = sizes > 0
    out[some] = np.clip(np.floor(1 - np.log(lowest[some] / RATE) / np.log(BASE)), 0, TOP).astype(np.uint16)
    return out


def bands(registers: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket key for each of the first BANDS runs of ``rows`` registers."""
    n = BANDS
    wide = np.zeros((len(registers), n), np.uint64)
    for k in range(rows):
        wide = mix(wide * np.uint64(3) + registers[:, k : n * rows : rows].astype(np.uint64) + np.uint64(1))
    return mix(wide + np.arange(1, n + 1, dtype=np.uint64)[None, :]).view(np.int64)


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from two sketches each and the sizes."""
    up = (left > right).sum(axis=1)
    down = (left < right).sum(axis=1)
    same = left.shape[1] - up - down
    u = n_left / (n_left + n_right)
    v = 1 - u

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        more, less = chance(u - v * j), chance(v - u * j)
        tiny = 1e-12
        return up * np.log(more + tiny) + down * np.log(less + tiny) + same * np.log(np.maximum(1 - more - less, tiny))

    low, high, golden = np.zeros(len(left)), np.minimum(u / v, v / u), (5**0.5 - 1) / 2
    for _ in range(40):
        one, two = high - golden * (high - low), low + golden * (high - low)
        rising = likelihood(one) < likelihood(two)
        low, high = np.where(rising, one, low), np.where(rising, high, two)
    return (low + high) / 2


def _sketch_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i, j in chunks(batch["text"]):
            part = batch.iloc[i:j]
            sets = shingle_sets(part["text"].tolist())
            registers = sketches(sets)
            yield pd.DataFrame({
                **{c: part[c] for c in part.columns if c != "text"},
                "n_shingles": [len(s) for s in sets],
                "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "sketch": [r.tobytes() if len(s) else None for r, s in zip(registers, sets, strict=True)],
            })


def _band_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            registers = np.frombuffer(b"".join(batch["sketch"]), np.uint16).reshape(len(batch), REGISTERS)
            yield pd.DataFrame({"node": batch["node"], "bands": list(bands(registers))})


def _crossing(threshold: float, likeliest: bool):
    """Hopeful pairs of different components in pairs of lots; rows come sorted by bucket
    and lots. A pair that shares several bands is told by the first of them alone. With
    ``likeliest`` a node tells one partner a pair of lots, and the similarity; else every
    member with a hopeful pair is told, with the partners that others don't tell."""
    floor, parts = threshold - ERRORS * (threshold * (1 - threshold) / REGISTERS) ** 0.5, round(threshold * 100)

    def pairs_of(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        registers = np.frombuffer(b"".join(rows["sketch"]), np.uint16).reshape(len(rows), REGISTERS)
        band, low, high, lot_of, node, home, size = (rows[c].to_numpy(np.int64) for c in ("band", "low", "high", "lot", "node", "component", "n_shingles"))
        own = bands(registers)
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(band) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0))))
        ends = np.repeat(np.append(starts[1:], len(rows)), np.diff(np.append(starts, len(rows))))
        partners = ends - np.arange(len(rows)) - 1
        best, partner = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
        lefts, rights = [], []
        for lot in np.split(np.arange(len(rows)), np.searchsorted(np.cumsum(partners), np.arange(50_000, partners.sum() + 1, 50_000))):
            i = np.repeat(lot, partners[lot])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(partners[lot]) - partners[lot], partners[lot])
            ok = (home[i] != home[j]) & ((low[i] == high[i]) | (lot_of[i] != lot_of[j]))
            ok &= 100 * np.minimum(size[i], size[j]) >= parts * np.maximum(size[i], size[j])
            i, j = i[ok], j[ok]
            told = own[i, (own[i] == own[j]).argmax(axis=1)] == band[i]
            i, j = i[told], j[told]
            # The share of equal registers is at most a little above the similarity.
            near = np.count_nonzero(registers[i] == registers[j], axis=1) >= (floor - 0.02) * REGISTERS
            i, j = i[near], j[near]
            if not len(i):
                continue
            like = estimate(registers[i], registers[j], size[i].astype(float), size[j].astype(float))
            i, j, like = i[like >= floor], j[like >= floor], like[like >= floor]
            if not len(i):
                continue
            if not likeliest:
                lefts.append(i)
                rights.append(j)
                continue
            for one, other in ((i, j), (j, i)):
                rising = np.argsort(like, kind="stable")  # the last of several assignments stays
                one, other, value = one[rising], other[rising], like[rising]
                better = value > best[one]
                best[one[better]], partner[one[better]] = value[better], node[other[better]]
        told = np.flatnonzero(best)
        if len(told):
            yield pd.DataFrame({"node": node[told], "partner": partner[told], "likeness": best[told]})
        if lefts:
            i, j = np.concatenate(lefts), np.concatenate(rights)
            i, j = i[np.argsort(i, kind="stable")], j[np.argsort(i, kind="stable")]
            at = np.union1d(i, j)
            partners = np.split(node[j], np.searchsorted(i, at))[1:]  # none are before the first
            yield pd.DataFrame({"band": band[at], "low": low[at], "high": high[at], "node": node[at], "partners": partners})

    return _by_lots(pairs_of)


def _by_lots(work):
    """Hands whole pairs of lots to ``work``; rows come sorted by them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for batch in batches:
            rows = batch if left is None else pd.concat([left, batch], ignore_index=True)
            keys = rows[["band", "low", "high"]].to_numpy()
            open_ = len(rows) if not len(rows) else int(np.flatnonzero((keys == keys[-1]).all(axis=1))[0])
            if open_:
                yield from work(rows.iloc[:open_])
            left = rows.iloc[open_:]
        if left is not None and len(left):
            yield from work(left)

    return run


def _similar(a: np.ndarray, b: np.ndarray, parts: int) -> bool:
    """Whether two sets have a similarity of ``parts`` in a hundred."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(both) and 100 * both >= parts * (len(a) + len(b) - both)


def _links_of_lots(threshold: float):
    """Confirmed links among the members of a pair of lots."""
    parts = round(threshold * 100)

    def links(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, group in rows.groupby(["band", "low", "high"], sort=False):
            texts, nodes, sets, found = group["text"].tolist(), group["node"].tolist(), [], []
            for i, j in chunks(texts):
                sets += shingle_sets(texts[i:j])
            of = dict(zip(nodes, sets, strict=True))
            for a, others in zip(nodes, group["partners"], strict=True):
                found += [(min(a, b), max(a, b)) for b in others.tolist() if _similar(of[a], of[b], parts)]
            if found:
                yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return _by_lots(links)


def _confirmed(threshold: float):
    parts = round(threshold * 100)

    @F.pandas_udf("boolean")
    def confirmed(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last, set_a = [], None, np.empty(0, np.uint64)
        for x, y in zip(a, b, strict=True):
            if last is None or x != last:
                last, set_a = x, shingle_sets([x])[0]
            out.append(_similar(set_a, shingle_sets([y])[0], parts))
        return pd.Series(out, dtype=bool)

    return confirmed


class NearDuplicates:
    """Near-duplicate classes of ``docs`` (columns doc_id, text; others are ignored, but
    for those named in ``carry``, text columns that ``placed`` gives again)."""

    def __init__(self, docs: DataFrame, threshold: float = 0.75, carry: tuple[str, ...] = ()):
        if threshold < 0.75:
            raise ValueError("bands and error bounds hold for a similarity of 0.75 or more")
        text = F.col("text").cast("string")
        # Rows of one id and text have one key, by which a node's text is found again.
        key = F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(text.cast("binary")))
        self.docs = docs.select(text_id("doc_id"), key.alias("row_key"), *(F.col(f"`{c}`") for c in carry), text.alias("text"))
        self.threshold, self.carry = threshold, carry

    def _verify(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) whose full sets are similar enough."""
        text = lambda x: texts.select(F.col("node").alias(f"id_{x}"), F.col("text").alias(f"text_{x}"))
        return (
            pairs.join(text("a"), F.col("a") == F.col("id_a"))
            .join(text("b"), F.col("b") == F.col("id_b"))
            .where(_confirmed(self.threshold)("text_a", "text_b"))
            .select("a", "b")
            .distinct()
        )

    def _alike(self, pairs: DataFrame, sizes: DataFrame) -> DataFrame:
        """Those of ``pairs`` whose sizes allow a similarity of the threshold."""
        side = lambda x: sizes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * round(self.threshold * 100)).select("a", "b")

    def _lots(self, open_: DataFrame, nodes: DataFrame) -> DataFrame:
        """Rows (band, low, high, lot, node, component, n_shingles, sketch): each member of
        an open bucket in every pair of lots where it may have a partner. A lot is told by
        size bin, whether its members are of the bucket's largest component, and number."""
        sizes = open_.groupBy("band", "component").agg(F.count("*").alias("n"))
        main = sizes.groupBy("band").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
        bin_ = F.floor(F.log("n_shingles") / F.log(F.lit(1 / self.threshold)) + F.lit(1e-9)).cast("int")
        placed = open_.join(main, "band").withColumn("kind", bin_ * 2 + (F.col("component") == F.col("main")).cast("int"))
        counts = placed.groupBy("band", "kind").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("lots"))
        known = counts.groupBy("band").agg(F.collect_list(F.struct("kind", "lots")).alias("known"))  # two kinds a size bin: a few dozen
        placed = placed.join(known, "band")

        def partners(k: Column) -> Column:
            near = F.abs(F.floor(k["kind"] / 2) - F.floor(F.col("kind") / 2)) <= 1
            return near & ((k["kind"] % 2 == 0) | (F.col("kind") % 2 == 0))

        code = lambda kind, number: kind.cast("long") * F.lit(1 << 40) + number
        many = F.filter("known", lambda k: k["kind"] == F.col("kind"))[0]["lots"]
        own = code(F.col("kind"), F.pmod(F.xxhash64("node"), many))
        others = F.flatten(F.transform(F.filter("known", partners), lambda k: F.transform(F.sequence(F.lit(0), k["lots"] - 1), lambda n: code(k["kind"], n))))
        dealt = placed.select("band", "node", "component", own.alias("lot"), F.explode(others).alias("other"))
        dealt = dealt.select("band", F.least("lot", "other").alias("low"), F.greatest("lot", "other").alias("high"), "lot", "node", "component")
        return dealt.join(nodes.select("node", "sketch", "n_shingles"), "node")

    def placed(self, unnamed: bool) -> tuple[DataFrame, DataFrame]:
        """Two tables: the rows that have shingles (doc_id, ``carry``, n_shingles,
        component and least_id, the component's smallest doc_id), and those that haven't
        (doc_id, ``carry``, n_shingles).

        A component is the smallest node of linked texts. Without ``unnamed``, rows that
        lack a doc_id are of the second table, and texts of one doc_id are linked.
        """
        kept = ", ".join(f"`{c}` string" for c in ("doc_id", "row_key", *self.carry))
        read = self.docs.mapInPandas(_sketch_batches, f"{kept}, n_shingles long, set_key binary, sketch binary")
        sketched = materialise(read.withColumn("doc_id", F.col("doc_id").cast("long")), "sketches")
        since = written()
        usable = F.col("set_key").isNotNull() if unnamed else F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()
        real = sketched.where(usable)
        named = real.groupBy("set_key").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.min("row_key").alias("row_key"), F.min("doc_id").alias("doc_id"))
        # The number is fixed once the table is written.
        nodes = materialise(named.withColumn("node", F.monotonically_increasing_id()), "nodes")
        keys = nodes.select("set_key", "node")

        banded = nodes.select("node", "sketch").mapInPandas(_band_batches, "node long, bands array<long>").select("node", F.explode("bands").alias("band"))
        firsts = banded.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("band", "first")
        members = materialise(banded.join(firsts, "band"), "members")
        sizes = nodes.select("node", "n_shingles")
        tried = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
        tried = materialise(self._alike(tried, sizes), "tried")
        # At scale this is a shuffle of all texts; it is asked for at every size.
        wanted = members.select("node").distinct().join(nodes.select("node", "row_key"), "node").hint("merge")
        once = self.docs.groupBy("row_key").agg(F.first("text").alias("text"))
        texts = materialise(once.join(wanted, "row_key").select("node", "text"), "texts")
        links = self._verify(tried, texts)
        links = materialise(links if unnamed else links.union(_same_id(real, keys)), "links")
        labels = materialise(connected_components(links), "labels")
        for look in (self._likeliest, self._remaining):
            more = materialise(look(self._dealt(members, labels, nodes), tried, texts), "more")
            if not more.isEmpty():
                links = links.union(more)
                labels = materialise(connected_components(links), "labels")
        homes = nodes.select("set_key", "node", "doc_id").join(labels, "node", "left").select("set_key", "doc_id", F.coalesce("component", "node").alias("component"))
        homes = materialise(homes, "homes")
        discard(sketched.sparkSession, since, keep=1)
        columns = ["doc_id", *(f"`{c}`" for c in self.carry), "n_shingles"]
        least = homes.groupBy("component").agg(F.min("doc_id").alias("least_id"))
        homes = homes.drop("doc_id").join(least, "component")
        return real.join(homes, "set_key").select(*columns, "component", "least_id"), sketched.where(~usable).select(*columns)

    def _dealt(self, members: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
        """The members of buckets with several components, by pairs of lots."""
        placed = members.join(labels, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
        several = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band")
        open_ = materialise(placed.join(several, "band").join(nodes.select("node", "n_shingles"), "node"), "open")
        return _sorted_by_lots(self._lots(open_, nodes))

    def _likeliest(self, dealt: DataFrame, tried: DataFrame, texts: DataFrame) -> DataFrame:
        """Links of nodes with their likeliest partners, one for each node at most."""
        pairs = dealt.mapInPandas(_crossing(self.threshold, True), "node long, partner long, likeness double")
        best = pairs.groupBy("node").agg(F.max(F.struct("likeness", "partner"))["partner"].alias("partner"))
        best = best.select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b"))
        return self._verify(best.distinct().join(tried, ["a", "b"], "left_anti"), texts)

    def _remaining(self, dealt: DataFrame, _: DataFrame, texts: DataFrame) -> DataFrame:
        """Links of all pairs that aren't hopeless, confirmed in their lots."""
        told = dealt.mapInPandas(_crossing(self.threshold, False), "band long, low long, high long, node long, partners array<long>")
        return _sorted_by_lots(told.join(texts, "node")).mapInPandas(_links_of_lots(self.threshold), "a long, b long").distinct()

    def classes(self) -> DataFrame:
        """doc_id, n_shingles, component_id and kept of every row.

        A null or wordless text has no shingles and links with nothing. A row without
        doc_id can't be named: it links with nothing, has no component_id and is
        kept. Rows that repeat a doc_id are one document with several texts: all its
        rows share a component. No input rows, no output rows.
        """
        placed, alone = self.placed(unnamed=False)
        named = placed.select("doc_id", "n_shingles", F.col("least_id").alias("component_id"))
        alone = alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return named.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _sorted_by_lots(rows: DataFrame) -> DataFrame:
    return rows.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")


def _same_id(real: DataFrame, keys: DataFrame) -> DataFrame:
    """Links between the texts of one doc_id."""
    several = real.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x <> y").select("doc_id", "x")
    pairs = real.join(several, "doc_id").where("set_key <> x").select("x", "set_key").distinct()
    one, two = keys.select(F.col("set_key").alias("x"), F.col("node").alias("a")), keys.select("set_key", F.col("node").alias("b"))
    return pairs.join(one, "x").join(two, "set_key").select("a", "b")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicate texts, with the columns of ``docs``: that
    of the smallest doc_id (a null one is larger than any), then of the smallest digest of
    the whole row. Texts are grouped by likeness alone, so that unlike texts of one doc_id,
    or without doc_id, all stay, as do rows without words, even if they repeat."""
    row = free_name(docs, "row")
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    marked = docs.select(*columns, F.md5(F.to_json(F.struct(*columns))).alias(row))
    placed, _ = NearDuplicates(marked, carry=(row,)).placed(unnamed=True)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col(row)))[row]
    kept = placed.groupBy("component").agg(first.alias(row)).select(row).hint("merge")
    worded = F.coalesce(F.rlike(F.col("text").cast("string"), F.lit(SPACE_WORD)), F.lit(False))
    # Rows that are equal throughout are made one before rows are matched by digest, in the
    # same partitioning.
    once = marked.where(worded).dropDuplicates([row]).join(kept, row, "left_semi")
    return once.drop(row).union(docs.where(~worded))
