"""Best-fit packing of documents into sequences of several permitted lengths (operator 5).

Documents are cut into pieces of at most the largest length. Pieces are dealt by hash to
shards of bounded size; each shard packs its pieces, longest first, into the open bin
with the least room that still holds them. Where none fits, the length to open is chosen
among all that are permitted, by what is still to come: each is filled, on paper, with
the largest pieces left, downsized to the least length that holds its contents, and the
one of the least cost a token is opened. All bins are downsized at the end. A sweep that
prefers one and the same length throughout is tried too, for each length, and the
packing of the least cost stays.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORD, text_id

LENGTHS = (512, 1024, 2048, 4096, 8192)
SHARD = 20_000


def cost(length: int, quadratic: float = 1 / 16384) -> float:
    """Compute of one sequence: linear layers and attention."""
    return length * (1 + quadratic * length)


def _opener(sizes: list[int], lengths: tuple[int, ...]):
    """A function of a piece's size: the length to open for it, where all larger pieces
    are placed and smaller ones are still to come."""
    levels = sorted(set(sizes))
    many = Counter(sizes)

    @cache
    def choose(size: int, left: int) -> int:
        best = None
        for length in lengths[bisect_left(lengths, size) :]:
            room, at = length - size, bisect_left(levels, size)
            if left and room >= size:
                room -= size * min(left, room // size)
            while room and (at := bisect_right(levels, room, 0, at)):
                at -= 1
                room -= levels[at] * min(many[levels[at]], room // levels[at])
            held = length - room
            a_token = cost(lengths[bisect_left(lengths, held)]) / held
            if best is None or a_token < best[0]:
                best = (a_token, length)
        return best[1]

    return choose


def _trial(sizes: list[int], order: list[int], lengths: tuple[int, ...], opened) -> tuple[float, list[int], list[int], list[int]]:
    """Best fit in ``order``; ``opened`` gives the length of a new bin from the piece's
    size and how many pieces of that size come after it."""
    room: dict[int, list[int]] = {}
    rooms: list[int] = []
    used, bins, places, left_of = [], [0] * len(sizes), [0] * len(sizes), Counter(sizes)
    for k in order:
        size = sizes[k]
        left_of[size] -= 1
        at = bisect_left(rooms, size)
        if at < len(rooms):
            left = rooms[at]
            stack = room[left]
            bin_ = stack.pop()
            if not stack:
                del room[left]
                rooms.pop(at)
        else:
            left = opened(size, left_of[size])
            bin_ = len(used)
            used.append(0)
        bins[k], places[k] = bin_, used[bin_]
        used[bin_] += size
        if left > size:
            if left - size not in room:
                room[left - size] = []
                insort(rooms, left - size)
            room[left - size].append(bin_)
    final = [lengths[bisect_left(lengths, u)] for u in used]
    return sum(map(cost, final)), bins, places, final


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """Bin number and place of each piece (in the given order), and each bin's final
    length. Sizes are between 1 and the largest length."""
    lengths = tuple(sorted(lengths))
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    ways = [_opener(sizes, lengths)]
    ways += [lambda size, _, p=p: p if size <= p else lengths[bisect_left(lengths, size)] for p in lengths]
    return min((_trial(sizes, order, lengths, w) for w in ways), key=lambda t: t[0])[1:]


def token_count(text: Column) -> Column:
    """Words and one end token; null and empty texts have the end token alone."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long") + 1


def _pack_shard(lengths: tuple[int, ...]):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "tie", "copy"], kind="stable", na_position="first").reset_index(drop=True)
        bins, places, final = best_fit(group["size"].tolist(), lengths)
        group["bin_id"] = [f"{int(key[0]):08d}-{b:06d}" for b in bins]
        group["bin_length"] = [final[b] for b in bins]
        group["place"] = places
        return group[["doc_id", "piece", "start", "size", "bin_id", "bin_length", "place"]]

    return run


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """A row per piece: doc_id, piece (number in the document), start (token), size,
    bin_id, bin_length and place (first token in the bin).

    Rows that repeat are packed each; a null doc_id is packed like any other; columns
    besides doc_id and text are ignored. An empty table gives no rows. A shard has at most
    about ``SHARD`` pieces, whatever the skew and the lengths of texts: pieces are dealt by
    id, text, number and, where rows repeat, the number of the copy.
    """
    largest = max(lengths)
    tokens = docs.select(text_id("doc_id"), F.xxhash64("text").alias("tie"), token_count(F.col("text").cast("string")).alias("n"))
    counted = tokens.groupBy("doc_id", "tie", "n").agg(F.count("*").alias("copies"))
    copied = counted.select("doc_id", "tie", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    pieces = copied.select("doc_id", "tie", "n", "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / largest).cast("long"))).alias("piece"))
    pieces = pieces.select("doc_id", "tie", "copy", "piece", (F.col("piece") * largest).alias("start"), F.least(F.lit(largest).cast("long"), F.col("n") - F.col("piece") * largest).alias("size"))
    size = docs.agg(F.count("*").alias("docs"), F.sum(F.length(F.col("text").cast("string"))).alias("chars")).first()
    most = size["docs"] + (size["chars"] or 0) // (2 * largest)  # a word takes two characters, so there are no more pieces
    shards = max(1, -(-most // SHARD))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "tie", "copy"), F.lit(shards)).cast("int"))
    packed = dealt.groupBy("shard").applyInPandas(_pack_shard(tuple(lengths)), "doc_id string, piece long, start long, size long, bin_id string, bin_length long, place long")
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))
