"""Language-model scores from an Elias-Fano n-gram trie, sharded over Spark (operator 3).

A trigram model that backs off to bigrams and then to add-one unigrams:

    P(w | u, v) = (1 - k(c(u, v))) * (c(u, v, w) - CUT) / c(u, v)   where (u, v, w) was seen,
                  k(c(u, v)) * P(w | v)                             else
    P(w | v)    = (1 - k(c(v))) * (c(v, w) - CUT) / c(v)            where (v, w) was seen,
                  k(c(v)) * (c(w) + 1) / (N + V + 1)                else
    k(c)        = min(CAP, CAP * c ** -FALL), and 1 where c = 0

c counts training tokens; a document is preceded by two start marks. The sum over w of
P(w | u, v) is at most 1. Neither vocabulary nor n-grams are ever held in one place:

1. blocks  documents form blocks of about ``BLOCK_WORDS`` words. A block sends each of its
           distinct words and n-grams once, with its count in the block, to the shard of
           the word or of the n-gram's first two words; so a word that is everywhere is
           sent once a block, and no shard depends on how frequent any key is;
2. shards  a shard adds up the counts and lays its n-grams out as a trie in one mapped
           file: first words, second words below them with quantised counts, third words
           below those with quantised log probabilities. Levels and the pointers between
           them are monotone and Elias-Fano coded, and searched as they are, within the
           range that the context's pointers give. Each block gets the codes of its keys;
3. blocks  a block's tokens meet the codes of its keys, and give its documents' scores.

In the trie the first word is told by 32 bits of its hash, the others by 24; the shard
tells the second word further. So n-grams are confused only if they share a shard and agree
in those bits wherever their words differ: of m words that follow one pair of words, about
m * m / 2**25 pairs (3 of 10 000), of m words that follow one word, that over the number of
shards. Word counts are by the whole 64 bits.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import materialise, text_id
from .labels import held_out
from .textscan import SPACE, Scan, mix, word_hash

CUT, CAP, FALL = 0.35, 0.9, 0.14
FOLDS, HELD = 7, 2
BLOCK_WORDS, BLOCK_DOCS, WORDS_PER_SHARD, LEAST_SHARDS = 800_000, 60_000, 2_000_000, 24
END, START = np.uint64(word_hash("end of text") ^ 0x5DEECE66D), np.uint64((1 << 64) - 1)
_ROW = "slot int, block long, kind string, data binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value: byte plane by byte plane, so that planes of zeros
    vanish; sorted 64-bit keys are told by their differences."""
    parts = []
    for a in arrays:
        sorted_ = a.dtype == np.uint64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        a = np.ascontiguousarray(np.diff(a, prepend=np.uint64(0)) if sorted_ else a)
        data = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        parts += [struct.pack("<2s?q", a.dtype.str[1:].encode(), sorted_, len(data)), data]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 0
    while at < len(data):
        kind, sorted_, size = struct.unpack_from("<2s?q", data, at)
        at += 11
        width = int(kind[1:])
        planes = np.frombuffer(data, np.uint8, size, at).reshape(width, size // width)
        a = np.ascontiguousarray(planes.T).view("<" + kind.decode()).ravel()
        out.append(np.cumsum(a) if sorted_ else a)
        at += size
    return out


_SAMPLE, _ALL = 64, np.uint64(0xFFFFFFFFFFFFFFFF)
#: Place of the r-th set bit of a byte.
_PLACES = np.zeros((256, 8), np.int64)
for _byte in range(256):
    _set = [k for k in range(8) if _byte >> k & 1]
    _PLACES[_byte, : len(_set)] = _set


def _words64(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, with a word to spare."""
    data = np.packbits(bits, bitorder="little")
    return np.concatenate((data, np.zeros(16 - len(data) % 8, np.uint8))).view(np.uint64)


def _select(words: np.ndarray, samples: np.ndarray, which: np.ndarray, flip: np.uint64) -> np.ndarray:
    """Positions of set bits by their numbers (of clear bits with ``flip`` all ones);
    ``samples`` has the position of each 64th."""
    at = samples[which // _SAMPLE].astype(np.int64)
    left, first = which % _SAMPLE, (at & 63).astype(np.uint64)
    at >>= 6
    word = (words[at] ^ flip) & (_ALL << first)
    count = np.bitwise_count(word).astype(np.int64)
    more = np.flatnonzero(left >= count)
    while len(more):
        left[more] -= count[more]
        at[more] += 1
        word[more] = words[at[more]] ^ flip
        count[more] = np.bitwise_count(word[more])
        more = more[left[more] >= count[more]]
    at <<= 6
    for width in (32, 16, 8):
        low = word & np.uint64((1 << width) - 1)
        count = np.bitwise_count(low).astype(np.int64)
        up = left >= count
        word = np.where(up, word >> np.uint64(width), low)
        left -= np.where(up, count, 0)
        at += np.where(up, width, 0)
    return at + _PLACES[(word & np.uint64(255)).astype(np.int64), left]


class EliasFano:
    """A non-decreasing sequence of integers below ``universe``, coded: each value's low
    bits packed, its high part as a unary bit vector with sampled positions."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.count, self.low_bits = count, low_bits
        self.low, self.high, self.ones, self.zeros = self.arrays = (low, high, ones, zeros)

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values, n = values.astype(np.uint64), len(values)
        bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        spread = np.unpackbits(values.view(np.uint8).reshape(n, 8), axis=1, count=bits, bitorder="little") if bits else np.zeros((n, 0), np.uint8)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(n + (int(universe) >> bits) + 1, np.uint8)
        unary[ones] = 1
        samples = [x[::_SAMPLE].astype(np.uint64) for x in (ones, np.flatnonzero(unary == 0))]
        return cls(n, bits, _words64(spread.ravel()), _words64(unary), *samples)

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        two = (self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return ((self.low[word] >> shift) | two) & np.uint64((1 << self.low_bits) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        """Values by their places."""
        high = _select(self.high, self.ones, at, np.uint64(0)) - at
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(at)

    def find(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each value within its range of places, -1 where it isn't there. The
        high part leads to the places that share it, their low parts are bisected."""
        high, sought = (values >> np.uint64(self.low_bits)).astype(np.int64), values & np.uint64((1 << self.low_bits) - 1)
        before = np.where(high > 0, _select(self.high, self.zeros, np.maximum(high - 1, 0), _ALL) - (high - 1), 0)
        low = np.maximum(begin, before)
        top = np.minimum(end, _select(self.high, self.zeros, high, _ALL) - high)
        stop = np.maximum(top, low)
        todo = np.flatnonzero(low < stop)
        while len(todo):
            middle = (low[todo] + stop[todo]) >> 1
            less = self._low(middle) < sought[todo]
            low[todo] = np.where(less, middle + 1, low[todo])
            stop[todo] = np.where(less, stop[todo], middle)
            todo = todo[low[todo] < stop[todo]]
        there = np.flatnonzero(low < top)
        out = np.full(len(values), -1, np.int64)
        same = there[self._low(low[there]) == sought[there]]
        out[same] = low[same]
        return out


def count_levels() -> np.ndarray:
    """What the codes of counts stand for: 0 to 32 exactly, then in steps of 8 % up to
    some 10**9, each code for the counts that are nearer to no smaller one."""
    levels = list(range(33))
    while len(levels) < 256:
        levels.append(max(levels[-1] + 1, round(levels[-1] * 1.082)))
    return np.array(levels, np.float64)


COUNTS = count_levels()


def count_codes(counts: np.ndarray) -> np.ndarray:
    return (np.searchsorted(COUNTS, counts, "right") - 1).astype(np.uint8)


def backoff(count: np.ndarray) -> np.ndarray:
    """k of context counts."""
    return np.where(count > 0, CAP * np.maximum(count, 1) ** -FALL, 1.0)


def seen_weight(count: np.ndarray) -> np.ndarray:
    """log10 of what a seen successor's discounted count is multiplied with."""
    return np.log10(1 - np.where(count > 0, backoff(count), 0)) - np.log10(np.maximum(count, 1))


#: Bits of the second and third words of a key.
BITS = np.uint64(24)
_LOW = np.uint64((1 << 24) - 1)


def word_shard(words: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of a word, by ranges of hashes, and where in its range it lies, as BITS."""
    spot = (words >> np.uint64(24)) * np.uint64(shards)
    return (spot >> np.uint64(40)).astype(np.int64), (spot >> np.uint64(16)) & _LOW


class Trie:
    """Three levels of words, in one mapped file. ``pairs`` are sorted distinct keys of 32
    bits of the first and BITS of the second word, with counts; the third words come per pair:
    ``home`` (place of the pair, ascending) and ``thirds`` (ascending within a pair)."""

    CODES = 255

    def __init__(self, pairs: np.ndarray, pair_counts: np.ndarray, home: np.ndarray, thirds: np.ndarray, counts: np.ndarray):
        first, start = np.unique(pairs >> BITS, return_index=True)
        above = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff([*start, len(pairs)]).astype(np.int64))
        begins = np.searchsorted(home, np.arange(len(pairs) + 1))
        value = np.log10(counts - CUT) + seen_weight(pair_counts[home])
        self.least, top = (float(value.min()), float(value.max())) if len(value) else (0.0, 0.0)
        self.step = (top - self.least) / (self.CODES - 1) or 1.0
        codes = np.round((value - self.least) / self.step).astype(np.uint8) + np.uint8(1)
        levels = [
            EliasFano.encode(first, 1 << 32), EliasFano.encode(np.append(start, len(pairs)), len(pairs) + 1),
            EliasFano.encode((above << BITS) | (pairs & _LOW), max(1, len(first)) << 24), EliasFano.encode(begins, len(home) + 1),
            EliasFano.encode((home.astype(np.uint64) << BITS) | thirds.astype(np.uint64), max(1, len(pairs)) << 24),
        ]
        self._map(levels, [count_codes(pair_counts), codes])

    def _map(self, levels: list[EliasFano], codes: list[np.ndarray]) -> None:
        """Lay all out in one unlinked temporary file, map it, and use the mapped parts."""
        parts = [np.ascontiguousarray(a) for level in levels for a in level.arrays] + codes
        with tempfile.TemporaryFile() as file:
            for a in parts:
                file.write(a.tobytes() + bytes(-a.nbytes % 8))
            file.write(bytes(8))
            file.flush()
            whole = np.memmap(file, np.uint8, "r")
        at, mapped = 0, []
        for a in parts:
            mapped.append(whole[at : at + a.nbytes].view(a.dtype).view(np.ndarray))
            at += a.nbytes + -a.nbytes % 8
        self.first, self.to_second, self.second, self.to_third, self.third = (EliasFano(e.count, e.low_bits, *mapped[4 * k : 4 * k + 4]) for k, e in enumerate(levels))
        self.pair_codes, self.codes = mapped[-2:]

    def places(self, pairs: np.ndarray) -> np.ndarray:
        """Places of pair keys, -1 for unseen ones."""
        out = np.full(len(pairs), -1, np.int64)
        if not self.second.count:
            return out
        begin, end = np.zeros(len(pairs), np.int64), np.full(len(pairs), self.first.count, np.int64)
        rank = self.first.find(pairs >> BITS, begin, end)
        known = np.flatnonzero(rank >= 0)
        rank = rank[known]
        begin, end = (self.to_second.get(rank + k).astype(np.int64) for k in (0, 1))
        out[known] = self.second.find((rank.astype(np.uint64) << BITS) | (pairs[known] & _LOW), begin, end)
        return out

    def successors(self, home: np.ndarray, thirds: np.ndarray) -> np.ndarray:
        """Codes of third words below pairs by place; 0 for unseen ones."""
        out = np.zeros(len(home), np.uint8)
        known = np.flatnonzero(home >= 0)
        if self.third.count and len(known):
            rank = home[known]
            begin, end = (self.to_third.get(rank + k).astype(np.int64) for k in (0, 1))
            at = self.third.find((rank.astype(np.uint64) << BITS) | thirds[known].astype(np.uint64), begin, end)
            out[known[at >= 0]] = self.codes[at[at >= 0]]
        return out

    def value(self, codes: np.ndarray) -> np.ndarray:
        """log10 probabilities of codes that aren't 0."""
        return self.least + self.step * (codes.astype(float) - 1)


class Grams:
    """The distinct n-grams of a block, in the order in which they are sent: by shard and
    words. ``tokens`` are numbers of the block's words in the order of their hashes, of
    which ``cuts`` (shards + 1) tells each shard's; ``sizes`` are the tokens of each text.
    Hashes aren't needed, so that a block can find its answers again without them."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, cuts: np.ndarray):
        many, k, shards = int(cuts[-1]), len(sizes), len(cuts) - 1
        line = np.full(len(tokens) + 2 * k, many, np.int64)  # start marks have the next number
        ends = np.cumsum(sizes + 2)
        inside = np.ones(len(line), bool)
        inside[ends - sizes - 1] = inside[ends - sizes - 2] = False
        line[inside] = tokens
        paired, tripled = np.ones(len(line), bool), np.ones(len(line), bool)
        paired[ends - 1] = tripled[ends - 1] = tripled[ends - 2] = False
        self.doc_of_pair = np.repeat(np.arange(k), sizes + 1)
        at = np.flatnonzero(paired)
        pair, which = np.unique(line[at] * (many + 1) + line[at + 1], return_inverse=True)
        of_line = np.zeros(len(line), np.int64)
        of_line[at] = which
        at = np.flatnonzero(tripled)
        triple, third_of = np.unique(of_line[at] * (many + 1) + line[at + 2], return_inverse=True)
        home = np.append(np.repeat(np.arange(shards), np.diff(cuts)), shards - 1)  # of a word
        first, second = pair // (many + 1), pair % (many + 1)
        shard = (home[first] + home[second]) % shards
        order = np.argsort(shard, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.first, self.second, self.pair_shard, self.pair_of = first[order], second[order], shard[order], rank[which]
        home = rank[triple // (many + 1)]
        order = np.argsort(home, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.home, self.third, self.third_of = home[order], (triple % (many + 1))[order], rank[third_of]


class _Blocks:
    """Makes a block of documents into rows for shards and a row of its own."""

    def __init__(self, shards: int):
        self.shards, self.part, self.made = shards, TaskContext.get().partitionId(), 0

    def rows(self, ids: list[str | None], held: np.ndarray, texts: list[str | None]) -> pd.DataFrame:
        block, self.made = (self.part << 32) | self.made, self.made + 1
        scan = Scan(texts, SPACE)
        sizes = np.diff(scan.offsets) + 1
        hashes = np.empty(int(sizes.sum()), np.uint64)
        is_end = np.zeros(len(hashes), bool)
        is_end[np.cumsum(sizes) - 1] = True
        hashes[is_end], hashes[~is_end] = END, scan.hashes
        del scan
        words, tokens = np.unique(hashes, return_inverse=True)
        shard, spot = word_shard(np.append(words, START), self.shards)
        cuts = np.searchsorted(shard[:-1], np.arange(self.shards + 1))
        grams = Grams(tokens, sizes, cuts)
        learned = (~held).astype(float)
        word_n = np.bincount(tokens, np.repeat(learned, sizes), len(words)).astype(np.uint32)
        pair_n = np.bincount(grams.pair_of, learned[grams.doc_of_pair], len(grams.first)).astype(np.uint32)
        third_n = np.bincount(grams.third_of, np.repeat(learned, sizes), len(grams.third)).astype(np.uint32)
        pairs = ((np.append(words, START) >> np.uint64(32))[grams.first] << BITS) | spot[grams.second]
        per, thirds = np.bincount(grams.home, minlength=len(pairs)).astype(np.uint32), spot.astype(np.uint32)[grams.third]
        pair_cuts = np.searchsorted(grams.pair_shard, np.arange(self.shards + 1))
        third_cuts = np.searchsorted(grams.home, pair_cuts)
        out = []
        for k in range(self.shards):
            w, p, t = slice(*cuts[k : k + 2]), slice(*pair_cuts[k : k + 2]), slice(*third_cuts[k : k + 2])
            if w.stop > w.start or p.stop > p.start:
                out.append((k, block, "keys", pack(words[w], word_n[w], pairs[p], pair_n[p], per[p], thirds[t], third_n[t])))
        # Numbers by frequency take less room.
        common = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
        number = np.empty_like(common)
        number[common] = np.arange(len(common))
        named = "\n".join(i or "" for i in ids).encode()
        head = pack(common.astype(np.uint32), number[tokens].astype(np.uint32), sizes.astype(np.uint32), held, np.frombuffer(named, np.uint8))
        out.append((self.shards + block % 1_000_003, block, "head", head))
        return pd.DataFrame(out, columns=["slot", "block", "kind", "data"])


def _block_batches(shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = _Blocks(shards)
        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            for i, h, t in zip(batch["doc_id"], batch["held"], batch["text"], strict=True):
                ids.append(i)
                held.append(bool(h))
                texts.append(t)
                size += len(t or "") // 6 + 1
                if size >= BLOCK_WORDS or len(ids) >= BLOCK_DOCS:
                    yield blocks.rows(ids, np.array(held, bool), texts)
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield blocks.rows(ids, np.array(held, bool), texts)

    return run


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sums of their counts, and where each key went."""
    one, where = np.unique(keys, return_inverse=True)
    return one, np.bincount(where, counts, len(one)), where


def _shard(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Codes of the keys of each block; a block's own row passes."""
    if group["kind"].iloc[0] == "head":
        return group[["block", "slot", "kind", "data"]]
    group = group.sort_values("block", kind="stable")
    sent = [unpack(d) for d in group["data"]]
    words, word_n, pairs, pair_n, per, thirds, third_n = (np.concatenate(x) for x in zip(*sent, strict=True))
    sizes = [[len(x[k]) for x in sent] for k in (0, 2, 5)]
    del sent
    word, word_n, word_of = _added(words, word_n)
    pair, pair_n, pair_of = _added(pairs, pair_n)
    home = np.repeat(pair_of, per)
    order = np.lexsort((thirds, home))
    home, thirds = home[order], thirds[order]
    new = np.ones(len(order), bool)
    new[1:] = (home[1:] != home[:-1]) | (thirds[1:] != thirds[:-1])
    third_of = np.empty_like(order)
    third_of[order] = np.cumsum(new) - 1
    home, thirds, third_n = home[new], thirds[new], np.bincount(third_of, third_n, int(new.sum()))
    seen, kept = np.flatnonzero(pair_n), np.flatnonzero(third_n)
    place = np.full(len(pair), -1, np.int64)
    place[seen] = np.arange(len(seen))
    trie = Trie(pair[seen], pair_n[seen], place[home[kept]], thirds[kept], third_n[kept])
    place, pair_codes, third_codes = np.empty(len(pair), np.int64), np.zeros(len(pair), np.uint8), np.empty(len(home), np.uint8)
    for lot in np.array_split(np.arange(len(pair)), len(pair) // 200_000 + 1):
        place[lot] = trie.places(pair[lot])
    pair_codes[place >= 0] = trie.pair_codes[place[place >= 0]]
    for lot in np.array_split(np.arange(len(home)), len(home) // 200_000 + 1):
        third_codes[lot] = trie.successors(place[home[lot]], thirds[lot])
    scale = np.array([trie.least, trie.step])
    answers = [np.split(x, np.cumsum(n)[:-1]) for x, n in zip((word_n.astype(np.int64)[word_of], pair_codes[pair_of], third_codes[third_of]), sizes, strict=True)]
    out = [(block, int(key[0]), "codes", pack(scale, *x)) for block, *x in zip(group["block"], *answers, strict=True)]
    out.append((-1, int(key[0]), "total", pack(np.array([word_n.sum(), np.count_nonzero(word_n)], np.int64))))
    return pd.DataFrame(out, columns=["block", "slot", "kind", "data"]).astype({"slot": "int32"})


def _finish(shards: int):
    columns = ["kind", "doc_id", "held_out", "n_tokens", "known", "base", "score", "unseen"]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        if key[0] == -1:
            totals = sum(unpack(d)[0] for d in group["data"])
            return pd.DataFrame([("total", None, None, None, None, *map(float, totals), None)], columns=columns)
        common, tokens, sizes, held, named = unpack(group["data"][group["kind"] == "head"].iloc[0])
        tokens, sizes = common.astype(np.int64)[tokens], sizes.astype(np.int64)
        sent = group[group["kind"] == "codes"].sort_values("slot")
        answers, many = [unpack(d) for d in sent["data"]], np.zeros(shards, np.int64)
        many[sent["slot"]] = [len(x[1]) for x in answers]
        grams = Grams(tokens, sizes, np.concatenate(([0], np.cumsum(many))))
        word_n = np.concatenate([x[1] for x in answers]).astype(float)
        pair_n = COUNTS[np.concatenate([x[2] for x in answers])][grams.pair_of]
        codes = np.concatenate([x[3] for x in answers])
        values = np.concatenate([scale[0] + scale[1] * (c.astype(float) - 1) for scale, _, _, c in answers])[grams.third_of]
        seen = codes[grams.third_of] > 0
        # Of the n + 1 pairs of a text, the first n are contexts and the last n its bigrams.
        is_context, is_bigram = np.ones(len(pair_n), bool), np.ones(len(pair_n), bool)
        is_context[np.cumsum(sizes + 1) - 1] = is_bigram[np.cumsum(sizes + 1) - sizes - 1] = False
        context, bigram, count = pair_n[is_context], pair_n[is_bigram], word_n[tokens]
        starts = np.cumsum(sizes) - sizes
        before = np.empty(len(tokens))
        before[1:] = count[:-1]
        before[starts] = count[starts + sizes - 1]  # as many texts start as end
        unknown = bigram == 0
        two = np.where(unknown, np.log10(backoff(before)) + np.log10(count + 1), np.log10(np.maximum(bigram, 1) - CUT) + seen_weight(before))
        score = np.where(seen, values, np.log10(backoff(context)) + two)
        per_text = [np.add.reduceat(x, starts) for x in ((count > 0).astype(np.int64), np.log10(count + 1), score, (~seen & unknown).astype(float))]
        ids = named.tobytes().decode().split("\n")
        return pd.DataFrame({"kind": "text", "doc_id": [i or None for i in ids], "held_out": held, "n_tokens": sizes, **dict(zip(("known", "base", "score", "unseen"), per_text, strict=True))})[columns]

    return run


def score_documents(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every
    row. Null texts are empty: their only token is the end. A null doc_id isn't held
    out. Rows repeat as they come, and count as often. No rows, no result. Columns besides
    doc_id and text are ignored.

    Blocks are told by partition and order, so ``docs`` must give its rows in the same
    order again if a task is repeated, as stored tables do.
    """
    rows = docs.select(text_id("doc_id"), held_out(FOLDS, HELD).alias("held"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    shards = shards or max(LEAST_SHARDS, -(-(size["n"] + (size["chars"] or 0) // 6) // WORDS_PER_SHARD))
    dealt = rows.mapInPandas(_block_batches(shards), _ROW)
    looked = dealt.groupBy("slot").applyInPandas(_shard, "block long, slot int, kind string, data binary")
    final = "kind string, doc_id string, held_out boolean, n_tokens long, known long, base double, score double, unseen double"
    done = materialise(looked.groupBy("block").applyInPandas(_finish(shards), final), "lm")
    # base and score of the "total" row are N and V
    total = done.where("kind = 'total'").agg(F.coalesce(F.sum("base"), F.lit(0.0)).cast("long").alias("n"), F.coalesce(F.sum("score"), F.lit(0.0)).cast("long").alias("v")).first()
    scale = F.log10(F.lit(float(total["n"] + total["v"] + 1)))
    return done.where("kind = 'text'").select(
        F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * scale).alias("base_score"), (F.col("score") - F.col("unseen") * scale).alias("score"),
    )
