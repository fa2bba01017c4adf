"""Vectorised tokenising and word hashing over UTF-8 bytes.

Many texts are laid end to end, separated by a blank, and all words are found and
hashed with a fixed number of numpy passes; there is no Python loop over words. A
word's hash is a polynomial in random 64-bit values of its bytes, mixed at the end,
so equal words have equal hashes in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (murmur3's finaliser)."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def space_words() -> np.ndarray:
    """Bytes of words [^\\x20\\x09-\\x0D]+."""
    is_word = np.ones(256, bool)
    is_word[[0x20, *range(0x09, 0x0E)]] = False
    return is_word


def alnum_words() -> np.ndarray:
    """Bytes of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ (after lower-casing)."""
    is_word = np.zeros(256, bool)
    is_word[0x30:0x3A] = is_word[0x61:0x7B] = is_word[0x80:] = True
    return is_word


SPACE, ALNUM = space_words(), alnum_words()


class Scan:
    """Words of some texts: ``hashes``, ``doc`` (index of the text), ``start`` and
    ``end`` (byte positions in ``data``), and ``offsets``: the words of text i are
    offsets[i]:offsets[i + 1]."""

    def __init__(self, texts: list[str | None], is_word: np.ndarray):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = b" ".join(raw).lower() + b" "
        codes = np.frombuffer(self.data, np.uint8)
        inside = np.empty(len(codes) + 1, np.int8)
        inside[0], inside[1:] = 0, is_word[codes]
        step = np.diff(inside)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        total = np.empty(len(codes) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE_VALUES[codes] * _power(_BASE, len(codes)), out=total[1:])
        self._total, self._back = total, _power(_INVERSE, len(codes))
        self.hashes = mix((total[self.end] - total[self.start]) * self._back[self.start])
        limits = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
        self.offsets = np.concatenate(([0], np.searchsorted(self.start, limits))).astype(np.int64)
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.offsets))

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words with more than ``size`` bytes, and hashes of their first
        ``size`` bytes (other values than those of whole words)."""
        long_ = np.flatnonzero(self.end - self.start > size)
        at = self.start[long_]
        return long_, mix((self._total[at + size] - self._total[at]) * self._back[at] + np.uint64(size))


def word_hash(word: str) -> int:
    return int(Scan([word], SPACE).hashes[0])


def chunks(texts: Iterable[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``limit`` characters each; a longer
    text stands alone, whole."""
    first, size, n = 0, 0, 0
    for n, text in enumerate(texts, 1):
        size += len(text or "") + 1
        if size >= limit:
            yield first, n
            first, size = n, 0
    if first < n:
        yield first, n


def fold(values: np.ndarray, width: int, factor: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hashes of every run of ``width`` consecutive values (len - width + 1 of them)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = values[:n].copy()
    for k in range(1, width):
        out *= np.uint64(factor)
        out += values[k : k + n]
    return mix(out)


def runs_start(offsets: np.ndarray, width: int) -> np.ndarray:
    """Which of the runs that ``fold`` hashes lie inside one text: positions of their
    first words."""
    total = int(offsets[-1])
    ok = np.zeros(max(total, 0) + 1, np.int32)
    lengths = np.diff(offsets)
    has = lengths >= width
    np.add.at(ok, offsets[:-1][has], 1)
    np.add.at(ok, offsets[1:][has] - width + 1, -1)
    return np.flatnonzero(np.cumsum(ok)[:-1] > 0)
