"""Toxicity on restored text (operator 2).

Writers hide words: digits and signs for letters, letters set apart, letters repeated.
A character trigram model is counted over all documents. Tokens that look disguised
are decoded: each character opens the letters that it may stand for, a run of equal
letters one or two of them, and Viterbi's algorithm takes the likeliest path under the
character model. The restored text is then scored: every word gives the largest log
odds of its whole form and its beginnings, and a logistic model of the strongest
evidence and its sum gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import held_out, training_rows
from .quality import scorer
from .textscan import ALNUM, Scan, chunks

FOLDS, HELD = 4, 2
PREFIXES, LEAST, STRONG = (4, 5, 6), 3, 2.0
#: Tokens of at most this length are decoded once per task and remembered.
REMEMBERED = 64

# Letters that a sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
    # Cyrillic and Greek letters that look like Latin ones.
    "а": "a", "в": "b", "е": "e", "и": "u", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "uy", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}

#: Symbols: 0 is any non-letter, 1-26 a-z, 27-59 the Latin letters U+00DF-U+00FF.
SYMBOLS = 60
_FAR = 0x250
#: Code points of signs from _FAR upwards, in order, and where the tables have them.
_FAR_SIGNS = np.array(sorted({ord(x) for c in STANDS_FOR for x in (c, c.upper()) if len(x) == 1 and ord(x) >= _FAR}), np.uint32)
_CODE = np.zeros(_FAR + len(_FAR_SIGNS), np.int64)
_CODE[0x61:0x7B] = _CODE[0x41:0x5B] = np.arange(1, 27)
_CODE[0xDF:0x100] = np.arange(27, 60)
_CODE[0xC0:0xDF] = _CODE[0xE0:0xFF]
_CODE[[0xD7, 0xF7]] = 0
_SIGN = np.zeros(len(_CODE), bool)
_SIGN[[ord(c) for c in STANDS_FOR if ord(c) < _FAR]] = _SIGN[_FAR:] = True


def codes(text: str) -> np.ndarray:
    """Code points below _FAR, places of signs beyond, and 0 for all else."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    near = np.where(points < _FAR, points, 0)
    far = np.flatnonzero(points >= _FAR)
    if len(far):
        at = np.minimum(np.searchsorted(_FAR_SIGNS, points[far]), len(_FAR_SIGNS) - 1)
        near[far] = np.where(_FAR_SIGNS[at] == points[far], _FAR + at, 0)
    return near


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for i, j in chunks(batch["text"]):
            s = _CODE[codes("  " + "  ".join(t or "" for t in batch["text"].iloc[i:j]) + "  ")]
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    seen = np.flatnonzero(total)
    yield pd.DataFrame({"cell": seen, "n": total[seen]})


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probability of a symbol after two others, over all documents: trigram counts
    with bigram and uniform smoothing. At most SYMBOLS**3 cells reach the driver."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(_count_batches, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cube = np.zeros(SYMBOLS**3)
    cube[counted["cell"].to_numpy(np.int64)] = counted["n"].to_numpy(float)
    cube = cube.reshape((SYMBOLS,) * 3)
    pair = cube.sum(axis=0)
    low = (pair + 0.5) / (pair.sum(axis=1, keepdims=True) + 0.5 * SYMBOLS)
    return np.log((cube + 5 * low[None]) / (cube.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


def _letter(c: str) -> int:
    return int(_CODE[ord(c)]) if len(c) == 1 and ord(c) < _FAR else 0


def decode(token: str, model: np.ndarray, breaks: bool = False) -> str:
    """The likeliest letters behind a disguised token (lower case). The lattice has a
    node per run of equal characters; a node's arcs spell one or two letters, a sign
    costs a little per use and dropping one letter of a plain pair more. With ``breaks``
    a gap may also part two words, as the character model has it."""
    runs: list[tuple[str, int]] = []
    for c in token.lower():
        if runs and runs[-1][0] == c:
            runs[-1] = (c, runs[-1][1] + 1)
        else:
            runs.append((c, 1))
    # What a path has said is a chain of pieces, so that long tokens cost linear time.
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for c, many in runs:
        letters = STANDS_FOR.get(c, c if _letter(c) else "")
        cost = 1.0 if c in STANDS_FOR else 0.0
        arcs = [(x * k, cost + (2.0 if many == 2 and k == 1 else 0.0)) for x in letters for k in ((1,) if many == 1 else (1, 2))]
        arcs = arcs or [("", 3.0), (" ", 3.0)][: 1 + breaks]  # anything else is noise between letters
        ahead: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (weight, said) in paths.items():
            for out, price in arcs:
                x, y, w = a, b, weight - price
                for letter in out:
                    s = _letter(letter)
                    w += float(model[x, y, s])
                    x, y = y, s
                if (x, y) not in ahead or ahead[x, y][0] < w:
                    ahead[x, y] = (w, (said, out))
        paths = ahead
    said, pieces = max(((w + float(model[a, b, 0]), said) for (a, b), (w, said) in paths.items()), key=lambda x: x[0])[1], []
    while said:
        said, out = said
        pieces.append(out)
    return "".join(reversed(pieces))


def _disguised(s: np.ndarray) -> list[tuple[int, int]]:
    """Spans of tokens that look disguised: a sign between letters, three equal letters
    in a row, two or more doubled letters, or three or more single letters and signs set
    apart by up to three other characters each, outside addresses if the gaps differ."""
    letter = _CODE[s] > 0
    sign = _SIGN[s]
    blank = np.isin(s, (0x20, 9, 10, 11, 12, 13))
    spans = set()
    edges = np.flatnonzero(blank)
    part = letter | sign
    triple = letter[:-2] & (_CODE[s[:-2]] == _CODE[s[1:-1]]) & (_CODE[s[1:-1]] == _CODE[s[2:]])
    double = letter[:-1] & (_CODE[s[:-1]] == _CODE[s[1:]])
    pairs = np.flatnonzero(double)
    home = np.searchsorted(edges, pairs)
    pairs = pairs[np.bincount(home)[home] >= 2] if len(pairs) else pairs
    hidden = np.concatenate((np.flatnonzero(sign[:-1] & letter[1:]), np.flatnonzero(letter[:-1] & sign[1:]) + 1, np.flatnonzero(triple), pairs))
    for k in np.unique(np.searchsorted(edges, hidden)).tolist():
        low, high = int(edges[k - 1]) + 1 if k else 0, int(edges[k]) if k < len(edges) else len(s)
        while low < high and not part[low]:
            low += 1
        while low < high and not (letter[high - 1] or 0x30 <= s[high - 1] < 0x3A or s[high - 1] >= _FAR):
            high -= 1
        if high - low >= 3 and letter[low:high].any() and (sign[low:high].any() or triple[low : high - 2].any() or np.count_nonzero(double[low : high - 1]) >= 2):
            spans.add((low, high))
    lone = part.copy()
    lone[1:] &= ~part[:-1]
    lone[:-1] &= ~part[1:]
    ones = np.flatnonzero(lone)
    if len(ones) >= 3:
        # Nothing but marks and blanks may stand between: no word, number or other script.
        solid = part | (s == 0) | ((s >= 0x30) & (s < 0x3A)) | (s >= 0x80)
        near = (np.diff(ones) <= 4) & (np.diff(np.cumsum(solid)[ones]) == 1)
        cuts = np.flatnonzero(~near)
        for a, b in zip(np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(ones) - 1])), strict=True):
            if b - a >= 2 and np.count_nonzero(letter[ones[a : b + 1]]) >= 2:
                low, high = int(ones[a]), int(ones[b]) + 1
                gaps = s[low:high][~part[low:high]]
                first = int(np.searchsorted(edges, low))
                token = s[int(edges[first - 1]) + 1 if first else 0 : high].tolist()
                if (gaps == gaps[0]).all() or not any(token[k : k + 3] == [0x3A, 0x2F, 0x2F] for k in range(len(token) - 2)):
                    spans.add((low, high))
    return sorted(spans)


def _said(c: str) -> bool:
    """Whether a character is a letter or may stand for one."""
    return bool(_letter(c)) or c.lower() in STANDS_FOR


def _readings(token: str, model: np.ndarray) -> str:
    """The decoded token; where other readings are as well founded, all: letters set
    apart as one word, as several where the character model has a break, and as several
    where other characters part them; and doubled letters as they are written."""
    plain = decode(token, model)
    out = [plain]
    if any(not _said(c) for c in token):
        out.append(" ".join(decode(token, model, True).split()))
        parts = "".join(c if _said(c) else " " for c in token).split()
        if any(len(p) > 1 for p in parts):
            out.append(" ".join(decode(p, model) if any(c.lower() in STANDS_FOR for c in p) else p for p in parts))
    elif all(_letter(c) for c in token) and not any(a == b == c for a, b, c in zip(token.lower(), token[1:].lower(), token[2:].lower())):
        out.insert(0, token)
    return " ".join(dict.fromkeys(out))


def restore(text: str | None, model: np.ndarray, known: dict[str, str] | None = None) -> str:
    """``text`` with disguised tokens decoded (see ``_readings``); all else is as it was. Null is empty."""
    text = text or ""
    s = codes(text)
    if len(s) < 3:
        return text
    out, at = [], 0
    for low, high in _disguised(s):
        if low < at:
            continue
        token = text[low:high]
        plain = None if known is None else known.get(token)
        if plain is None:
            plain = _readings(token, model)
            if known is not None and high - low <= REMEMBERED and len(known) < 100_000:
                known[token] = plain
        out += [text[at:low], plain]
        at = high
    return "".join([*out, text[at:]])


def _restored(texts, model: np.ndarray, known: dict[str, str]) -> list[str]:
    return [restore(t, model, known) for t in texts]


def features(scan: Scan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word positions and hashes of each kind of feature."""
    yield np.arange(len(scan.hashes)), scan.hashes
    for size in PREFIXES:
        yield scan.prefixes(size)


def _per_document(scan: Scan, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs."""
    docs, values = [], []
    for at, hashes in features(scan):
        if keep is not None:
            here = np.isin(hashes, keep)
            at, hashes = at[here], hashes[here]
        docs.append(scan.doc[at])
        values.append(hashes)
    doc, value = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def _feature_batches(model, keep):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, str] = {}
        for batch in batches:
            for i, j in chunks(batch["text"]):
                scan = Scan(_restored(batch["text"].iloc[i:j], model.value, known), ALNUM)
                _, value = _per_document(scan, None if keep is None else keep.value)
                seen, n = np.unique(value, return_counts=True)
                yield pd.DataFrame({"feature": seen.view(np.int64), "n": n})

    return count


@dataclass
class Model:
    characters: np.ndarray
    keys: np.ndarray
    odds: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    rate: float
    sieve: np.ndarray = field(init=False)

    def __post_init__(self):
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.known: dict[str, str] = {}

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Per text: strongest word, sum and number of distinct strong words, share."""
        scan = Scan(_restored(texts, self.characters, self.known), ALNUM)
        best = np.zeros(len(scan.hashes))
        for at, hashes in features(scan):
            hit = np.flatnonzero(self.sieve[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
            if len(hit) and len(self.keys):
                slot = np.minimum(np.searchsorted(self.keys, hashes[hit]), len(self.keys) - 1)
                same = self.keys[slot] == hashes[hit]
                np.maximum.at(best, at[hit[same]], self.odds[slot[same]])
        out = np.zeros((len(texts), 4))
        strong = np.flatnonzero(best >= STRONG)
        if len(strong):
            order = strong[np.lexsort((scan.hashes[strong], scan.doc[strong]))]
            new = np.ones(len(order), bool)
            new[1:] = (scan.doc[order][1:] != scan.doc[order][:-1]) | (scan.hashes[order][1:] != scan.hashes[order][:-1])
            order = order[new]
            np.maximum.at(out[:, 0], scan.doc[order], best[order])
            np.add.at(out[:, 1], scan.doc[order], best[order])
            np.add.at(out[:, 2], scan.doc[order], 1)
        out[:, 3] = out[:, 2] / np.sqrt(np.maximum(np.diff(scan.offsets), 1))
        out[:, 1] = np.log1p(out[:, 1])
        out[:, 2] = np.log1p(out[:, 2])
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.rate)
        return 1 / (1 + np.exp(-(((self.evidence(texts) - self.shift) / self.scale) @ self.weights[1:] + self.weights[0])))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weights (constant first) by Newton's method."""
    z = np.concatenate((np.ones((len(x), 1)), x), axis=1)
    w, keep = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int | None = None) -> Model:
    """Fit on labelled rows of ``docs`` outside the held-out bucket. Word odds come from
    folds 1-4 of the bounded sample, the logistic weights from fold 0. Without rows of
    both labels every text gets the base rate (0.5 without any row)."""
    spark, none = docs.sparkSession, np.empty(0)
    characters = character_model(docs)
    shared = spark.sparkContext.broadcast(characters)
    rows = training_rows(docs, labels, "toxic", FOLDS, HELD, *([sample] if sample else []))
    sizes = {(r["y"], r["f"]): r["n"] for r in rows.groupBy("y", (F.col("fold") == 0).alias("f")).agg(F.count("*").alias("n")).collect()}
    all_rows = sum(sizes.values())
    rate = (sizes.get((1, True), 0) + sizes.get((1, False), 0)) / all_rows if all_rows else 0.5
    empty = Model(characters, np.empty(0, np.uint64), none, none, none, none, rate)
    if not sizes.get((1, False)) or not sizes.get((0, False)):
        return empty

    def counted(label: int, keep, least: int) -> pd.DataFrame:
        part = rows.where((F.col("y") == label) & (F.col("fold") != 0)).select("text")
        return part.mapInPandas(_feature_batches(shared, keep), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()

    found = counted(1, None, min(LEAST, sizes[1, False]))  # features of the bounded sample's toxic rows
    keys, order = np.unique(found["feature"].to_numpy(np.int64).view(np.uint64), return_index=True)
    pos = found["n"].to_numpy(float)[order]
    against = counted(0, spark.sparkContext.broadcast(keys), 1)
    neg = np.zeros(len(keys))
    if len(against):
        neg[np.searchsorted(keys, against["feature"].to_numpy(np.int64).view(np.uint64))] = against["n"].to_numpy(float)
    n_pos, n_neg = sizes[1, False], sizes[0, False]
    # One standard error is taken off, so that a rare feature needs more.
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1)) - np.sqrt(1 / (pos + 0.5) + 1 / np.maximum(neg + 0.5, (pos + 0.5) * n_neg / n_pos))
    keep = odds >= STRONG
    model = Model(characters, keys[keep], odds[keep], none, none, none, rate)
    fresh = rows.where("fold = 0").select("text", "y")
    shown = spark.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, j in chunks(batch["text"]):
                yield pd.DataFrame({"x": list(shown.value.evidence(batch["text"].iloc[i:j].tolist())), "y": batch["y"].iloc[i:j]})

    got = fresh.mapInPandas(evidence, "x array<double>, y int").toPandas()  # a fifth of the bounded sample
    if got["y"].nunique() < 2:
        return empty
    x = np.stack(got["x"].to_list())
    model.shift, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model.weights = logistic((x - model.shift) / model.scale, got["y"].to_numpy(float))
    return model


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) of every row. Null texts
    count as empty; rows repeat as they come; a null doc_id isn't held out."""
    score = scorer(docs.sparkSession, fit(docs, labels))
    scored = docs.select("doc_id", held_out(FOLDS, HELD).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
