"""Quality classifier on random Fourier features (operator 6).

Statistics of a whole text are standardised and mapped to random Fourier features,
whose inner products approximate a Gaussian kernel. Partitions of the training sample
sum their share of the normal equations; the driver adds these few small matrices and
solves the ridge system. Scores on a fold that the ridge fit didn't see are calibrated
by isotonic regression (pool adjacent violators).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import held_out, training_rows
from .textscan import SPACE, Scan, chunks

FEATURES, WIDTH, RIDGE, SEED, PARTS = 512, 3.0, 1.0, 20240611, 16
FOLDS, HELD = 5, 0
_WINDOW = 24

_UPPER, _DIGIT, _MARK = (np.zeros(256, np.int32) for _ in range(3))
_UPPER[0x41:0x5B] = 1
_DIGIT[0x30:0x3A] = 1
_MARK[[ord(c) for c in "!#$%&*|~^@=+<>{}[]\\_/"]] = 1


def _worst(flags: np.ndarray, scan: Scan) -> np.ndarray:
    """The largest share of flagged words in a window of each text."""
    sums = np.concatenate(([0], np.cumsum(flags)))
    first = np.arange(len(flags))
    last = np.minimum(first + _WINDOW, scan.offsets[scan.doc + 1])
    start = np.minimum(first, np.maximum(scan.offsets[scan.doc], last - _WINDOW))
    share = (sums[last] - sums[start]) / np.maximum(last - start, 1)
    out = np.zeros(len(scan.offsets) - 1)
    some = np.flatnonzero(np.diff(scan.offsets))
    if len(some):
        out[some] = np.maximum.reduceat(share, scan.offsets[some])
    return out


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of statistics per whole text; null counts as empty."""
    texts = [t or "" for t in texts]
    scan = Scan(texts, SPACE)
    raw = np.frombuffer(b" ".join(t.encode("utf-8", "surrogatepass") for t in texts) + b" ", np.uint8)
    running = {k: np.concatenate(([0], np.cumsum(t[raw]))) for k, t in (("upper", _UPPER), ("digit", _DIGIT), ("mark", _MARK))}
    inside = {k: v[scan.end] - v[scan.start] for k, v in running.items()}
    length = scan.end - scan.start
    n = np.diff(scan.offsets)
    per = np.maximum(n, 1)
    total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[scan.offsets])
    again = np.zeros(len(length), bool)
    again[1:] = (scan.hashes[1:] == scan.hashes[:-1]) & (scan.doc[1:] == scan.doc[:-1])
    shout, marked = inside["upper"] >= 2, inside["mark"] >= 1
    size = np.maximum(total(length), 1)
    distinct = np.array([len(np.unique(scan.hashes[a:b])) for a, b in zip(scan.offsets, scan.offsets[1:], strict=False)]) / per
    lines = [[x for x in t.split("\n") if x] for t in texts]
    columns = [
        np.log1p(n), total(length) / per, np.sqrt(np.maximum(total(length.astype(np.int64) ** 2) / per - (total(length) / per) ** 2, 0)),
        total(inside["upper"]) / size, total(inside["digit"]) / size, total(inside["mark"]) / size,
        total(shout) / per, total(marked) / per, total(again) / per, distinct, distinct * np.log1p(n),
        _worst(shout, scan), _worst(marked, scan), _worst(again, scan),
        np.array([len(set(x)) / max(1, len(x)) for x in lines]), np.array([len(x) for x in lines]) / per,
        total(inside["digit"] >= 4) / per,
    ]
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return fourier((rows - self.mean) / self.scale) @ self.weights

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.values[0])
        return np.interp(self.raw(statistics(texts)), self.knots, self.values)


def fourier(rows: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised rows, with a constant column."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    turn = rng.normal(0, 1 / WIDTH, (rows.shape[1], FEATURES))
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    waves = np.sqrt(2 / FEATURES) * np.cos(np.clip(rows, -8, 8) @ turn + shift)
    return np.concatenate((waves, np.ones((len(rows), 1))), axis=1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the non-decreasing least-squares fit (pool adjacent
    violators; equal x form one point). Each pooled block counts one success and one
    failure more at the base rate, so that no score is wholly certain."""
    order = np.argsort(x, kind="stable")
    levels, start = np.unique(x[order], return_index=True)
    sums, counts = np.add.reduceat(y[order].astype(float), start), np.diff([*start, len(x)]).astype(float)
    blocks: list[list[float]] = []
    for k in range(len(levels)):
        blocks.append([sums[k], counts[k], levels[k], levels[k]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, _, high = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][3] = high
    base = float(np.mean(y))
    knots, values = [], []
    for s, c, low, high in blocks:
        value = (s + 2 * base) / (c + 2)
        knots += [low, high] if high > low else [low]
        values += [value, value] if high > low else [value]
    return np.array(knots), np.maximum.accumulate(np.array(values))


def _statistics_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i, j in chunks(batch["text"]):
            part = batch.iloc[i:j]
            yield pd.DataFrame({"x": list(statistics(part["text"].tolist())), "y": part["y"], "fold": part["fold"]})


def _normal_batches(mean: np.ndarray, scale: np.ndarray):
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = FEATURES + 1
        left, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            batch = batch[batch["fold"] != 0]
            if len(batch):
                z = fourier((np.stack(batch["x"].to_list()) - mean) / scale)
                left += z.T @ z
                right += z.T @ batch["y"].to_numpy(float)
        yield pd.DataFrame({"left": [left.tobytes()], "right": [right.tobytes()]})

    return sums


def fit(docs: DataFrame, labels: DataFrame, sample: int | None = None) -> Model:
    """Fit on labelled rows of ``docs`` outside the held-out bucket. Without rows of
    both labels every text gets the base rate (0.5 without any row)."""
    rows = training_rows(docs, labels, "quality", FOLDS, HELD, *([sample] if sample else []))
    stats = rows.select("text", "y", "fold").mapInPandas(_statistics_batches, "x array<double>, y int, fold int").repartition(PARTS).cache()
    moments = stats.agg(F.count("*").alias("n"), F.avg("y").alias("rate"), *(f(F.col("x")[k]).alias(f"{f.__name__}{k}") for k in range(statistics([""]).shape[1]) for f in (F.avg, F.stddev_pop))).first()
    none = np.empty(0)
    if not moments["n"] or moments["rate"] in (0.0, 1.0):
        stats.unpersist()
        return Model(none, none, none, none, np.array([0.5 if moments["rate"] is None else moments["rate"]]))
    d = statistics([""]).shape[1]
    mean, scale = (np.array([moments[f"{f}{k}"] for k in range(d)]) for f in ("avg", "stddev_pop"))
    scale = np.where(scale > 1e-9, scale, 1.0)
    parts = stats.mapInPandas(_normal_batches(mean, scale), "left binary, right binary").collect()  # one per partition, PARTS at most
    left = sum(np.frombuffer(p["left"]) for p in parts).reshape(FEATURES + 1, FEATURES + 1)
    right = sum(np.frombuffer(p["right"]) for p in parts)
    weights = np.linalg.solve(left + RIDGE * np.eye(FEATURES + 1), right)
    fresh = stats.where("fold = 0").select("x", "y").collect()  # a fifth of the bounded sample
    stats.unpersist()
    model = Model(mean, scale, weights, none, none)
    if fresh:
        x, y = np.array([r["x"] for r in fresh]), np.array([r["y"] for r in fresh])
        model.knots, model.values = isotonic(model.raw(x), y)
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def scorer(spark, model):
    """A function of a text column that gives scores."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        for i, j in chunks(texts):
            out[i:j] = shared.value.score(texts.iloc[i:j].tolist())
        return pd.Series(np.clip(out, 0, 1))

    def apply(text: Column) -> Column:
        return score(text.cast("string"))

    return apply


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) of every row. Null texts
    count as empty; rows repeat as they come; a null doc_id isn't held out."""
    score = scorer(docs.sparkSession, fit(docs, labels))
    scored = docs.select("doc_id", held_out(FOLDS, HELD).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
