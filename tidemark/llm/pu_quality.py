"""A quality classifier from positive and unlabelled texts.

A linear model over counts of characters is fitted by the non-negative unbiased risk: with trusted positives,
unlabelled web text and the class prior p, the risk on negatives is estimated as the unlabelled risk less p
times the positives' risk, and kept from falling below zero. Labels of negatives are not used. The prior is
estimated from the two samples alone.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ASCII signs that are counted one by one; other characters are counted by class.
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
N_FEATURES = len(SIGNS) + 13
_SIGN_CODES = np.frombuffer(SIGNS, dtype=np.uint8)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORDLIKE = np.zeros(256, dtype=bool)
_WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PIECE = 1 << 22


def repeated(text: str) -> float:
    """The share of words that are the same as the word before, cut at every _PIECE characters."""
    same = total = 0
    for at in range(0, len(text), _PIECE):
        words = text[at : at + _PIECE].split()
        same += sum(map(operator.eq, words, words[1:]))
        total += len(words)
    return same / max(total, 1)


def features(text: str) -> np.ndarray:
    """Shares of signs, character classes and word forms in a whole text; all zero for an empty one."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    n = len(data)
    if not n:
        return np.zeros(N_FEATURES)
    counts = np.zeros(256)
    words = signed = shouted = letters = 0
    last_space, last_word, last_upper = True, False, False
    for at in range(0, n, _PIECE):  # pieces bound the helper arrays of very long texts
        piece = data[at : at + _PIECE]
        counts += np.bincount(piece, minlength=256)
        space, wordlike, upper = _SPACE[piece], _WORDLIKE[piece], (piece >= 65) & (piece <= 90)
        ends = space & ~np.concatenate(([last_space], space[:-1]))
        words += int(ends.sum())
        signed += int((ends & ~np.concatenate(([last_word], wordlike[:-1]))).sum())
        shouted += int((upper & np.concatenate(([last_upper], upper[:-1]))).sum())
        letters += int(wordlike.sum())
        last_space, last_word, last_upper = bool(space[-1]), bool(wordlike[-1]), bool(upper[-1])
    if not last_space:
        words, signed = words + 1, signed + (not last_word)
    w = max(words, 1)
    upper, lower, digit = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    wide = counts[128:].sum()
    shares = np.concatenate((counts[_SIGN_CODES] / w, [upper / n, lower / n, digit / n, wide / n, counts[10] / w, counts[_SPACE].sum() / n, signed / w, shouted / n]))
    return np.concatenate((np.sqrt(shares), [math.sqrt(repeated(text)), np.log1p(n) / 10, np.log1p(words) / 10, letters / n, min(n / w, 40) / 40]))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _adam(x: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400) -> float:
    """The share of positives among the unlabelled, from features of both.

    A classifier of positives against unlabelled orders the texts; over all thresholds, the least ratio of
    the unlabelled to the positives above it is the share, as negatives are missing where it is least. Only
    thresholds with half of the positives above count, where sampling error is small.
    """
    p, u = positive, unlabelled

    def gradient(w: np.ndarray) -> np.ndarray:
        return -(p.T @ _sigmoid(-(p @ w))) / len(p) + (u.T @ _sigmoid(u @ w)) / len(u) + 1e-4 * w

    w = _adam(np.zeros(p.shape[1]), gradient, steps, 0.05)
    sp, su = np.sort(p @ w), np.sort(u @ w)
    cuts = np.quantile(sp, np.linspace(0, 0.5, 51))  # higher cuts leave too few positives to tell
    above_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    above_u = 1 - np.searchsorted(su, cuts) / len(su)
    ratio = above_u / np.maximum(above_p, 1e-9)
    return float(np.clip(ratio.min(), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1200, rate: float = 0.03, decay: float = 1e-4) -> np.ndarray:
    """Weights that minimise the non-negative risk with the logistic loss (the last weight is the bias)."""

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = positive @ w, unlabelled @ w
        rp, ru = _sigmoid(zp), _sigmoid(zu)  # slopes of the losses as negatives
        negative = (unlabelled.T @ ru) / len(zu) - prior * (positive.T @ rp) / len(zp)
        risk = _softplus(zu).mean() - prior * _softplus(zp).mean()
        if risk < 0:  # overfitted: step back along the negative part alone
            return -negative
        return prior * -(positive.T @ _sigmoid(-zp)) / len(zp) + negative + decay * w

    return _adam(np.zeros(positive.shape[1]), gradient, steps, rate)


class Model:
    """Standardised features, weights, and the score of a text."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def score(self, text: str) -> float:
        x = np.clip((features(text) - self.mean) / self.scale, -8, 8)
        return float(_sigmoid(x @ self.weights[:-1] + self.weights[-1]))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """A model from features; without positives or unlabelled texts it scores everything 0.5."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1), 0.5)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    one = lambda x: np.hstack((np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))))
    p, u = one(positive), one(unlabelled)
    prior = estimate_prior(p, u) if prior is None else prior
    return Model(mean, scale, fit(p, u, prior), prior)


def held_out(id_col: str = "doc_id"):
    """Whether a document's label must not be learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 12_000) -> Model:
    """Fit on at most sample positives and sample unlabelled documents, picked by a hash of the id.

    Positives are the rows of labels that are 1 and not held out; unlabelled are documents that are not held
    out, whatever their label. Labels that are null or of unknown documents don't count; of rows with equal ids one
    is taken. Texts count whole; an empty table gives a model that scores everything 0.5.
    """
    order = F.xxhash64(F.lit(17), F.col("id"))
    train_side = ~F.coalesce(held_out("id"), F.lit(True))
    trusted = labels.selectExpr(f"`{id_col}` AS id", f"`{label_col}` AS label").filter((F.col("label") == 1) & train_side).select("id").distinct().orderBy(order, "id").limit(sample)
    others = docs.selectExpr(f"`{id_col}` AS id").filter(train_side).distinct().orderBy(F.xxhash64(F.lit(18), F.col("id")), "id").limit(sample)
    picked = trusted.withColumn("p", F.lit(1)).unionByName(others.withColumn("p", F.lit(0))).groupBy("id").agg(F.max("p").alias("p"), (F.min("p") == 0).alias("u"))
    texts = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").join(F.broadcast(picked), "id")  # 2 * sample ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py() or "").tolist() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(x, pa.list_(pa.float64()))], names=["id", "p", "u", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.select("text", "id", "p", "u").mapInArrow(run, f"id {kind}, p int, u boolean, x array<double>")
    rows = rows.groupBy("id").agg(F.min(F.struct("p", "u", "x")).alias("r")).select("r.*").collect()  # a row per id, 2 * sample at most
    positive = np.array([r["x"] for r in rows if r["p"]]).reshape(-1, N_FEATURES)
    unlabelled = np.array([r["x"] for r in rows if r["u"]]).reshape(-1, N_FEATURES)
    return train(positive, unlabelled)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and score of each row of docs; a null text counts as empty, other columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array([model.score(t.as_py() or "") for t in b.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), s], names=["id", "score"])

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def good_rows(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of docs whose score is at least least, with all their columns, whatever their names.

    A null text counts as empty; texts count whole; repeated rows are scored each; an empty table stays empty.
    """
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([model.score(t.as_py() or "") >= least for t in b.column(at)], pa.bool_())
            yield b.filter(keep)

    return docs.mapInArrow(run, docs.schema).select(*[F.col(f"`{c}`") for c in names])
