"""Quality classifier: supervised subword embeddings.

A text is the (damped) mean of the vectors of its words, word pairs and character n-grams, found in
one hashed table; a softmax layer turns it into the probability of label 1. Table and layer are trained together
by numpy stochastic gradient descent on a bounded sample of labelled rows. A fifth of the sample is
kept back to fit slope and offset of the final log-odds, so that scores are calibrated.

Because the layer is linear, what a feature adds to the log-odds of a text is a number: scoring looks
up one number per feature in a table of 2**BITS, which is what workers get. Whole texts are scored.

Null or empty texts have no feature and get the score of the offset alone. Without labels of both
kinds every score is the share of label 1, or 0.5 without labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import remainder, table
from tarmac.llm.labelled import fitted, training_rows
from tarmac.llm.text import U, mix, slice_hashes, spans, string_buffers, words

BITS, DIM, EPOCHS, RATE, SEED = 18, 8, 6, 0.5, 11
NGRAMS = (3, 4, 5)
#: Added to the number of features in every mean, so that few features say little.
DAMPING = 20


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature numbers, row bounds): features of row i are numbers[bounds[i]:bounds[i + 1]]."""
    start, end, row = words(data, offsets)
    h = slice_hashes(data, start, end)
    at = np.searchsorted(row, np.arange(len(offsets)))
    yield (h >> U(64 - BITS)).astype(np.int64), at
    # a word that is said again makes the same pair whichever word it is
    pair = np.where(h[:-1] == h[1:], U(1), mix(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:]))[row[:-1] == row[1:]] if len(h) else h
    yield (pair >> U(64 - BITS)).astype(np.int64), np.searchsorted(row[:-1][row[:-1] == row[1:]], np.arange(len(offsets))) if len(h) else at
    raw = data.astype(np.uint64)
    code = raw[: len(raw)] if len(raw) else raw
    width = 1
    for n in NGRAMS:
        while width < n and len(code):
            code = code[:-1] + (raw[width:] << U(8 * width))
            width += 1
        ids = (((code + U(n)) * U(0xD6E8FEB86659FD93)) >> U(64 - BITS)).astype(np.int64)
        inside = np.ones(len(ids), bool)  # n-grams that cross into the next row don't count
        for back in range(1, n):
            cut = offsets[1:-1] - back
            inside[cut[(cut >= 0) & (cut < len(ids))]] = False
        sums = np.concatenate(([0], np.cumsum(inside)))
        yield ids[inside], sums[np.minimum(offsets, len(ids))]


@dataclass
class Model:
    table: np.ndarray  # what a feature adds to the log-odds
    slope: float
    offset: float

    def scores(self, col: pa.Array) -> np.ndarray:
        data, offsets = string_buffers(col)
        out = np.zeros(len(offsets) - 1)
        for a, b in spans(offsets):
            total, n = np.zeros(b - a), np.zeros(b - a)
            for ids, at in features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                sums = np.concatenate(([0.0], np.cumsum(self.table[ids], dtype=np.float64)))
                total += sums[at[1:]] - sums[at[:-1]]
                n += np.diff(at)
            out[a:b] = total / (n + DAMPING)
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.offset, -30, 30)))


def _bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    data, offsets = string_buffers(texts)
    bags = []
    for i in range(len(texts)):
        ids = np.concatenate([f for f, _ in features(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))])
        u, n = np.unique(ids, return_counts=True)
        bags.append((u.astype(np.int32), (n / (len(ids) + DAMPING)).astype(np.float32)))
    return bags


def fit(texts: pa.Array, labels: list[int], epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Trains on texts with labels 0 or 1, in the order given but for a fixed shuffle."""
    y = np.asarray(labels)
    if len(set(labels)) < 2:
        share = y.mean() if len(y) else 0.5
        return Model(np.zeros(1 << BITS), 0.0, float(np.log((share + 0.01) / (1.01 - share))))
    rng = np.random.default_rng(SEED)
    bags = _bags(texts)
    order = rng.permutation(len(y))
    kept_back, train = order[: len(y) // 5], order[len(y) // 5 :]
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer = np.zeros((2, DIM), np.float32)
    bias = np.log(np.maximum(np.bincount(y[train], minlength=2), 1) / len(train)).astype(np.float32)
    steps, step = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            now = rate * (1 - step / steps)
            step += 1
            ids, share = bags[i]
            doc = share @ vectors[ids]
            z = layer @ doc + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ layer
            layer -= now * np.outer(p, doc)
            bias -= 0.1 * now * p
            vectors[ids] -= now * np.outer(share * len(ids), back).astype(np.float32)
    scalar = (vectors @ (layer[1] - layer[0])).astype(np.float32)
    z = np.array([share @ scalar[ids] for ids, share in bags])
    test = kept_back if len(set(y[kept_back])) == 2 else order
    slope, offset = _platt(z[test], y[test])
    return Model(scalar, slope, offset)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit by Newton steps, slightly regularised."""
    scale = max(np.abs(z).max(), 1e-9)
    x = np.stack([z / scale, np.ones(len(z))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag([1e-2, 1e-6]), x.T @ (p - y) + np.array([1e-2, 1e-6]) * w)
    return float(w[0] / scale), float(w[1])


def score(docs: DataFrame, model: Model, col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with a double column `out`, in place of one of that name; the table of numbers, 1 MB, is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.scores(pa.array(texts.fillna(""), pa.string())))

    return docs.withColumn(out, scored(F.col(col).cast("string")))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on the labelled rows outside the held-out fold (crc32(doc_id) mod 4 is 2)."""
    return fitted(*training_rows(docs, labels, "quality", remainder("doc_id", 4) != 2), fit)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that the classifier doesn't reject."""
    return score(docs, model, out="__score").where("__score >= 0.7").drop("__score")
