"""Toxicity: a classifier that is penalised for scores that change with the group that is mentioned.

A text is described by how often each word occurs in it, and how often each beginning of a word (PREFIX
bytes, of longer words): a feature is one of these at one of the LEVELS it reaches. Words are runs of
letters with A-Z in lower case. The log-odds of label 1 are linear in the features. Fitting minimises,
on a bounded sample of labelled rows,

    mean logistic loss + SWAP * mean (log-odds of the text - log-odds with identity terms swapped)**2 / 2 + SPARSE * sum |weight|

where the swap replaces each identity term by the next of its group (IDENTITY). Words that name a
group thus can't carry the label themselves, which spares neutral mentions. The absolute penalty keeps
most weights at exactly 0, so long texts don't gather noise. Features of fewer than RARE texts of the
sample aren't tried. Proximal gradient steps on a growing set of features, until no feature outside
would enter. The result doesn't depend on the order of rows. Whole texts are scored.

Null or empty texts get the score of the offset. Without labels of both kinds every score is the share
of label 1, or 0.5 without labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import remainder, table
from tarmac.llm.labelled import fitted, training_rows
from tarmac.llm.text import IS_NO_LETTER, U, running, sliced, spans, string_buffers, words

BITS, STEPS, SWAP, SPARSE, RARE, SKETCH = 40, 300, 1.0, 8e-4, 3, 22
PREFIX = (5, 6, 7)
LEVELS = np.array([1, 2, 3, 5])
#: Groups of identity terms that can stand for each other.
IDENTITY = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["girl", "boy"], ["she", "he"], ["female", "male"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"], ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "hispanic", "latino", "african", "european", "arab"],
    ["gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"], ["transgender", "cisgender"],
    ["immigrant", "native"], ["immigrants", "natives"], ["refugees", "citizens"], ["disabled", "blind", "deaf"], ["old", "young"],
    ["american", "mexican", "chinese", "russian", "indian", "german", "french", "spanish"],
]


def places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place (a hash of BITS) of each word and each beginning of a word."""
    start, end, row = words(data, offsets, IS_NO_LETTER)
    sums = running(data)
    rows, found = [row], [sliced(sums, start, end)]
    for n in PREFIX:
        long = end - start > n
        rows.append(row[long])
        found.append(sliced(sums, start[long], start[long] + n) + U(1))
    return np.concatenate(rows), (np.concatenate(found) >> U(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    places: np.ndarray  # of the features that count, sorted
    weights: np.ndarray  # a column for each level
    offset: float

    def scores(self, col: pa.Array) -> np.ndarray:
        data, offsets = string_buffers(col)
        z = np.full(len(offsets) - 1, self.offset)
        sums = np.cumsum(self.weights, 1)
        for a, b in spans(offsets) if len(self.places) else ():
            row, place = places(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            i = np.minimum(np.searchsorted(self.places, place), len(self.places) - 1)
            hit = self.places[i] == place
            pairs, n = np.unique(row[hit] * len(self.places) + i[hit], return_counts=True)
            if len(pairs):
                level = np.searchsorted(LEVELS, n, "right") - 1
                z[a:b] += np.bincount(pairs // len(self.places), sums[pairs % len(self.places), level], b - a)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, place and count of what texts hold, some texts at a time."""
    data, offsets = string_buffers(texts)
    for a, b in spans(offsets):
        row, place = places(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        key, n = np.unique((row.astype(np.int64) << BITS) | place, return_counts=True)
        yield (key >> BITS).astype(np.int32) + np.int32(a), key & ((1 << BITS) - 1), np.minimum(n, 255).astype(np.uint8)


def _features(texts: pa.Array, rare: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for all texts, without most places of fewer than `rare` texts: those whose group of places, by
    SKETCH bits, is met in fewer. That takes a second pass but keeps what is held small."""
    often = np.zeros(1 << SKETCH, np.int32)
    low = (1 << SKETCH) - 1
    if rare > 1:
        for _, place, _ in _chunks(texts):
            often += np.bincount(place & low, minlength=1 << SKETCH).astype(np.int32)
    out = [(row[m], place[m], n[m]) for row, place, n in _chunks(texts) for m in [often[place & low] >= rare if rare > 1 else slice(None)]]
    if not out:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _levels(row: np.ndarray, place: np.ndarray, n: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each feature and level; columns count LEVELS for each known place."""
    i = np.minimum(np.searchsorted(known, place), max(len(known) - 1, 0))
    hit = known[i] == place if len(known) else np.zeros(len(place), bool)
    row, i, n = row[hit], i[hit].astype(np.int32), n[hit]
    parts = [(row[n >= least], i[n >= least] * np.int32(len(LEVELS)) + np.int32(k)) for k, least in enumerate(LEVELS)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def swapped(text: str, groups: list[list[str]] = IDENTITY) -> str:
    """`text` with each identity term replaced by the next of its group."""
    after = {a: b for g in groups for a, b in zip(g, g[1:] + g[:1], strict=True)}
    letter = r"A-Za-z\x80-\U0010ffff"
    return re.sub(rf"(?<![{letter}])({'|'.join(sorted(after, key=len, reverse=True))})(?![{letter}])", lambda m: after[m[0].lower()], text, flags=re.I | re.A)


def fit(texts: pa.Array, labels: list[int], swap: float = SWAP, groups: list[list[str]] = IDENTITY, sparse: float = SPARSE) -> Model:
    y = np.asarray(labels, float)
    n = len(y)
    if len(set(labels)) < 2:
        share = y.mean() if n else 0.5
        return Model(np.zeros(0, np.int64), np.zeros((0, len(LEVELS))), float(np.log((share + 0.01) / (1.01 - share))))
    row, place, count = _features(texts, RARE)
    known, df = np.unique(place, return_counts=True)
    other = {i: new for i, t in enumerate(texts) if (new := swapped(old := t.as_py(), groups)) != old}
    moved = np.array(list(other), np.int64)
    orow, oplace, ocount = _features(pa.array(list(other.values()), pa.string()))
    known = np.unique(np.concatenate([known[df >= RARE], np.intersect1d(oplace, known)]))
    del df
    r, c = _levels(row, place, count, known)
    del row, place, count
    # a text minus its swapped copy
    same = np.isin(r, moved)
    dr, dc = _levels(orow, oplace, ocount, known)
    dr, dc, dv = np.concatenate([r[same], moved[dr]]), np.concatenate([c[same], dc]), np.concatenate([np.ones(same.sum()), -np.ones(len(dr))])
    m = len(known) * len(LEVELS)
    weight, bias = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    used = np.zeros(m, bool)
    for _ in range(8):
        g = np.bincount(c, (1 / (1 + np.exp(-(np.bincount(r, weight[c], n) + bias))) - y)[r], m) / n
        if len(dr):
            g += swap * np.bincount(dc, dv * np.bincount(dr, dv * weight[dc], n)[dr], m) / n
        enter = ~used & (np.abs(g) > sparse * 1.01)
        if not enter.any():
            break
        # the largest half of the violations first: many of the others vanish with them
        used |= enter & (np.abs(g) >= np.median(np.abs(g[enter])))
        weight, bias = _descend(y, used, (r, c), (dr, dc, dv), weight, bias, swap, sparse)
    # weights of the chosen features are then freed of most of the penalty, which had shrunk them
    weight, bias = _descend(y, weight != 0, (r, c), (dr, dc, dv), weight, bias, swap, sparse / 8)
    w = weight.reshape(-1, len(LEVELS))
    keep = np.abs(w).sum(1) > 0
    return Model(known[keep], w[keep], float(bias))


def _descend(y: np.ndarray, used: np.ndarray, x: tuple, d: tuple, weight: np.ndarray, bias: float, swap: float, sparse: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient steps on the features in use."""
    n, cols = len(y), np.flatnonzero(used)
    at = np.full(len(used), -1)
    at[cols] = np.arange(len(cols))
    mine, theirs = used[x[1]], used[d[1]]
    r, c = x[0][mine], at[x[1][mine]]
    dr, dc, dv = d[0][theirs], at[d[1][theirs]], d[2][theirs]
    m, bound = len(cols), 1.0

    def smooth(w: np.ndarray, b: float) -> tuple[float, np.ndarray, np.ndarray]:
        z = np.bincount(r, w[c], n) + b
        gap = np.bincount(dr, dv * w[dc], n)
        return float(np.mean(np.logaddexp(0, z) - y * z) + swap * np.mean(gap * gap) / 2), z, gap

    w, b = weight[cols], bias
    u, ub, t, last = w, b, 1.0, np.inf
    for _ in range(STEPS):
        f, z, gap = smooth(u, ub)
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.bincount(c, e[r], m) + swap * np.bincount(dc, dv * gap[dr], m) / n
        gb = e.sum()
        while True:  # steps get smaller until the quadratic bound holds
            new, nb = u - g / bound, ub - gb / bound
            new = np.sign(new) * np.maximum(np.abs(new) - sparse / bound, 0)
            dw, db = new - u, nb - ub
            fn = smooth(new, nb)[0]
            if fn <= f + g @ dw + gb * db + bound / 2 * (dw @ dw + db * db) + 1e-12 or bound > 1e12:
                break
            bound *= 2
        now = fn + sparse * np.abs(new).sum()
        t2 = 1.0 if now > last else (1 + np.sqrt(1 + 4 * t * t)) / 2  # start anew if momentum went too far
        u, ub = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
        if abs(last - now) < 1e-8:
            break
        last, bound = now, bound * 0.95
    out = np.zeros(len(used))
    out[cols] = w
    return out, b


def score(docs: DataFrame, model: Model, col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with a double column `out`, in place of one of that name; the few weights that aren't 0 are broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.scores(pa.array(texts.fillna(""), pa.string())))

    return docs.withColumn(out, scored(F.col(col).cast("string")))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on the labelled rows outside the held-out fold (crc32(doc_id) mod 5 is 0)."""
    return fitted(*training_rows(docs, labels, "toxic", remainder("doc_id", 5) != 0), fit)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def harmless(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that the classifier doesn't reject."""
    return score(docs, model, out="__score").where("__score < 0.5").drop("__score")
