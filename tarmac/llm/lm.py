"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and mapped into memory by workers.

Words. One pass counts word hashes; a task per shard sorts those of its range and publishes them with their
counts. A word's number is its place in the shard times the number of shards, plus the shard, so that
numbers need no pass of their own.

N-grams. A second pass turns texts into word numbers and counts the n-grams of a block of tokens at a time. What
leaves it are, for each shard, sorted blocks of differences in compressed byte planes, a few bytes an n-gram. The
shard follows from the context and three bits of the word, so that even a context that holds a third of all tokens
is spread, and the number of shards follows the bytes of text. A task per shard merges blocks, publishes the
sorted hashes with their counts, and passes down what the next order needs: for each shorter n-gram the number of
different words before it, and for each context its total and how many words follow it once, twice, or more
often. An n-gram and the context of the same words are one entry. Lower orders are merged in PARTS, one after the
other, so that little of what is passed down lies on disk twice.

Scoring. Tasks map the arrays of a shard into memory, one file each, and look up the sorted hashes of a block of
texts shard by shard; the model is neither broadcast nor copied. A worker keeps its maps, and blocks grow with the number of
shards, so that opened files don't grow with the square of the bytes (up to MAPS shards and MOST_BLOCK tokens, some hundred
GB; beyond, each block opens its files again). The shared folder must therefore be mounted (a file: path).

Clashes. Words are told apart by 64-bit hashes: of w different words, some two clash with probability w**2 / 2**65. N-grams
are told apart by 64 bits of which SHARD_BITS say the shard: of a context with f different followers, some two clash with
probability f**2 / 2**43 at most.

Null or empty texts consist of the end token. Texts in both folds are scored by the same model.
Words outside training get the uniform share of the lowest order. With no training text at all,
every token has that share with V = 0.
"""

from __future__ import annotations

import glob
import mmap
import os
import shutil
import sys
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import kept, mounted, publish, remainder, shared_dir, shards, table, text_bytes
from tarmac.llm.text import U, hashed, mix

END = U(0x1234F00DCAFE5678)
#: Numbers of what stands before a text, and of words outside training.
BOS, UNKNOWN = U(0), U(1 << 62)
#: Tokens that are counted and scored at once, and bytes of text for each shard.
BLOCK, SCORED, SHARD_BYTES = 1 << 20, 1 << 19, 12 << 20
#: Words in the longest n-gram of the registered query; parts in which a lower order is merged.
ORDER, PARTS = 3, 8
#: Mapped files that a worker keeps. Where a map needs no open file (Python 3.13) only the system's limit on maps counts.
MAPS, UNTRACKED = (20_000, {"trackfd": False}) if sys.version_info >= (3, 13) else (500, {})
#: Tokens that a look into a shard is to serve, and most tokens of a block.
SERVED, MOST_BLOCK = 64, 1 << 23
#: Leading bits of a hash that say the shard.
SHARD_BITS = 22
ROWS = "part int, shard int, kind string, data binary, few array<long>"


def block_for(n_shards: int, least: int) -> int:
    """Tokens of a block: at least `least`, more where there are many shards, so that looks into shards grow with the tokens."""
    return max(least, min(SERVED * n_shards, MOST_BLOCK))


def tokens(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Like text.hashed(), with the end token after the words of each row."""
    for a, b, h, n in hashed(col):
        ends = np.cumsum(n + 1) - 1
        tok = np.empty(len(h) + b - a, np.uint64)
        keep = np.ones(len(tok), bool)
        keep[ends] = False
        tok[keep], tok[ends] = h, END
        yield a, b, tok, n + 1


def grams(ids: np.ndarray, n: np.ndarray, order: int) -> list[np.ndarray]:
    """Columns of the `order` words that end at each token; a text begins after BOS."""
    at = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
    out = [ids]
    for k in range(1, order):
        before = np.full(len(ids), BOS)
        before[k:] = np.where(at[k:] >= k, ids[:-k], BOS) if len(ids) > k else before[k:]
        out.append(before)
    return out[::-1]


def keys_of(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of each n-gram of two words or more; its leading bits follow from the context and three bits of the word."""
    h = np.zeros(len(columns[0]), np.uint64)
    for k, c in enumerate(columns):
        context, h = h, mix(h * U(0xD6E8FEB86659FD93) + c + U(k + 1))
    spread = mix(context ^ ((columns[-1] & U(7)) * U(0xA24BAED4963EE407)))
    low = U((1 << (64 - SHARD_BITS)) - 1)
    return (spread & ~low) | (h & low)


def shard_of(key: np.ndarray, n_shards: int) -> np.ndarray:
    """Shards are ranges of hashes."""
    return ((key >> U(64 - SHARD_BITS)) * U(n_shards) >> U(SHARD_BITS)).astype(np.int64)


def merged(columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Different rows of `columns` in order, and the sum of each of `values` over equal rows."""
    if not len(columns[0]):
        return columns, values
    keys, used = [np.zeros(len(columns[0]), np.uint64)], 0
    for c in columns:  # as many columns in one key as have room
        bits = int(c.max()).bit_length()
        if used + bits > 64:
            keys, used = [*keys, np.zeros(len(c), np.uint64)], 0
        keys[-1] = (keys[-1] << U(bits) if bits < 64 else U(0)) | c
        used += bits
    by = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(len(by), bool)
    new[1:] = False
    for k in keys:
        k = k[by]
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    at = by[first]
    return [c[at] for c in columns], [np.add.reduceat(v[by], first) for v in values]


def packed(columns: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    """Sorted columns as differences, and values as they are, in compressed byte planes."""
    n = len(columns[0])
    d = np.stack([np.diff(c.view(np.int64), prepend=0) for c in columns])
    wide = np.concatenate([((d << 1) ^ (d >> 63)).view(np.uint64), np.stack(values).astype(np.uint64)])
    planes = np.array([-(-int(w.max()).bit_length() // 8) if n else 0 for w in wide], np.uint8)
    raw = b"".join(np.ascontiguousarray(w.view(np.uint8).reshape(n, 8).T[:p]).tobytes() for w, p in zip(wide, planes, strict=True))
    return np.array([n, len(columns), len(wide)], np.int64).tobytes() + planes.tobytes() + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpacked(data: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    n, n_columns, width = np.frombuffer(data, np.int64, 3).tolist()
    planes = np.frombuffer(data, np.uint8, width, 24)
    size = n * int(planes.sum())
    raw = np.frombuffer(pa.decompress(data[24 + width :], size, "zstd", asbytes=True) if size else b"", np.uint8)
    out, at = [], 0
    for p in planes.tolist():
        w = np.zeros((n, 8), np.uint8)
        w[:, :p] = raw[at : at + n * p].reshape(p, n).T
        out.append(w.view(np.uint64).ravel())
        at += n * p
    back = lambda z: np.cumsum((z >> U(1)).view(np.int64) ^ -(z & U(1)).view(np.int64)).view(np.uint64)
    return [back(z) for z in out[:n_columns]], out[n_columns:]


def joined(blobs) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Several packed blocks, one after the other."""
    parts = [unpacked(b) for b in blobs]
    return tuple([np.concatenate(c) for c in zip(*(p[k] for p in parts), strict=True)] for k in (0, 1))


def blocks(kind: str, columns: list[np.ndarray], values: list[np.ndarray], n_shards: int) -> list[dict]:
    """ROWS for the shards of sorted rows."""
    sh = ((columns[0].view(np.int64) - 1) % n_shards) * (columns[0] != BOS) if len(columns) == 1 else shard_of(keys_of(columns), n_shards)
    by = np.argsort(sh, kind="stable")
    cut = np.searchsorted(sh[by], np.arange(n_shards + 1))
    return [{"part": s % PARTS, "shard": s, "kind": kind, "data": packed([c[rows] for c in columns], [v[rows] for v in values]), "few": None} for s in range(n_shards) if len(rows := by[cut[s] : cut[s + 1]])]


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("kind", pa.string()), ("data", pa.binary()), ("few", pa.list_(pa.int64()))]))


@dataclass
class Arrays:
    """Published tables: a file for each table and shard, with sorted hashes and small numbers for each."""

    path: str
    n_shards: int

    def put(self, name: str, s: int, keys: np.ndarray, values: list[np.ndarray]) -> None:
        """Numbers below 255 take a byte; rows with a larger one are written again in full."""
        wide = np.stack(values, 1).astype(np.uint64) if len(values) else np.zeros((len(keys), 0), np.uint64)
        large = np.flatnonzero((wide >= 255).any(1))
        small = np.zeros(-(-wide.size // 8) * 8, np.uint8)
        small[: wide.size] = np.minimum(wide, U(255)).astype(np.uint8).ravel()
        publish(f"{self.path}/{name}-{s}", np.array([len(keys), len(wide), wide.shape[1], len(large)], np.int64), keys, small, large.astype(np.int64), wide[large])

    def get(self, name: str, s: int) -> tuple | None:
        """A table's arrays in mapped memory; a worker keeps the last MAPS that it opened, so that blocks of tokens share them."""
        maps, path = kept(("maps", self.path), OrderedDict), f"{self.path}/{name}-{s}"
        if path in maps:
            maps.move_to_end(path)
        elif os.path.exists(path):
            maps[path] = self._mapped(path)
            if len(maps) > MAPS:
                maps.popitem(last=False)
        return maps.get(path)

    @staticmethod
    def _mapped(path: str) -> tuple:
        with open(path, "rb") as f:
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **UNTRACKED)
        n, rows, width, m = np.frombuffer(held, np.int64, 4).tolist()
        at = 32 + 8 * n
        after = at + -(-rows * width // 8) * 8
        return np.frombuffer(held, np.uint64, n, 32), np.frombuffer(held, np.uint8, rows * width, at).reshape(rows, width), np.frombuffer(held, np.int64, m, after), np.frombuffer(held, np.uint64, m * width, after + 8 * m).reshape(m, width)

    @staticmethod
    def numbers(held: tuple, at: np.ndarray) -> np.ndarray:
        """Rows `at` of a table, as long integers."""
        _, small, large, full = held
        out = small[at].astype(np.int64)
        more = np.flatnonzero((out == 255).any(1)) if len(large) else at[:0]
        out[more] = full[np.searchsorted(large, at[more])]
        return out

    def find(self, name: str, key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key in its shard, -1 where there's none, and its numbers, 0 where there's none."""
        by = np.argsort(key)
        sorted_, place, out = key[by], np.full(len(key), -1), np.zeros((len(key), width), np.int64)
        sh = shard_of(sorted_, self.n_shards)
        cut = np.searchsorted(sh, np.arange(self.n_shards + 1))
        for s in np.flatnonzero(np.diff(cut)):
            held, rows = self.get(name, int(s)), by[cut[s] : cut[s + 1]]
            if held is not None and len(held[0]):
                i = np.minimum(np.searchsorted(held[0], sorted_[cut[s] : cut[s + 1]]), len(held[0]) - 1)
                hit = held[0][i] == sorted_[cut[s] : cut[s + 1]]
                place[rows[hit]] = i[hit]
                out[rows[hit]] = self.numbers(held, i[hit])
        return place, out

    def words(self, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word, UNKNOWN outside training, and how often it occurs there."""
        uniq, back = np.unique(tok, return_inverse=True)
        place, n = self.find("words", uniq, 1)
        ids = np.where(place >= 0, place * self.n_shards + shard_of(uniq, self.n_shards) + 1, 0).astype(np.uint64)
        ids[place < 0] = UNKNOWN
        return ids[back], n[back, 0]

    def unigrams(self, ids: np.ndarray) -> np.ndarray:
        """(words before, total, followers once, twice, more often) of each word number; BOS is the last row of shard 0."""
        uniq, back = np.unique(ids, return_inverse=True)
        out = np.zeros((len(uniq), 5), np.int64)
        known = uniq != UNKNOWN
        sh = np.where(uniq == BOS, 0, (uniq.view(np.int64) - 1) % self.n_shards)
        for s in np.unique(sh[known]):
            held = self.get("n1", int(s))
            if held is not None:
                rows = np.flatnonzero(known & (sh == s))
                at = np.where(uniq[rows] == BOS, len(held[1]) - 1, (uniq[rows].view(np.int64) - 1) // self.n_shards)
                out[rows] = self.numbers(held, at)
        return out[back]


def count_words(n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(shard_of(word, n_shards), np.arange(n_shards + 1))
            return _arrow([{"part": 0, "shard": s, "kind": "w", "data": packed([word[a:b]], [n[a:b]]), "few": None} for s, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b])

        for batch in batches:
            for _, _, tok, _ in tokens(batch.column(0)):
                held.append(tok)
                if sum(map(len, held)) >= BLOCK:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return run


def merge_words(arrays: Arrays):
    """Publishes the words of one shard with their counts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        (word,), (n,) = merged(*joined(pdf.data))
        arrays.put("words", int(pdf.shard.iloc[0]), word, [n])
        return pd.DataFrame({"v": [len(word)], "toks": [int(n.sum())]})

    return run


def count_grams(arrays: Arrays, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, _ = arrays.words(np.concatenate([x[0] for x in held]))
            columns = grams(ids, np.concatenate([x[1] for x in held]), order)
            return _arrow(blocks("n", *merged(columns, [np.ones(len(ids), np.int64)]), arrays.n_shards))

        for batch in batches:
            for _, _, tok, n in tokens(batch.column(0)):
                held.append((tok, n))
                size += len(tok)
                if size >= block_for(arrays.n_shards, BLOCK):
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def counts_of_counts(n: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)[1:5].tolist()


def passed_down(columns: list[np.ndarray], n: np.ndarray, n_shards: int) -> list[dict]:
    """What the next order needs of sorted n-grams and their counts."""
    rows = blocks("n", *merged(columns[1:], [np.ones(len(n), np.int64)]), n_shards)
    new = np.zeros(len(n), bool)
    new[:1] = True
    for c in columns[:-1]:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    stats = [np.add.reduceat(x.astype(np.int64), first) for x in (n, n == 1, n == 2, n > 2)]
    return rows + blocks("c", [c[first] for c in columns[:-1]], stats, n_shards)


def _rows(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "shard", "kind", "data", "few"])


def merge_top(arrays: Arrays, order: int):
    """Merges the longest n-grams of one shard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        columns, (n,) = merged(*joined(pdf.data))
        key = keys_of(columns)
        by = np.argsort(key)
        arrays.put(f"n{order}", int(pdf.shard.iloc[0]), key[by], [n[by]])
        return _rows([{"part": -1, "shard": 0, "kind": "few", "data": b"", "few": counts_of_counts(n)}, *passed_down(columns, n, arrays.n_shards)])

    return run


def _entries(pdf: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Words of each entry, and (words before, total, followers once, twice, more often)."""
    sides = []
    for kind, width, at in (("n", 1, 0), ("c", 4, 1)):
        mine = pdf.data[pdf.kind == kind]
        if len(mine):
            columns, values = joined(mine)
            full = [np.zeros(len(columns[0]), np.int64) for _ in range(5)]
            full[at : at + width] = [v.view(np.int64) for v in values]
            sides.append((columns, full))
    return merged(*(([np.concatenate(c) for c in zip(*(s[k] for s in sides), strict=True)]) for k in (0, 1)))


def merge_lower(arrays: Arrays, k: int):
    """Merges n-grams of k words, and contexts of as many, of one shard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        columns, values = _entries(pdf)
        key = keys_of(columns)
        by = np.argsort(key)
        arrays.put(f"n{k}", int(pdf.shard.iloc[0]), key[by], [v[by] for v in values])
        some = values[0] > 0  # what begins every text is a context alone
        columns, n = [c[some] for c in columns], values[0][some]
        return _rows([{"part": -1, "shard": 0, "kind": "few", "data": b"", "few": counts_of_counts(n)}, *passed_down(columns, n, arrays.n_shards)])

    return run


def merge_unigrams(arrays: Arrays):
    """Publishes single words of one shard by their place among its words."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf.shard.iloc[0])
        (ids,), values = _entries(pdf)
        words = arrays.get("words", s)
        n = len(words[0]) if words else 0
        at = np.where(ids == BOS, n, (ids.view(np.int64) - 1) // arrays.n_shards)
        full = [np.zeros(n + (s == 0), np.int64) for _ in values]
        for f, v in zip(full, values, strict=True):
            f[at] = v
        arrays.put("n1", s, np.zeros(0, np.uint64), full)
        before = full[0]
        times = [int((before == 1).sum()), int((before == 2).sum()), int((before > 2).sum())]
        return pd.DataFrame({"total": [int(before.sum())], "few": [counts_of_counts(before) + times]})

    return run


def discount(few: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and more, from how many n-grams occur 1 to 4 times (Chen and Goodman).

    Where that estimate isn't defined, or leaves the range from 0 to the count, it is 0.5, 1, 1.5.
    """
    n1, n2, n3, n4 = few
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0
    d = [k - (k + 1) * y * m / n if n else -1 for k, n, m in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [x if 0 < x < k else k / 2 for k, x in enumerate(d, 1)]


@dataclass
class Model:
    """Where the arrays are, and the few numbers that hold for all of them."""

    arrays: Arrays
    order: int
    n_tokens: int
    n_words: int
    total: int
    discounts: dict[int, list[float]]
    left: float  # mass that the lowest order leaves to the uniform distribution

    def score(self, tok: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token: how often it occurs in training, and its probability."""
        ids, times = self.arrays.words(tok)
        starts = np.cumsum(n) - n
        columns = grams(ids, n, self.order)
        stats = self.arrays.unigrams(np.concatenate((ids, [BOS])))
        taken = lambda c, k: np.array([0.0, *self.discounts[k]])[np.minimum(c, 3)]
        before = stats[:-1, 0]
        p = (before - taken(before, 1)) / max(self.total, 1) + self.left / (self.n_words + 1)
        for k in range(2, self.order + 1):
            # the context of a token is the entry of the words that end at the token before it
            context = np.roll(stats[:-1, 1:], 1, 0)
            context[starts] = stats[-1, 1:]
            last = k == self.order
            own = [np.concatenate((c, [BOS])) for c in columns[-k:]]
            _, stats = self.arrays.find(f"n{k}", keys_of(own), 1 if last else 5)
            c, total = stats[:-1, 0], context[:, 0]
            left = context[:, 1:] @ np.array(self.discounts[k])
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(total > 0, (c - taken(c, k) + left * p) / total, p)
        return times, p


def fit(docs: DataFrame, col: str = "text", order: int = 2) -> Model:
    """Counts every text of `docs` and publishes the model in the shared folder.

    order: words in the longest n-gram, at least 2.
    """
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")  # a step's shuffle files go when its table is written
    try:
        return _fit(docs.select(F.col(f"`{col}`").cast("string").alias("text")), order)
    finally:
        spark.conf.set(setting, before)


def _fit(texts: DataFrame, order: int) -> Model:
    spark = texts.sparkSession
    path = shared_dir(spark, "ngram-model")
    local = mounted(path)
    os.makedirs(f"{local}/arrays")
    size = text_bytes(texts)
    arrays = Arrays(f"{local}/arrays", shards(size, max(SHARD_BYTES, size >> SHARD_BITS)))
    found = texts.mapInArrow(count_words(arrays.n_shards), ROWS).groupBy("shard").applyInPandas(merge_words(arrays), "v long, toks long")
    n_words, n_tokens = (x or 0 for x in found.agg(F.sum("v"), F.sum("toks")).first())
    few_of = lambda rows, n: [x or 0 for x in rows.agg(*[F.sum(F.col("few")[i]) for i in range(n)]).first()]
    out, discounts = f"{path}/order{order}", {}
    texts.mapInArrow(count_grams(arrays, order), ROWS).groupBy("shard").applyInPandas(merge_top(arrays, order), ROWS).write.partitionBy("part").parquet(out)
    for k in range(order - 1, 0, -1):
        rows = spark.read.schema(ROWS).parquet(out)
        discounts[k + 1] = discount(few_of(rows.where("part = -1"), 4))
        if k == 1:
            break
        below = f"{path}/order{k}"
        for part in range(PARTS):
            mine = spark.read.schema(ROWS).parquet(out).where(F.col("part") == part)
            mine.groupBy("shard").applyInPandas(merge_lower(arrays, k), ROWS).write.partitionBy("part").mode("append").parquet(below)
            for done in glob.glob(f"{local}/{os.path.basename(out)}/part={part}"):
                shutil.rmtree(done)
        out = below
    sums = spark.read.schema(ROWS).parquet(out).where("part >= 0").groupBy("shard").applyInPandas(merge_unigrams(arrays), "total long, few array<long>")
    total, *few = (x or 0 for x in sums.agg(F.sum("total"), *[F.sum(F.col("few")[i]) for i in range(7)]).first())
    for k in range(2, order + 1):
        shutil.rmtree(f"{local}/order{k}", ignore_errors=True)
    discounts[1] = discount(few[:4])
    left = sum(d * t for d, t in zip(discounts[1], few[4:], strict=True)) / total if total else 1.0
    return Model(arrays, order, n_tokens, n_words, total, discounts, left)


ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def score(docs: DataFrame, model: Model, col: str = "text") -> DataFrame:
    """`docs` without its text (and columns of these names), with n_tokens, n_known, train_tokens, base_score, score and perplexity.

    score is the log10 probability of the text under the model, perplexity is 10 ** (-score / n_tokens).
    """
    rest = [c for c in docs.columns if c not in (col, *ADDED)]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema.add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double").add("perplexity", "double")
    names, most = list(schema.names), block_for(model.arrays.n_shards, SCORED)

    def scored(tok: np.ndarray, n: np.ndarray) -> list[pa.Array]:
        c, p = model.score(tok, n)
        first = np.cumsum(n) - n
        base = np.log10((c + 0.5) / (model.n_tokens + 0.5 * (model.n_words + 1)))
        s = np.add.reduceat(np.log10(p), first)
        return [pa.array(n, pa.int64()), pa.array(np.add.reduceat((c > 0).astype(np.int64), first)), pa.array(np.full(len(n), model.n_tokens), pa.int64()), pa.array(np.add.reduceat(base, first)), pa.array(s), pa.array(10.0 ** np.minimum(-s / n, 300))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            other = batch.select(list(range(1, len(rest) + 1)))
            start, end, held, size = 0, 0, [], 0
            for _, b, tok, n in tokens(batch.column(0)):
                held.append((tok, n))
                size, end = size + len(tok), b
                if size >= most or b == batch.num_rows:
                    made = scored(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    yield pa.RecordBatch.from_arrays([*other.slice(start, end - start).columns, *made], names=names)
                    start, held, size = end, [], 0

    return docs.select(F.col(f"`{col}`").cast("string"), *[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def held_out(col: str | Column = "doc_id") -> Column:
    return F.coalesce(remainder(col, 5) == 1, F.lit(False))


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.where(~held_out()), order=ORDER)
    return score(docs.withColumn("held_out", held_out()), model)
