"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Texts become sets of hashed n-grams of words (A-Z in lower case, split at white space); fewer words
than n make one n-gram. Texts with equal sets are a class and go on as one. Band and row counts come
from the threshold and the recall wanted at it. Classes that share a band hash are a bucket; connected
buckets are a group. Full sets are compared either bucket by bucket, a pair counting in the first band that
it shares, or group by group, whichever ships fewer texts: dense groups (many near copies) are
compared as wholes, wide ones (chance collisions in boilerplate) by buckets. Both give the same links.
Buckets and groups are cut by hash into blocks of about BLOCK classes or BLOCK_BYTES of text, whichever is less, and tiles
are pairs of blocks; a task compares the classes of one tile that share a band hash, counts the links and passes on a spanning forest of them. So no pair of rows
is emitted or dropped, a copy costs nothing, and a large group is spread over many tasks.

One row per document: class_id (smallest doc_id with that set), n_links (other documents with a
similarity of at least the threshold, copies included), component_id (smallest doc_id reachable by
links), kept (whether its doc_id is that smallest one).
Documents without words and rows without doc_id link with nothing and are kept. Repeated rows are
copies of each other; rows of one doc_id with different texts are linked as texts, each of its own class.
A class is named by a 63-bit hash of its set, and its text, one for each class, is found by doc_id and a 64-bit hash
of the text, so that many rows of one id cost what others do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import table, written
from tarmac.llm.components import components
from tarmac.llm.text import BASE, U, hashed, mix

N, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9995, 64
BLOCK, BLOCK_BYTES, COLUMNS = 512, 16 << 20, 2048


def bands_for(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): most rows, so fewest false candidates, with at most `most` hashes for that recall."""
    found = (1, 1)
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows > most:
            break
        found = (bands, rows)
    return found


def shingles(col: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted set of n-gram hashes of each row."""
    for a, b, h, size in hashed(col):
        at = np.concatenate(([0], np.cumsum(size)))
        if len(h) >= n:
            g = h[: len(h) - n + 1]
            for k in range(1, n):
                g = mix(g * BASE + h[k : len(h) - n + 1 + k])
        for i in range(b - a):
            if size[i] >= n:
                yield np.unique(g[at[i] : at[i + 1] - n + 1])
            elif size[i]:
                one = h[at[i] : at[i] + 1]
                for k in range(1, size[i]):
                    one = mix(one * BASE + h[at[i] + k : at[i] + k + 1])
                yield one ^ U(size[i])
            else:
                yield np.zeros(0, np.uint64)


def node_of(s: np.ndarray) -> int:
    """63-bit name of a set."""
    spread = mix(s)
    both = np.array([np.bitwise_xor.reduce(spread)]) + spread.sum(dtype=np.uint64, keepdims=True) * BASE + U(len(s))
    return int(mix(both)[0]) >> 1


def _signer(bands: int, rows: int):
    rng = np.random.default_rng(3)
    a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | U(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def sign(sets: list[np.ndarray]) -> np.ndarray:
        """Band hashes of non-empty sets."""
        flat, first = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
        out = np.zeros((len(sets), bands), np.uint64)
        for j in range(bands * rows):
            m = np.minimum.reduceat(((flat * a[j] + b[j]) >> U(32)).astype(np.uint32), first)
            out[:, j // rows] = mix(out[:, j // rows] * BASE + m)
        return out

    return sign


def signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, node, bands, key, bytes) of each row; node is null where nothing can be linked, key and bytes are hash and size of the text."""
    sign = _signer(bands, rows)
    names = ["doc_id", "node", "bands", "key", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[np.ndarray] = []
            first, size = 0, 0
            ids = batch.column(0)

            def flush(a: int, held: list) -> pa.RecordBatch:
                part = ids.slice(a, len(held))
                known = np.array([len(s) > 0 for s in held]) & ~part.is_null().to_numpy(zero_copy_only=False)
                sigs = sign([s for s, k in zip(held, known, strict=True) if k]) if known.any() else np.zeros((0, bands), np.uint64)
                nodes = iter([node_of(s) for s, k in zip(held, known, strict=True) if k])
                offsets = np.concatenate(([0], np.cumsum(known * bands))).astype(np.int32)
                return pa.RecordBatch.from_arrays([part, pa.array([next(nodes) if k else None for k in known], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(sigs.view(np.int64).ravel())), batch.column(2).slice(a, len(held)), batch.column(3).slice(a, len(held))], names)

            for s in shingles(batch.column(1), n):
                held.append(s)
                size += len(s)
                if size > 1 << 18:
                    yield flush(first, held)
                    first, held, size = first + len(held), [], 0
            if held:
                yield flush(first, held)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text), F.octet_length(text).cast("long")).mapInArrow(run, "doc_id long, node long, bands array<long>, key long, bytes long")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from products of 0/1 matrices over shared n-grams."""
    n = len(sets)
    u, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = count[col] > 1
    row, col = row[shared], (np.cumsum(count > 1) - 1)[col[shared]]
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    out = np.zeros((n, n), np.float32)
    width = int(col[-1]) + 1 if len(col) else 0
    for a in range(0, width, COLUMNS):
        i, j = np.searchsorted(col, [a, a + COLUMNS])
        m = np.zeros((n, min(COLUMNS, width - a)), np.float32)
        m[row[i:j], col[i:j] - a] = 1
        out += m @ m.T
    return out


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links (i, j)."""
    top = list(range(n))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    kept = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            top[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _compare(n: int, threshold: float):
    """Links of one tile: rows (node, other, links); other is null in a row that counts links."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = list(shingles(pa.array(pdf.text, pa.string()), n))
        if len(sets) < 2:
            return pd.DataFrame({"node": [], "other": [], "links": []}, dtype="Int64")
        sizes = np.array([len(s) for s in sets])
        both = intersections(sets)
        close = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6
        sig = np.stack(pdf.bands.to_numpy())
        block, a, b = pdf.block.to_numpy(), pdf.a.iloc[0], pdf.b.iloc[0]
        # in a tile of two blocks, links within one of them are counted in its own tile
        close &= np.triu(np.ones_like(close), 1) if a == b else (block[:, None] == a) & (block[None, :] == b)
        i, j = np.nonzero(close)
        meet, band = np.zeros(len(i), bool), pdf.band.iloc[0]
        for k in range(0, len(i), 1 << 16):
            same = sig[i[k : k + 65536]] == sig[j[k : k + 65536]]
            meet[k : k + 65536] = same.any(1) & ((band < 0) | (same.argmax(1) == band))
        i, j = i[meet], j[meet]
        node, copies = pdf.node.to_numpy(), pdf.copies.to_numpy()
        links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
        some = np.flatnonzero(links)
        edges = forest(i, j, len(node))
        return pd.DataFrame({"node": np.concatenate([node[some], node[[e[0] for e in edges]]]), "other": pd.array([None] * len(some) + [node[e[1]] for e in edges], "Int64"), "links": np.concatenate([links[some], np.zeros(len(edges))]).astype(np.int64)})

    return run


def _tiles(classes: DataFrame) -> DataFrame:
    """Candidates among classes (node, bands, bytes): (key, band, a, b, node, block), with band -1 where a whole group is compared."""
    exploded = classes.select("node", "bytes", F.posexplode("bands").alias("band", "hash"))
    buckets = exploded.groupBy("band", "hash").agg(F.min("node").alias("least"), F.count("*").alias("n"), F.sum("bytes").alias("all")).where("n > 1")
    inside = written(exploded.join(buckets, ["band", "hash"]), "buckets")
    groups = written(components(inside.where("node <> least").select(F.col("node").alias("src"), F.col("least").alias("dst"))).join(classes.select(F.col("node").alias("id"), "bytes"), "id"), "groups")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all") / BLOCK_BYTES)).cast("int")
    # bytes that a group ships as one, and bucket by bucket; the members of a bucket are all in one group
    each = inside.where("node = least").join(groups.select("id", "component_id"), F.col("node") == F.col("id")).groupBy("component_id").agg(F.sum(F.col("all") * blocks).alias("apart"))
    sizes = groups.groupBy("component_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("all")).withColumn("blocks", blocks).join(each, "component_id").withColumn("whole", F.col("all") * F.col("blocks") <= F.col("apart"))
    member = groups.join(sizes.select("component_id", "blocks", "whole"), "component_id")
    whole = member.where("whole").select(F.col("component_id").alias("key"), F.lit(-1).alias("band"), F.col("id").alias("node"), "blocks")
    wide = member.where("not whole").select(F.col("id").alias("node")).join(inside, "node").select(F.col("hash").alias("key"), "band", "node", blocks.alias("blocks"))
    placed = whole.union(wide).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    return placed.select("key", "band", "node", "block", other).select("key", "band", F.least("block", "o").alias("a"), F.greatest("block", "o").alias("b"), "node", "block")


def _linked(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of each row, and (node, class_id, n_links, component_id, keeper) of each class.

    keeper: of the classes of a component, the one of the smallest doc_id, then node.
    """
    bands, rows = bands_for(threshold, recall)
    sig = written(signed(docs, n, bands, rows), "signed")
    first = F.min(F.struct("doc_id", "key", "bytes"))
    classes = sig.where("node is not null").groupBy("node").agg(first.alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = written(classes.select("node", F.col("first.doc_id").alias("class_id"), F.col("first.key").alias("text_key"), F.col("first.bytes").alias("bytes"), "copies", "bands"), "classes")
    text = F.col("text").cast("string")
    # a text for each class: rows of one id differ by the hash of their text, repeated rows are taken once
    texts = docs.select(F.col("doc_id").cast("long").alias("class_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).groupBy("class_id", "text_key").agg(F.first("text").alias("text"))
    candidates = _tiles(classes.select("node", "bands", "bytes")).join(classes.drop("bytes"), "node")
    found = candidates.join(texts, ["class_id", "text_key"]).groupBy("key", "band", "a", "b").applyInPandas(_compare(n, threshold), "node long, other long, links long")
    found = written(found, "links")
    counts = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    named = linked.join(classes.select(F.col("node").alias("id"), "class_id"), "id")
    first = named.groupBy("component_id").agg(F.min(F.struct("class_id", "id")).alias("first"))
    named = named.join(first, "component_id").select(F.col("id").alias("node"), "first")
    result = classes.drop("bands", "text_key", "bytes").join(counts, "node", "left").join(named, "node", "left")
    return sig.select("doc_id", "node"), result.select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first.class_id", "class_id").alias("component_id"), F.coalesce(F.col("first.id") == F.col("node"), F.lit(True)).alias("keeper"))


def link_documents(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, component_id, kept) of each row of docs (doc_id, text)."""
    sig, result = _linked(docs, n, threshold, recall)
    out = sig.join(result, "node", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _with_node(rows: DataFrame, n: int) -> DataFrame:
    """rows (id, row, text) with node: the class of each text, null without words."""
    names = ["id", "row", "text", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [node_of(s) if len(s) else None for s in shingles(batch.column(2), n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("node", T.LongType())]))


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of `docs` that stay: one of each component, of the smallest doc_id; all rows without words or doc_id.

    Rows are told apart by doc_id; those of a repeated doc_id by their text as well, so different texts
    of one id are each judged by themselves. Of rows of one id with equal n-grams, one of the smallest text stays.
    """
    sig, result = _linked(docs, n, threshold, recall)
    keep = result.where("keeper").select(F.col("node").alias("kept"), F.col("class_id").alias("kept_id"))
    judged = sig.where("doc_id is not null").join(keep, (F.col("node") == F.col("kept")) & (F.col("doc_id") == F.col("kept_id")), "left")
    ids = judged.groupBy("doc_id").agg(F.count("*").alias("times"), F.max(F.col("node").isNull() | F.col("kept").isNotNull()).alias("stays"))
    # whole rows travel in one column, so that no name of theirs meets one of these
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    named = rows.join(ids.where("times > 1 or stays"), F.col("id") == F.col("doc_id"))
    many = _with_node(named.where("times > 1").select("id", "row", F.col("row")["text"].cast("string").alias("text")), n)
    chosen = many.where("node is not null").join(keep, (F.col("node") == F.col("kept")) & (F.col("id") == F.col("kept_id")), "left_semi").groupBy("id", "node").agg(F.min_by("row", "text").alias("row"))
    every = named.where("times = 1").select("row").union(chosen.select("row")).union(many.where("node is null").select("row")).union(rows.where("id is null").select("row"))
    return every.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
