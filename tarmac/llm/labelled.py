"""Labelled documents for fitting the classifiers of this subpackage."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import forget, written

#: Most labelled rows that a classifier is fitted on, half of them of each label, and most bytes of their
#: texts; those of the smallest hash of the id are taken. A text above MAX_TEXT
#: is passed over while there are shorter ones.
MAX_ROWS, MAX_BYTES, MAX_TEXT = 4000, 16 << 20, 256 << 10


def training_rows(docs: DataFrame, labels: DataFrame, label: str, fold: Column, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, tuple[int, int]]:
    """(k, y, text) of a bounded sample of labelled documents for which `fold` holds, and the numbers of all labels 0 and 1.

    Of each label at most max_rows / 2 with the smallest hash of doc_id, then as many of their whole
    texts, in that order, as fit into half of max_bytes and what the other label leaves; one that does
    not fit is passed over. Rows without id, label or document are left out; of repeated ids, the largest
    label and the smallest text count. Ids of the sample are few enough to be broadcast. Raises if
    documents have both labels and the texts of one do not fit.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & fold).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(label)))
    count = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    sizes = docs.select("doc_id", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).alias("n")).join(known, "doc_id").groupBy("doc_id", "y", "h").agg(F.max("n").alias("n"))
    sizes = written(sizes, "labelled-sizes")
    first = [sizes.where(F.col("y") == y).orderBy(F.col("n") > MAX_TEXT, "h", "doc_id").limit(max_rows // 2).collect() for y in (0, 1)]
    chosen, left = [], max_bytes
    for i, rows in enumerate(sorted(first, key=lambda rows: sum(r.n for r in rows))):
        share, some = left if i else left // 2, len(chosen)
        for r in rows:
            if r.n <= share:
                chosen.append(r)
                share -= r.n
                left -= r.n
        if all(first) and len(chosen) == some:
            raise ValueError(f"no text of {label} {rows[0].y} fits into the sample of {max_bytes} bytes")
    ids = [(k, r.doc_id, r.y) for k, r in enumerate(sorted(chosen, key=lambda r: (r.h, r.doc_id)))]
    keys = docs.sparkSession.createDataFrame(ids, "k int, doc_id long, y int")
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(keys), "doc_id").groupBy("k", "y").agg(F.min("text").alias("text")), (count.get(0, 0), count.get(1, 0))


def fitted(rows: DataFrame, counts: tuple[int, int], fit: Callable):
    """fit(texts, labels) of a sample, in one task: the sample is bounded, and only the model comes to the driver.

    The offset of the model is moved from the sample's share of labels to that of all of them.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        forget()
        pdf = pdf.sort_values("k")
        texts, labels = pa.array(pdf.text, pa.string()), pdf.y.tolist()
        del pdf
        model, n1 = fit(texts, labels), sum(labels)
        if 0 < n1 < len(labels) and min(counts):
            model.offset += math.log(counts[1] / counts[0]) - math.log(n1 / (len(labels) - n1))
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    got = rows.groupBy().applyInPandas(run, "model binary").collect()
    return pickle.loads(got[0].model) if got else fit(pa.array([], pa.string()), [])
