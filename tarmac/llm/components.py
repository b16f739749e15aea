"""Connected components of a link table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import remove, shared_dir


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component_id) for each id of links (src, dst): component_id is the smallest id reached.

    Rounds of large-star and small-star: every node links its larger neighbours to the smallest one
    it knows, then its smaller ones; the result is one star per component. Rounds are logarithmic in
    practice; each is written to the shared folder. Null ids are ignored; no links, no rows.
    """
    spark = links.sparkSession

    def kept(df: DataFrame) -> tuple[DataFrame, str]:
        path = shared_dir(spark, "links")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    edges, path = kept(links.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        old = path
        edges, path = kept(small)
        remove(spark, old)  # the next round is written and needs no earlier one
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(edges.select("v", "v").distinct())
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
