"""Running sums, ranks and quantiles over whole tables, in range partitions: no task holds a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.sources.stages import staged


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """`df` with __range, the number of its range partition: all of p comes before all of p + 1 in the order.

    Bounds come from a sample of the rows, anew in each plan, so the rows are written once with their number
    and everything that is derived from them sees the same partitions.
    """
    return staged(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranged")


def cumulative(df: DataFrame, order: list[str], n: str, out: str, by: list[str] | None = None, total: str | None = None) -> DataFrame:
    """Running sum of `n` (not negative) in the given order, within `by` if given; rows of equal order share no sum. total: also the whole sum, within `by`.

    A partition sums its own rows of each group and adds what the partitions before it hold of the one that it goes on with,
    so neither the table nor a hot group is one task. The rows are sorted and summed once.
    """
    by = by or []
    rest = [c for c in order if c not in by]
    part = ranged(df, [*by, *rest])
    got = part.withColumn(out, F.sum(n).over(Window.partitionBy("__range", *by).orderBy(*(rest or by)).rowsBetween(Window.unboundedPreceding, 0)))
    sums = part.groupBy("__range", *by).agg(F.sum(n).alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # of the groups of a partition, only its first one can go on from before: a row for each partition at most
    before = sums.withColumn("__before", before).where("__before > 0").drop("__s")
    named = F.broadcast(before.withColumnsRenamed({c: f"__key_{c}" for c in ["__range", *by]}))
    on = [F.col("__range") == F.col("__key___range"), *[F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in by]]
    got = got.join(named, on, "left").withColumn(out, F.col(out) + F.coalesce("__before", F.lit(0))).drop("__range", "__before", *[f"__key_{c}" for c in ["__range", *by]])
    return null_safe(got, part.groupBy(*by).agg(F.sum(n).alias(total)), by) if total else got


def null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined on `keys`, null being equal to null; without keys, b has one row."""
    if not keys:
        return a.crossJoin(F.broadcast(b))
    named = b.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    return a.join(named, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys], how).drop(*[f"__key_{k}" for k in keys])


def avg_rank(df: DataFrame, col: str, by: list[str] | None = None, out: str = "rank") -> DataFrame:
    """`df` with the average rank of `col`, ties sharing it, within `by`. Made over different values with their counts."""
    by = by or []
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("__v")).agg(F.count("*").alias("__n"))
    ranked = cumulative(counts, [*by, "__v"], "__n", "__c", by).select(*[F.col(b).alias(f"__by_{b}") for b in by], "__v", (F.col("__c") - F.col("__n") + (F.col("__n") + 1) / 2).alias(out))
    return df.join(ranked, [F.col(col) == F.col("__v"), *[F.col(b).eqNullSafe(F.col(f"__by_{b}")) for b in by]], "left").drop("__v", *[f"__by_{b}" for b in by])


def quantiles(df: DataFrame, keys: list[str], value: str | Column, probs: dict[str, float], times: str | None = None) -> DataFrame:
    """(keys, a column per entry of probs): exact quantiles, linear between neighbours, of each group. times: how often a row counts.

    Values are counted, the counts summed in order, and each quantile read where the sum passes its place. Nulls are
    left out; a group without values has no row, but without keys there is always one.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    counts = df.select(*keys, v.alias("__v"), (F.col(times) if times else F.lit(1)).alias("__t")).where(F.col("__v").isNotNull()).groupBy(*keys, "__v").agg(F.sum("__t").alias("__n"))
    placed = cumulative(counts, [*keys, "__v"], "__n", "__c", keys, "__total")
    start = F.col("__c") - F.col("__n")

    def at(p: float) -> Column:
        place = lambda total: F.lit(float(p)) * (total - 1)
        low, high = (F.max(F.when(start <= f(place(F.col("__total"))), F.col("__v"))) for f in (F.floor, F.ceil))
        mean = place(F.max("__total"))
        return low + (high - low) * (mean - F.floor(mean))

    return placed.groupBy(*keys).agg(*[at(p).alias(name) for name, p in probs.items()])


def nth(df: DataFrame, values: list[Column], ranks: list[int], bins: int = 4096, few: int = 1000) -> list[float]:
    """The ranks[i]-th smallest number, from 1, of values[i] for each i; exact, without a sort.

    Every scan counts all rows, for all values at once, in `bins` equal bins between the bounds known so far, and goes on
    with the bin that holds the rank; bounds are numbers that occur, so copies end it at once. At most `few` numbers a value
    come to the driver. Values must be the same in each scan; nulls are left out, and a rank beyond the count is refused.
    """
    rows = df.select(F.posexplode(F.array(*[v.cast("double") for v in values])).alias("s", "v")).where("v is not null")
    left, bound = dict(enumerate(ranks)), {r.s: (r.lo, r.hi, r.n) for r in rows.groupBy("s").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).collect()}
    if any(not 1 <= k <= bound.get(i, (0, 0, 0))[2] for i, k in left.items()):
        raise ValueError("a rank beyond the rows that have a value")
    while live := [i for i in left if bound[i][0] < bound[i][1]]:
        at = lambda part, live=tuple(live): F.create_map(*[F.lit(x) for i in live for x in (i, float(bound[i][part]))])[F.col("s")]
        inside = rows.where(F.col("s").isin(live)).select("s", "v", at(0).alias("lo"), at(1).alias("hi")).where("v between lo and hi")
        if all(bound[i][2] <= few for i in live):
            found = inside.select("s", "v").collect()
            for i in live:
                x = sorted(r.v for r in found if r.s == i)[left[i] - 1]
                bound[i] = (x, x, 1)
            break
        bin_of = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        got = inside.groupBy("s", bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for r in sorted(got, key=lambda r: r.bin):
            if 0 < left[r.s] <= r.n and r.s in live:
                bound[r.s] = (r.lo, r.hi, r.n)
                live.remove(r.s)
            elif r.s in live:
                left[r.s] -= r.n
    return [bound[i][0] for i in range(len(ranks))]
