"""Ranks, running sums and exact quantiles over a whole column without sorting it in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom.session import cut


def running_sums(df: DataFrame, order: list[str], **sums: Column | str) -> DataFrame:
    """df with a column for each named sum: its running total over the rows in `order`, the row itself included.

    Rows are range-partitioned by `order` (which should tell rows apart) and written; the ranges'
    totals, as few as the ranges, are added up in one small window, the rest within each range."""
    ranged = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    cols = {n: F.col(c) if isinstance(c, str) else c for n, c in sums.items()}
    totals = ranged.groupBy("__range").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in cols.items()])
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("__range", *[F.sum(f"__t_{n}").over(before).alias(f"__b_{n}") for n in cols])
    within = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = ranged.withColumns({n: F.sum(c).over(within) for n, c in cols.items()})
    whole = own.join(F.broadcast(base), "__range")  # one row a range
    return whole.withColumns({n: F.col(n) + F.when(F.col(f"__b_{n}").isNotNull(), F.col(f"__b_{n}")).otherwise(F.lit(0)) for n in cols}).select(*df.columns, *cols)


def exact_quantiles(df: DataFrame, value: Column | str, probs: list[float], weight: str | None = None, bins: int = 1024) -> list[float | None]:
    """The interpolated quantiles of the finite values (null: there are none), each row counting `weight` times.

    A rank is looked up by counting: the range that holds it is cut into `bins` equal parts, whose
    counts are added up; the part with the rank is the next range, until it holds one value. Nothing
    is sorted, and what reaches the driver are `bins` rows a pass, whatever the number of values."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    d = df.select(x.alias("x"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("k")).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    whole = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("k").alias("n")).first()
    if not whole.n:
        return [None] * len(probs)
    seen: dict[tuple[float, float], list] = {}

    def parts(lo: float, hi: float) -> list:
        if (lo, hi) not in seen:
            half = 0.5 if hi - lo == float("inf") else 1.0  # the widest ranges overflow
            at = F.least(F.floor((F.col("x") * half - lo * half) / (hi * half - lo * half) * bins), F.lit(bins - 1))
            rows = d.where((F.col("x") >= lo) & (F.col("x") <= hi)).groupBy(at.alias("b")).agg(F.sum("k").alias("k"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
            seen[lo, hi] = sorted(rows, key=lambda r: r.b)
        return seen[lo, hi]

    def at_rank(rank: int) -> float:
        lo, hi, before = whole.lo, whole.hi, 0
        while lo < hi:
            for r in parts(lo, hi):
                if rank < before + r.k:
                    break
                before += r.k
            lo, hi = r.lo, r.hi
        return lo

    out = []
    for p in probs:
        place = p * (whole.n - 1)
        low = at_rank(math.floor(place))
        high = low if place == math.floor(place) else at_rank(math.ceil(place))
        out.append(low + (high - low) * (place - math.floor(place)))
    return out
