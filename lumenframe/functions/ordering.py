"""Positions and order statistics without a window over everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.staging import written

_PLACE = (1 << 33) - 1


def indexed(df: DataFrame, keys: Sequence[str], name: str = "idx") -> DataFrame:
    """``df`` with its position, from 0, in the order of ``keys``: sorted in ranges, each counted on its own.

    Only the number of rows of each range meets in one place. Ties keep an arbitrary order among themselves, so pass unique keys.
    """
    s = written(df.sort(*keys).withColumn("_place", F.monotonically_increasing_id()), "sorted").withColumn("_range", F.shiftright("_place", 33))
    counts = s.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return s.join(starts, "_range").withColumn(name, F.col("_start") + F.col("_place").bitwiseAND(F.lit(_PLACE))).drop("_range", "_place", "_start")


def running_total(df: DataFrame, keys: Sequence[str], weight: str, name: str) -> DataFrame:
    """``df`` with the sum of ``weight`` of the rows before each, in the order of unique ``keys``.

    Rows are sorted into ranges, summed within each, and only the ranges' totals meet in one place.
    """
    s = written(df.sort(*keys).withColumn("_range", F.spark_partition_id()), "sorted")
    totals = s.groupBy("_range").agg(F.sum(weight).alias("_total"))
    starts = totals.select("_range", F.coalesce(F.sum("_total").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum(weight).over(W.partitionBy("_range").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return s.withColumn(name, inside).join(starts, "_range").withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_start")


ACCURACY = 10_000


def order_statistics(df: DataFrame, column: str, ranks: Sequence[int], small: int = 100_000) -> list[float]:
    """The values at ``ranks`` (from 0) of a numeric column without nulls, exactly; infinities are values like others, NaN fails.

    While many values may hold a rank, approximate percentiles a little below and above it bound it, and the values below, at
    and between the bounds are counted. Each round serves all ranks and leaves about 1 in ACCURACY / 4 of the values, whatever
    their scale; bounds are values themselves, so that each round leaves fewer. The driver gets counts, then at most ``small`` values a rank.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    n, odd = x.agg(F.count("*"), F.count_if(F.isnan("x"))).first()
    if odd:
        raise ValueError("values must be numbers")
    if not n or not all(0 <= r < n for r in ranks):
        raise ValueError("rank out of range")
    if n > small:
        x = written(x, "values")
    done: dict[int, float] = {}
    # rank -> (the values strictly between these, null for no bound; the rank among them; their number)
    left: dict[int, tuple[float | None, float | None, int, int]] = {r: (None, None, r, n) for r in ranks}

    def between(a: float | None, b: float | None) -> Column:
        return (F.lit(True) if a is None else F.col("x") > a) & (F.lit(True) if b is None else F.col("x") < b)

    while left:
        wide = {r: v for r, v in left.items() if v[3] > small}
        if wide:
            near = lambda v, by: min(1.0, max(0.0, (v[2] + 0.5) / v[3] + by / ACCURACY))
            ends = x.agg(*(F.percentile_approx(F.when(between(*v[:2]), F.col("x")), [near(v, -2), near(v, 2)], ACCURACY).alias(str(r)) for r, v in wide.items())).first()
            inside = {r: between(*v[:2]) for r, v in wide.items()}
            counts = x.agg(*(F.struct(F.count_if(inside[r] & (F.col("x") < a)), F.count_if(F.col("x") == a), F.count_if((F.col("x") > a) & (F.col("x") < b)), F.count_if(F.col("x") == b)).alias(str(r)) for r in wide for a, b in [ends[str(r)]])).first()
            for r, (a, b, k, held) in wide.items():
                low, high = ends[str(r)]
                below, at_low, mid, at_high = counts[str(r)]
                k -= below
                if 0 <= k < at_low:
                    done[r] = low
                elif k < 0:
                    left[r] = (a, low, k + below, below)
                elif (k := k - at_low) < mid:
                    left[r] = (low, high, k, mid)
                elif (k := k - mid) < at_high and high > low:
                    done[r] = high
                else:
                    k -= at_high if high > low else 0
                    left[r] = (high, b, k, held - below - at_low - mid - (at_high if high > low else 0))
        few = {r: v for r, v in left.items() if v[3] <= small and r not in done}
        for a, b in dict.fromkeys(v[:2] for v in few.values()):
            same = [tuple(c) for c in x.where(between(a, b)).groupBy("x").agg(F.count("*").alias("n")).collect()]
            same.sort()
            for r, v in few.items():
                k = v[2]
                for value, m in same if v[:2] == (a, b) else ():
                    if k < m:
                        done[r] = value
                        break
                    k -= m
        left = {r: v for r, v in left.items() if r not in done}
    return [done[r] for r in ranks]


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Exact quantiles with linear interpolation between order statistics; none for an empty column."""
    n = df.where(F.col(column).isNotNull()).count()
    if not n:
        return []
    at = [s * (n - 1) for s in shares]
    ranks = sorted({r for p in at for r in (int(p), min(int(p) + 1, n - 1))})
    value = dict(zip(ranks, order_statistics(df, column, ranks), strict=True))
    pairs = [(value[int(p)], value[min(int(p) + 1, n - 1)], p - int(p)) for p in at]
    return [low if low == high or not part else low + (high - low) * part for low, high, part in pairs]
