"""Exact order statistics of a whole column, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 2048
FETCH = 20_000


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The r-th smallest value (from 1) of ``column`` for every r in ``ranks``.

    Each pass counts values in buckets of the intervals that still hold a wanted rank; a bucket of few
    distinct values is fetched as value counts, others are narrowed again. The column has no missing values.
    """
    x = F.col(column)
    span = df.agg(F.min(x), F.max(x), F.count(x)).first()
    if not span[2]:
        return {}
    out: dict[int, float] = {}
    todo = sorted({min(max(1, r), span[2]) for r in ranks})
    intervals = [(float(span[0]), float(span[1]), 0, todo)]
    while intervals:
        place = F.lit(None).cast("int")
        bucket = F.lit(None).cast("int")
        for i, (lo, hi, _, _) in enumerate(intervals):
            inside = x.between(lo, hi)
            width = (hi - lo) / BUCKETS
            at = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(BUCKETS - 1)).cast("int") if width > 0 else F.lit(0)
            place, bucket = F.when(inside, i).otherwise(place), F.when(inside, at).otherwise(bucket)
        rows = df.select(x.alias("x"), place.alias("i"), bucket.alias("b")).filter("i is not null").groupBy("i", "b").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).collect()
        nxt: list[tuple[float, float, int, list[int]]] = []
        fetch: list[tuple[float, float, int, list[int]]] = []
        for i, (_, _, before, wanted) in enumerate(intervals):
            at = before
            for r in sorted((r for r in rows if r.i == i), key=lambda r: r.b):
                mine = [k for k in wanted if at < k <= at + r.n]
                if mine and r.lo == r.hi:
                    out |= dict.fromkeys(mine, float(r.lo))
                elif mine:
                    (fetch if r.n <= FETCH else nxt).append((float(r.lo), float(r.hi), at, mine))
                at += r.n
        if fetch:
            cond = F.lit(False)
            for lo, hi, _, _ in fetch:
                cond = cond | x.between(lo, hi)
            values = sorted((float(r[0]), r[1]) for r in df.filter(cond).groupBy(x).count().collect())
            for lo, hi, before, wanted in fetch:
                at = before
                for v, n in values:
                    if lo <= v <= hi:
                        for k in wanted:
                            if at < k <= at + n:
                                out[k] = v
                        at += n
        intervals = nxt
    return {r: out[min(max(1, r), span[2])] for r in ranks}
