"""Exact-size sampling and bootstrap, reproducible by hashing a row key with the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..common import EngineError, fresh, hash_bucket, need, ranked, same

DRAWS_PER_ROW = 50_000


def _hash(seed: int, key: list[str]) -> Column:
    return F.xxhash64(F.lit(seed), *key)


def _group_sizes(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("__size"))


def _with(df: DataFrame, table: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join a table of one row for each group; missing group keys match."""
    keyed = table.select(*[F.col(b).alias(f"__g{i}") for i, b in enumerate(by)], *[c for c in table.columns if c not in by])
    cond = F.lit(True)
    for i, b in enumerate(by):
        cond = cond & same(F.col(b), F.col(f"__g{i}"))
    return df.join(keyed, cond, how).drop(*[f"__g{i}" for i in range(len(by))])


def sample_rows(
    df: DataFrame,
    key: list[str],
    percent: float | None = None,
    count: int | None = None,
    by: list[str] | None = None,
    where: Column | None = None,
    keep_outside: bool = True,
    seed: int = 1,
) -> DataFrame:
    """Draw without replacement exactly round(percent / 100 * n) rows, or min(count, n), of each group.

    ``key`` identifies rows; a row's place in the draw is a hash of seed and key, so the sample does
    not depend on partitions. Groups are numbered bucket by bucket of the hash. Rows outside
    ``where`` are not drawn from; they stay unless ``keep_outside`` is false. Halves round up.
    """
    by = by or []
    need(df, *key, *by)
    if (percent is None) == (count is None):
        raise EngineError(198, "give percent or count")
    if percent is not None and not 0 <= percent <= 100 or count is not None and count < 0:
        raise EngineError(198, "the size is out of range")
    inside = df.filter(where) if where is not None else df
    grouped = inside.withColumn("__all", F.lit(1))
    groups = by or ["__all"]
    size = F.floor(F.lit(percent) / 100 * F.col("__size") + 0.5) if percent is not None else F.least(F.lit(count).cast("long"), F.col("__size"))
    target = _group_sizes(grouped, groups).withColumn("__target", size).drop("__size")
    work = grouped.withColumn("__h", _hash(seed, key)).withColumn("__bucket", hash_bucket(F.col("__h")))
    drawn = _with(ranked(work, groups, [F.col("__h"), *map(F.col, key)]), target, groups).filter("__n <= __target").select(df.columns)
    if where is not None and keep_outside:
        drawn = drawn.unionByName(df.filter(~F.coalesce(where, F.lit(False))))
    return drawn


def bootstrap_rows(
    df: DataFrame,
    key: list[str],
    n: int | None = None,
    strata: list[str] | None = None,
    cluster: list[str] | None = None,
    weight: str | None = None,
    seed: int = 1,
) -> DataFrame:
    """Draw with replacement; rows repeat as often as drawn, or ``weight`` names a column of how often.

    Each stratum draws max(1, round(n * n_s / N)) rows, by default as many as it has. With
    ``cluster`` each stratum draws as many clusters as it has and takes all their rows; ``n`` is
    then not used. Without strata the whole table is one. With ``weight`` rows that are not drawn
    stay, with 0.
    """
    need(df, *key, *(strata or []), *(cluster or []))
    if weight:
        fresh(df, weight)
    if n is not None and n < 1:
        raise EngineError(198, "n must be positive")
    base = df.withColumn("__all", F.lit(1))
    groups = strata or ["__all"]
    unit = base.select(*groups, *cluster).distinct() if cluster else base.select(*groups, *[k for k in key if k not in groups])
    names = cluster or key
    work = unit.withColumn("__h", _hash(0, names)).withColumn("__bucket", hash_bucket(F.col("__h")))
    numbered = ranked(work, groups, [F.col("__h"), *map(F.col, names)])
    sizes = _group_sizes(unit, groups)
    if n is not None and not cluster:
        total = F.sum("__size").over(W.partitionBy(F.lit(1)))
        sizes = sizes.withColumn("__draws", F.greatest(F.lit(1).cast("long"), F.floor(F.lit(n) * F.col("__size") / total + 0.5)))
    else:
        sizes = sizes.withColumn("__draws", F.col("__size"))
    # Draws are spread over tasks in runs, then each draw picks a number by hash.
    runs = sizes.select(*groups, "__size", "__draws", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__draws") - 1) / DRAWS_PER_ROW))).alias("__run"))
    runs = runs.repartition(*groups, "__run")
    first = F.col("__run") * DRAWS_PER_ROW
    draws = runs.select(*groups, "__size", F.explode(F.sequence(first, F.least(first + DRAWS_PER_ROW, F.col("__draws")) - 1)).alias("__t"))
    pick = F.pmod(F.xxhash64(F.lit(seed), *groups, "__t"), F.col("__size")) + 1
    times = draws.groupBy(*groups, pick.alias("__n")).agg(F.count("*").alias("__times"))
    counted = _with(numbered, times, [*groups, "__n"]).select(*groups, *[c for c in names if c not in groups], "__times")
    out = _with(base, counted, list(dict.fromkeys([*groups, *names])), "left").withColumn("__times", F.coalesce("__times", F.lit(0).cast("long")))
    if weight:
        return out.select(*df.columns, F.col("__times").alias(weight))
    return out.filter("__times > 0").withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(df.columns)
