"""Rules that all operators share: errors, missing values, order, row numbers."""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


class EngineError(ValueError):
    """A rejected request; ``code`` tells the kind: 110 exists, 111 absent, 106/107/108/109 wrong class, 9 assertion, 459 not unique."""

    def __init__(self, code: int, message: str):
        super().__init__(f"{message} (r{code})")
        self.code = code


def need(df: DataFrame, *names: str) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise EngineError(111, f"column not found: {', '.join(absent)}")


def fresh(df: DataFrame, *names: str) -> None:
    there = [n for n in names if n in df.columns]
    if there:
        raise EngineError(110, f"column exists: {', '.join(there)}")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def number(name: str | Column) -> Column:
    """A numeric column as double with NaN as null."""
    c = F.col(name) if isinstance(name, str) else name
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def order_keys(keys: list[str], *ties: str) -> list[Column]:
    """Ascending, missing last; strings compare by bytes."""
    return [F.col(k).asc_nulls_last() for k in [*keys, *ties]]


def same(left: Column, right: Column) -> Column:
    """Keys match if equal; missing matches missing."""
    return left.eqNullSafe(right)


def with_position(df: DataFrame, name: str = "__row", order: list[str] | None = None) -> DataFrame:
    """Add dense positions from 1, in the order of ``order`` (missing last), else as the rows stand.

    Rows are numbered within partitions and shifted by the counts of the partitions before; only
    one count per partition reaches the driver.
    """
    if order:
        # Written once: the ranges of a sort are drawn anew each time it runs.
        numbered = written(df.orderBy(*order_keys(order)).withColumn("__m", F.monotonically_increasing_id()), "positions")
    else:
        numbered = df.withColumn("__m", F.monotonically_increasing_id())
    part = F.shiftright(F.col("__m"), 33)
    counts = sorted((r[0], r[1]) for r in numbered.groupBy(part.alias("p")).count().collect())
    at, start = 0, {}
    for p, n in counts:
        start[p] = at
        at += n
    if not counts:
        return numbered.withColumn(name, F.lit(0).cast("long")).drop("__m")
    # One short row for each partition, from one literal: the plan is the same for any number of partitions.
    made = F.from_json(F.lit(json.dumps([{"__part": p, "__start": n} for p, n in start.items()])), "array<struct<__part: bigint, __start: bigint>>")
    offsets = df.sparkSession.range(1).select(F.inline(made))
    placed = numbered.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return placed.withColumn(name, F.col("__start") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__m", "__part", "__start")


_SHIPPED: set[str] = set()


def shipped(df: DataFrame) -> DataFrame:
    """Send this package to the executors' Python workers, once for each application; returns ``df``."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="tallyframe-"), "tallyframe_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(here):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("tallyframe", os.path.relpath(full, here)))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
    return df


_OWN: dict[str, str] = {}
_WRITTEN: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise EngineError(198, "spark.checkpoint.dir must name a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tallyframe-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyframe/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _drop_written() -> None:
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            return


def small(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """Mark a side for broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= most else df


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "__n", buckets: int = 1024) -> DataFrame:
    """Dense numbers from 1 within each group of ``by``, in the order of a hash; see :func:`hash_bucket`.

    Groups are numbered bucket by bucket, so no task holds a whole group.
    """
    counts = df.groupBy(*by, "__bucket").agg(F.count("*").alias("__c"))
    before = W.partitionBy(*by).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("__from", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    within = F.row_number().over(W.partitionBy(*by, "__bucket").orderBy(*order))
    on = [*by, "__bucket"]
    keyed = counts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], "__from")
    cond = F.lit(True)
    for i, c in enumerate(on):
        cond = cond & same(F.col(c), F.col(f"__k{i}"))
    out = df.withColumn(name, within).join(keyed, cond).withColumn(name, F.col(name) + F.col("__from"))
    return out.drop("__from", *[f"__k{i}" for i in range(len(on))])


def hash_bucket(h: Column, buckets: int = 1024) -> Column:
    """Bucket of a 64-bit hash that keeps its order."""
    return F.shiftright(h, 64 - (buckets.bit_length() - 1))
