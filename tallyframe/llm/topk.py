"""Exact top-k inner products: descending norms, rotated partial sums, Cauchy-Schwarz residual bounds."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import shipped, staged, with_small

HEAD = 16
STRIP = 1024
#: Numbers in the rotations that are sent to all executors; lengths of vectors beyond go without a rotation, which only prunes less.
ROTATIONS = 4_000_000
#: Steps of the norm, and of the reach of queries, that the plan holds.
STEPS = 4_096
GROUP_STEPS = 64
FOUND = "query_id long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, dim and v (floor(scale * x) of each component); rows with null or non-finite parts are left out."""
    x = F.col("embedding").cast("array<double>")

    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))

    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter("vec_id is not null and x is not null").filter(F.forall("x", finite))
    return kept.select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def rotation(gram: np.ndarray) -> np.ndarray:
    """Right singular vectors of the matrix with this Gram matrix, by descending singular value."""
    return np.linalg.eigh(gram)[1][:, ::-1]


def best_in_block(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, rotate: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vec_id, score) of the best k rows for each query among the rows that reach ``least``.

    Rows come in strips of descending norm. A query is out once its norm times the strip's largest
    norm is below its threshold. For the others the first rotated components give a partial sum and
    the norms of the rest a bound on what is missing; only pairs that can still reach the threshold
    are scored, in whole numbers. Equal scores stay, since the smaller vec_id wins. Thresholds are
    doubles and hold with some slack; the best are picked by the whole numbers.
    """
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((ids, -norm))
    ids, whole, norm = ids[order], x[order], norm[order]
    x, q_whole, q = whole.astype(np.float64), q, q.astype(np.float64)
    q_norm = np.sqrt((q**2).sum(axis=1))
    head = min(HEAD, x.shape[1])
    xr, qr = (x, q) if rotate is None else (x @ rotate, q @ rotate)
    x_rest = np.sqrt((xr[:, head:] ** 2).sum(axis=1))
    q_rest = np.sqrt((qr[:, head:] ** 2).sum(axis=1))
    exact = not len(x) or not len(q) or norm[0] * q_norm.max() < 2**52  # doubles add such products exactly
    least = least.astype(np.float64).copy()
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for a in range(0, len(x), STRIP):
        b = min(a + STRIP, len(x))
        slack = 1e-9 * (1 + q_norm * norm[a])
        live = np.flatnonzero(q_norm * norm[a] >= least - slack)
        if not len(live):
            break
        bound = qr[live, :head] @ xr[a:b, :head].T + np.outer(q_rest[live], x_rest[a:b])
        can = (bound >= (least - slack)[live, None]) & (ids[a:b][None, :] != q_ids[live, None])
        if can.mean() > 0.05:
            scores = (q[live] @ x[a:b].T).astype(np.int64) if exact else q_whole[live] @ whole[a:b].T
            scores = np.where(can, scores, np.iinfo(np.int64).min)
            if b - a > k:
                kth = np.partition(scores, b - a - k, axis=1)[:, b - a - k]
                least[live] = np.maximum(least[live], kth)
            r, c = np.nonzero(can & (scores >= (least - slack)[live, None]))
            value = scores[r, c]
        else:
            r, c = np.nonzero(can)
            value = np.einsum("ij,ij->i", q[live[r]], x[a + c]).astype(np.int64) if exact else np.einsum("ij,ij->i", q_whole[live[r]], whole[a + c])
            keep = value >= (least - slack)[live[r]]
            r, c, value = r[keep], c[keep], value[keep]
        row = np.concatenate([best[0], live[r]])
        vec = np.concatenate([best[1], ids[a:b][c]])
        val = np.concatenate([best[2], value])
        by = np.lexsort((vec, ~val, row))  # ~v falls as v grows, without overflow
        row, vec, val = row[by], vec[by], val[by]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < k
        best = (row[keep], vec[keep], val[keep])
        full = np.flatnonzero(np.bincount(best[0], minlength=len(q)) >= k)
        last = np.searchsorted(best[0], full, side="right") - 1
        least[full] = np.maximum(least[full], best[2][last])
    return best


def top_products(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, block_rows: int = 65_536, least_blocks: int = 64, query_rows: int = 8_192) -> DataFrame:
    """The ``k`` largest inner products of each query with all other rows of ``vectors`` (vec_id, embedding).

    Queries are the rows whose vec_id is divisible by ``every``. Components become floor(scale * x).
    Returns query_id, rank (from 1), vec_id, score; equal scores go to the smaller vec_id. A query
    with fewer candidates returns all of them.

    Rows stand in blocks of descending norm; each query first meets the block of the largest norms,
    whose k-th score prunes the others: a query is sent only to blocks in which its norm times the
    block's largest norm reaches its threshold, and a block only to groups of queries that ask for it.
    Queries of like reach stand together. Blocks and groups of queries meet in pairs, so a task holds
    one of each. Vectors of different length are not compared. Null vec_ids, null
    vectors and vectors with null or non-finite components take no part; rows that share a vec_id are
    candidates, but never of a query with that vec_id; different vectors of one query's vec_id share one
    answer, the ``k`` highest scores of any of them, and repeated rows of a query count once. An empty table gives an empty result. Scores are exact as long as
    they fit a long.
    """
    rows = staged(whole_vectors(shipped(vectors), scale), "topk-rows")
    count = rows.count()
    blocks = max(least_blocks, -(-count // block_rows))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    # Ranges of a sort by norm; equal norms are told apart by a hash. The plan is the same for any number of blocks.
    dealt = rows.withColumn("norm", norm).repartitionByRange(blocks, F.desc("norm"), F.xxhash64("vec_id"))
    keyed = staged(dealt.withColumn("block", F.spark_partition_id()), "topk-blocks")

    def grams(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            off = np.concatenate([[0], np.cumsum(dims)])
            for d in np.unique(dims).tolist():
                m = np.stack([flat[off[i] : off[i] + d] for i in np.flatnonzero(dims == d)])
                total[d] = total.get(d, 0) + m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([g.ravel() for g in total.values()], pa.list_(pa.float64()))], ["dim", "gram"])

    sums: dict[int, np.ndarray] = {}
    turned, held = [-1], 0
    for r in keyed.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1_000).collect():
        if held + r.dim**2 <= ROTATIONS:
            turned.append(r.dim)
            held += r.dim**2
    parts = keyed.select("dim", "v").filter(F.col("dim").isin(turned)).mapInArrow(grams, "dim int, gram array<double>")
    parts = parts.select("dim", F.posexplode("gram").alias("i", "g")).groupBy("dim", "i").agg(F.sum("g").alias("g")).groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("i", "g"))).alias("g"))
    for r in parts.toLocalIterator():  # one row for each of these lengths
        sums[r.dim] = rotation(np.array([c.g for c in r.g]).reshape(r.dim, r.dim))
    rotate = rows.sparkSession.sparkContext.broadcast(sums)

    def matrix(table) -> np.ndarray:
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(table.num_rows, -1).astype(np.int64)

    def meet(left, right):
        import pyarrow as pa

        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        d = left.column("dim")[0].as_py()
        if d == 0:
            return empty
        q_ids, least = right.column("vec_id").to_numpy(), right.column("least").to_numpy(zero_copy_only=False)
        row, vec, val = best_in_block(left.column("vec_id").to_numpy(), matrix(left), q_ids, matrix(right), least, rotate.value.get(d), k)
        return pa.table({"query_id": q_ids[row], "vec_id": vec, "score": val})

    queries = staged(keyed.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).drop("block"), "topk-queries")
    n_queries = max(1, queries.count())
    groups = -(-n_queries // query_rows)
    on = ["dim", "block", "q_block"]

    # The first meeting: the block of the largest norms, with queries dealt out by hash.
    spread = max(16, groups)
    top = keyed.filter("block = 0").withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    asked = queries.withColumns({"least": F.lit(float("-inf")), "block": F.lit(0), "q_block": F.pmod(F.xxhash64("vec_id", "v"), F.lit(spread)).cast("int")})
    first = staged(top.groupBy(*on).cogroup(asked.groupBy(*on)).applyInArrow(meet, FOUND), "topk-first")

    # Each query's reach: the last block that can hold a score at its threshold.
    least = first.groupBy("query_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("score"), False).alias("s")).filter(F.col("n") >= k)
    least = least.select(F.col("query_id").alias("vec_id"), F.element_at("s", k).cast("double").alias("least"))
    wide = -(-blocks // STEPS)
    steps = keyed.filter("block > 0").groupBy(F.floor(F.col("block") / wide)).agg(F.max("norm").alias("most"), F.max("block").alias("last")).collect()
    made = F.from_json(F.lit(json.dumps([{"most": r.most, "last": r["last"]} for r in steps])), "array<struct<most: double, last: int>>")
    queries = queries.join(least, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    held = F.filter(made, lambda b: b["most"] * F.col("norm") >= F.col("least") - 1e-9 * (1 + F.col("norm") * b["most"]))
    queries = staged(queries.withColumn("reach", F.coalesce(F.array_max(F.transform(held, lambda b: b["last"])), F.lit(0))).filter("reach > 0"), "topk-reach")
    cuts = queries.agg(F.percentile_approx("reach", F.array(*[F.lit(i / GROUP_STEPS) for i in range(1, GROUP_STEPS)]), F.lit(1_000))).first()[0] or []
    cuts = sorted(set(cuts)) if groups > 1 else []
    salted = -(-groups // (len(cuts) + 1))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("reach"))) if cuts else F.lit(0)
    queries = queries.withColumn("q_block", (bucket * salted + F.pmod(F.xxhash64("vec_id", "v"), F.lit(salted))).cast("int"))
    asks = queries.groupBy("q_block").agg(F.max("reach").alias("reach")).select("q_block", F.explode(F.sequence(F.lit(1), F.col("reach"))).alias("block"))
    asks = staged(asks, "topk-pairs")
    left = with_small(keyed, asks, "block", asks.count(), most=1_000_000)
    right = queries.withColumn("block", F.explode(F.sequence(F.lit(1), F.col("reach"))))
    rest = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(meet, FOUND)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
