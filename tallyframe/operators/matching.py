"""Propensity-score matching and the average treatment effect on the treated."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..common import EngineError, need, number, shipped, with_position, written
from .fe import complete
from .moments import cross, dot

KERNELS = ("epan", "normal", "biweight", "uniform", "tricube")
#: Rows that matching without replacement, which goes one treated row after another, takes to the driver at most.
MOST_SEQUENTIAL = 20_000_000
#: Treated rows, in order of score, whose radius or kernel matches one task finds; it holds all controls within their reach.
BLOCK = 4096
#: Pairs that are compared at once.
AT_ONCE = 1 << 17


@dataclass
class Matched:
    """``rows``: the input with _pscore, _treated, _support, _weight, _id, _nn. ``pairs``: treated, control, weight, distance.

    Pairs of a radius or kernel are made as they are read and never kept: they grow with the square of the rows.
    """

    rows: DataFrame
    pairs: DataFrame
    att: dict[str, float]


def binary_fit(df: DataFrame, y: str, x: list[str], link: str = "probit", rounds: int = 100) -> np.ndarray:
    """Coefficients (constant last) of a probit or logit, by Newton steps on aggregated moments."""
    cols = [number(c) for c in x] + [F.lit(1.0)]
    t = F.col(y).cast("double")
    b = np.zeros(len(cols))
    for _ in range(rounds):
        eta = F.least(F.greatest(dot(cols, b), F.lit(-30.0)), F.lit(30.0))
        if link == "logit":
            p = 1 / (1 + F.exp(-eta))
            score, info = t - p, p * (1 - p)
        else:
            # The normal distribution function from the complementary error function's series in columns.
            q = 2 * t - 1
            phi = F.exp(-eta * eta / 2) / F.lit(float(np.sqrt(2 * np.pi)))
            lam = q * phi / F.greatest(normal_column(q * eta), F.lit(1e-300))
            score, info = lam, lam * (lam + eta)
        work = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)], score.alias("s"), info.alias("h"))
        cs = [F.col(f"c{i}") for i in range(len(cols))]
        g = cross(work, cs, [F.col("s")])[:, 0]
        h = cross(work, cs, weight=F.col("h"))
        step = np.linalg.solve(h, g)
        b = b + step
        if np.abs(step).max() <= 1e-10 * max(1.0, np.abs(b).max()):
            return b
    raise EngineError(430, "the score model did not converge")


def normal_column(x: Column) -> Column:
    """Standard normal distribution function of a column, to about 1e-15: series inside, continued fraction outside."""
    a = F.abs(x)
    # Marsaglia's series as a fold keeps the expression small.
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(a.alias("t"), a.alias("s")),
        lambda acc, i: F.struct((acc["t"] * a * a / (2 * i + 1)).alias("t"), (acc["s"] + acc["t"] * a * a / (2 * i + 1)).alias("s")),
        lambda acc: acc["s"],
    )
    phi = F.exp(-a * a / 2) / F.lit(float(np.sqrt(2 * np.pi)))
    inner = 0.5 + phi * series
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda acc, i: i / (a + acc))
    upper = F.when(a < 5, inner).otherwise(1 - phi / (a + fraction))
    lower = F.when(a < 5, 0.5 - phi * series).otherwise(phi / (a + fraction))
    return F.when(x >= 0, upper).otherwise(lower)


def propensity(df: DataFrame, treat: str, covariates: list[str], link: str = "probit") -> DataFrame:
    """Add _pscore, the fitted probability of ``treat``."""
    b = binary_fit(df, treat, covariates, link)
    eta = dot([number(c) for c in covariates], b[:-1]) + F.lit(float(b[-1]))
    return df.withColumn("_pscore", 1 / (1 + F.exp(-eta)) if link == "logit" else normal_column(eta))


def counts_below(points: DataFrame, controls: DataFrame) -> DataFrame:
    """For points (point, at, after) how many controls (p) have p < at, or p <= at where ``after`` is true, as ``below``.

    Both stand in one sorted table; running counts go partition by partition.
    """
    both = controls.select(F.lit(None).cast("long").alias("point"), F.col("p").alias("at"), F.lit(1).alias("side"), F.lit(1).alias("one"))
    both = both.unionByName(points.select("point", "at", F.when(F.col("after"), 2).otherwise(0).alias("side"), F.lit(0).alias("one")))
    ordered = written(both.orderBy("at", "side").withColumn("__m", F.monotonically_increasing_id()), "match-order")
    part = F.shiftright("__m", 33)
    counts = sorted((r[0], r[1]) for r in ordered.groupBy(part.alias("p")).agg(F.sum("one")).collect())
    at, start = 0, []
    for p, n in counts:
        start += [F.lit(p).cast("long"), F.lit(at).cast("long")]
        at += n
    local = F.sum("one").over(W.partitionBy(part).orderBy("__m").rowsBetween(W.unboundedPreceding, 0))
    base = F.create_map(*start)[part] if start else F.lit(0)
    return ordered.withColumn("below", local + base).filter("point is not null").select("point", "below")


def psm_match(
    df: DataFrame,
    treat: str,
    key: str,
    covariates: list[str] | None = None,
    outcome: str | None = None,
    pscore: str | None = None,
    link: str = "probit",
    neighbor: int = 1,
    caliper: float = 0.0,
    method: str = "nearest",
    kerneltype: str = "epan",
    bwidth: float = 0.06,
    common: bool = False,
    replacement: bool = True,
    ties: bool = False,
    descending: bool = False,
) -> Matched:
    """Match treated rows to controls by propensity score.

    ``method``: nearest (the ``neighbor`` nearest, equal distances to the lower score, with ``ties``
    all at the last distance), radius (all within ``caliper``, .25 if 0) or kernel. ``key`` is
    unique and settles equal scores. Without ``replacement`` treated rows take their nearest unused
    control in order of score. ``common`` takes treated rows beyond the controls' scores off
    support. Controls' weights are the sums of their shares; a treated row without candidates has
    weight 0.

    Candidates are found by position among the sorted controls, so joins are on equal positions.
    """
    need(df, treat, key, *(covariates or []), *([outcome] if outcome else []), *([pscore] if pscore else []))
    if method not in ("nearest", "radius", "kernel"):
        raise EngineError(198, f"unknown method {method}")
    if kerneltype not in KERNELS:
        raise EngineError(198, f"unknown kernel {kerneltype}")
    if not replacement and (neighbor > 1 or ties or method != "nearest"):
        raise EngineError(198, "without replacement there is one neighbor and no ties")
    rows = complete(df, [treat, *(covariates or []), *([pscore] if pscore else [])])
    kinds = {float(r[0]) for r in rows.select(F.col(treat).cast("double")).distinct().limit(3).collect()}
    if kinds - {0.0, 1.0}:
        raise EngineError(2000, "the treatment is not binary")
    if pscore:
        rows = rows.withColumn("_pscore", number(pscore))
    elif covariates:
        rows = propensity(rows, treat, covariates, link)
    else:
        raise EngineError(198, "give covariates or a score")
    rows = written(rows.withColumn("_treated", F.col(treat).cast("int")), "match-rows")
    treated = rows.filter("_treated = 1").select(F.col(key).alias("t"), F.col("_pscore").alias("tp"))
    controls = rows.filter("_treated = 0").select(F.col(key).alias("c"), F.col("_pscore").alias("p"))
    bounds = controls.agg(F.min("p"), F.max("p")).first()
    off = (F.col("tp") < F.lit(bounds[0])) | (F.col("tp") > F.lit(bounds[1])) if common and bounds[0] is not None else F.lit(False)
    candidates = treated.filter(~off)
    # Positions among the controls, in order of score and key.
    placed = written(with_position(controls, "pos", ["p", "c"]), "match-controls")
    if replacement and method != "nearest":
        pairs, own, share = _within(candidates, placed, method, caliper, kerneltype, bwidth)
    else:
        pairs = _one_by_one(candidates, placed, caliper, descending) if not replacement else _nearest(candidates, placed, neighbor, caliper, ties)
        pairs = written(pairs, "match-pairs")
        own = pairs.groupBy(F.col("t").alias("__t")).agg(F.min_by("c", F.struct("dist", "side", "rank")).alias("__first"), F.count("*").alias("__nn"))
        share = pairs.groupBy(F.col("c").alias("__c")).agg(F.sum("w").alias("__share"))
    out = rows.join(own, F.col(key) == F.col("__t"), "left").join(share, F.col(key) == F.col("__c"), "left")
    is_t = F.col("_treated") == 1
    t_off = (F.col("_pscore") < F.lit(bounds[0])) | (F.col("_pscore") > F.lit(bounds[1])) if common and bounds[0] is not None else F.lit(False)
    if not replacement:
        t_off = t_off | F.col("__nn").isNull()
    out = out.withColumns({
        "_support": F.when(is_t & t_off, 0).otherwise(1),
        "_weight": F.when(is_t, F.when(F.col("__nn") > 0, 1.0).otherwise(0.0)).otherwise(F.coalesce("__share", F.lit(0.0))),
        "_id": F.when(is_t, F.col("__first")),
        "_nn": F.when(is_t, F.coalesce("__nn", F.lit(0))).cast("long"),
    })
    out = out.select(*df.columns, "_pscore", "_treated", "_support", "_weight", "_id", "_nn")
    if outcome:
        out = written(out, "match-weights")
    att = effect(out, outcome) if outcome else {}
    return Matched(out, pairs.select(F.col("t").alias("treated"), F.col("c").alias("control"), F.col("w").alias("weight"), F.col("dist").alias("distance")), att)


def _counted(treated: DataFrame, controls: DataFrame, bounds: list[tuple[Column, bool]], order: list[str] | None = None) -> DataFrame:
    numbered = written(with_position(treated, "n", order), "match-treated")
    k = len(bounds)
    points = None
    for i, (value, after) in enumerate(bounds):
        one = numbered.select((F.col("n") * k + i).alias("point"), value.alias("at"), F.lit(after).alias("after"))
        points = one if points is None else points.unionByName(one)
    below = counts_below(points, controls)
    wide = below.groupBy(F.floor(F.col("point") / k).alias("n")).agg(*[F.max(F.when(F.col("point") % k == i, F.col("below"))).alias(f"b{i}") for i in range(k)])
    return numbered.join(wide, "n")


def _nearest(treated: DataFrame, placed: DataFrame, k: int, caliper: float, ties: bool) -> DataFrame:
    at = _counted(treated, placed, [(F.col("tp"), False)])
    near = at.select("t", "tp", "b0", F.explode(F.sequence(F.col("b0") - k + 1, F.col("b0") + k)).alias("pos"))
    near = near.join(placed, "pos").withColumn("dist", F.abs(F.col("tp") - F.col("p"))).withColumn("side", F.when(F.col("pos") <= F.col("b0"), 0).otherwise(1))
    if caliper > 0:
        near = near.filter(F.col("dist") <= caliper)
    # The lower side goes down from the treated score, the upper side up.
    order = W.partitionBy("t").orderBy("dist", "side", F.abs(F.col("pos") - F.col("b0")))
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if not ties:
        return ranked.withColumn("w", 1 / F.count("*").over(W.partitionBy("t"))).select("t", "c", "w", "dist", "side", "rank")
    last = ranked.groupBy("t", "tp").agg(F.max("dist").alias("d"), F.count("*").alias("have"))
    wide = last.withColumn("d", F.when(F.col("have") >= k, F.col("d") + 1e-12).otherwise(F.col("d")))
    reach = _counted(wide, placed, [(F.col("tp") - F.col("d") - 1e-15, False), (F.col("tp") + F.col("d") + 1e-15, True)])
    every = reach.select("t", "tp", "d", F.explode(F.sequence(F.col("b0") + 1, F.greatest(F.col("b1"), F.col("b0") + 1))).alias("pos")).join(placed, "pos")
    every = every.withColumn("dist", F.abs(F.col("tp") - F.col("p"))).filter(F.col("dist") <= F.col("d"))
    if caliper > 0:
        every = every.filter(F.col("dist") <= caliper)
    every = every.withColumn("side", F.when(F.col("p") < F.col("tp"), 0).otherwise(1)).withColumn("rank", F.col("pos"))
    return every.withColumn("w", 1 / F.count("*").over(W.partitionBy("t"))).select("t", "c", "w", "dist", "side", "rank")


def kernel_values(a: np.ndarray, kind: str) -> np.ndarray:
    """The kernel at distances in bandwidths."""
    if kind == "epan":
        return np.where(a < 1, 0.75 * (1 - a * a), 0.0)
    if kind == "biweight":
        return np.where(a < 1, 15 / 16 * np.square(1 - a * a), 0.0)
    if kind == "uniform":
        return np.where(a <= 1, 0.5, 0.0)
    if kind == "tricube":
        x = 1 - a * a * a
        return np.where(a < 1, 70 / 81 * (x * x * x), 0.0)
    return np.exp(-a * a / 2) / np.sqrt(2 * np.pi)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """Controls and treated rows of one block after another, from rows sorted by block and side."""

    def parts(held: list[pa.RecordBatch]) -> tuple[pa.Table, pa.Table]:
        both = pa.Table.from_batches(held).combine_chunks()
        n = int((both.column("side").to_numpy() == 0).sum())
        return both.slice(0, n), both.slice(n)

    held, at = [], None
    for batch in batches:
        block = batch.column(batch.schema.get_field_index("block")).to_numpy()
        starts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist()] if len(block) else []
        for i, j in zip(starts, [*starts[1:], len(block)]):
            if held and block[i] != at:
                yield parts(held)
                held = []
            at = block[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield parts(held)


def _compared(controls: pa.Table, treated: pa.Table, reach: float, kernel: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """The first of some treated rows, the first of the controls that they reach, and for all these: distances, weights, whether they match."""
    p, first = controls.column("score").to_numpy(), controls.column("b0")[0].as_py() - 1
    tp, b0, b1 = (treated.column(c).to_numpy() for c in ("score", "b0", "b1"))
    i = 0
    while i < len(tp):
        # As many rows as fit from the first one's window to the last one's.
        j = i + max(1, int(np.searchsorted((b1[i:] - b0[i]) * np.arange(1, len(tp) - i + 1), AT_ONCE, "right")))
        low = int(b0[i] - first)
        dist = np.abs(tp[i:j, None] - p[None, low : int(b1[j - 1] - first)])
        k = kernel(dist)
        matched = (dist <= reach) & (k > 0)
        k[~matched] = 0.0
        total = k.sum(axis=1, keepdims=True)
        yield i, low, dist, np.divide(k, total, out=k, where=total > 0), matched
        i = j


def _within(treated: DataFrame, placed: DataFrame, method: str, caliper: float, kind: str, h: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All pairs within reach; for each treated row its nearest control and number of pairs; for each control the sum of its weights.

    Blocks of treated rows get the controls within their reach, so what is sent grows with the pairs over ``BLOCK``.
    Pairs are compared in arrays, and rows only of the first table.
    """
    reach = (caliper or 0.25) if method == "radius" else (6 * h if kind == "normal" else h)
    if method == "kernel" and caliper > 0:
        reach = min(reach, caliper)
    at = _counted(treated, placed, [(F.col("tp") - F.lit(reach) - 1e-12, False), (F.col("tp") + F.lit(reach) + 1e-12, True)], ["tp", "t"])
    at = written(at.filter("b1 > b0").withColumn("block", F.floor((F.col("n") - 1) / BLOCK)), "match-reach")
    spans = at.groupBy("block").agg(F.min("b0").alias("low"), F.max("b1").alias("high"))
    cell = lambda c: F.floor(c / BLOCK)
    asked = spans.select("block", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell"))
    sent = placed.withColumn("cell", cell(F.col("pos") - 1)).join(asked, "cell").filter("pos > low and pos <= high")
    both = sent.select("block", F.lit(0).alias("side"), F.col("c").alias("id"), F.col("p").alias("score"), F.col("pos").alias("b0"), F.col("pos").alias("b1"))
    both = both.unionByName(at.select("block", F.lit(1).alias("side"), F.col("t").alias("id"), F.col("tp").alias("score"), "b0", "b1"))
    dealt = shipped(both).repartition(max(1, spans.count()), "block").sortWithinPartitions("block", "side", "score", "b0")
    kernel = (lambda d: kernel_values(d / h, kind)) if method == "kernel" else np.ones_like

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for controls, own in _blocks(batches):
            t, c = own.column("id").combine_chunks(), controls.column("id").combine_chunks()
            for i, low, dist, w, matched in _compared(controls, own, reach, kernel):
                row, col = np.nonzero(matched)
                yield pa.RecordBatch.from_arrays([t.take(pa.array(row + i)), c.take(pa.array(col + low)), pa.array(w[matched]), pa.array(dist[matched])], ["t", "c", "w", "dist"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for controls, own in _blocks(batches):
            t, c = own.column("id").combine_chunks(), controls.column("id").combine_chunks()
            share, near, n = np.zeros(len(c)), np.zeros(len(t), dtype=np.int64), np.zeros(len(t), dtype=np.int64)
            for i, low, dist, w, matched in _compared(controls, own, reach, kernel):
                share[low : low + w.shape[1]] += w.sum(axis=0)
                # Of equal distances the first: controls below the treated row come before those above.
                near[i : i + len(w)] = np.where(matched, dist, np.inf).argmin(axis=1) + low
                n[i : i + len(w)] = matched.sum(axis=1)
            has, used = np.flatnonzero(n), np.flatnonzero(share)
            none = lambda kind, k: pa.nulls(k, kind)
            yield pa.RecordBatch.from_arrays([t.take(pa.array(has)), c.take(pa.array(near[has])), pa.array(n[has]), none(pa.float64(), len(has))], ["id", "first", "n", "share"])
            yield pa.RecordBatch.from_arrays([c.take(pa.array(used)), none(c.type, len(used)), none(pa.int64(), len(used)), pa.array(share[used])], ["id", "first", "n", "share"])

    key = placed.schema["c"].dataType.simpleString()
    found = dealt.mapInArrow(sums, f"id {key}, first {key}, n long, share double")
    own = found.filter("n is not null").select(F.col("id").alias("__t"), F.col("first").alias("__first"), F.col("n").alias("__nn"))
    share = found.filter("share is not null").groupBy(F.col("id").alias("__c")).agg(F.sum("share").alias("__share"))
    return dealt.mapInArrow(every, f"t {key}, c {key}, w double, dist double"), own, share


def _one_by_one(treated: DataFrame, placed: DataFrame, caliper: float, descending: bool) -> DataFrame:
    """Greedy matching without replacement: one pass on the driver over scores and keys only."""
    n = treated.count() + placed.count()
    if n > MOST_SEQUENTIAL:
        raise EngineError(901, f"{n} rows; matching without replacement takes at most {MOST_SEQUENTIAL}")
    t = sorted(((r.tp, r.t) for r in treated.collect()), key=lambda r: (-r[0] if descending else r[0], r[1]))
    c = [(r.p, r.c) for r in placed.orderBy("pos").collect()]
    scores = [p for p, _ in c]

    def seek(jump: list[int], i: int) -> int:
        root = i
        while jump[root] != root:
            root = jump[root]
        while jump[i] != root:
            jump[i], i = root, jump[i]
        return root

    # Used controls point to the next candidate on either side.
    down, up = list(range(len(c) + 2)), list(range(len(c) + 2))
    out = []
    for p, k in t:
        i = bisect_left(scores, p)
        a, b = seek(down, i), seek(up, i + 1)  # 1-based positions; 0 and len + 1 are the ends
        da = p - scores[a - 1] if a >= 1 else float("inf")
        db = scores[b - 1] - p if b <= len(c) else float("inf")
        pick, d, side = (a, da, 0) if da <= db else (b, db, 1)
        if d == float("inf") or (caliper > 0 and d > caliper):
            continue
        out.append((k, c[pick - 1][1], 1.0, float(abs(d)), side, 1))
        down[pick], up[pick] = pick - 1, pick + 1
    spark = treated.sparkSession
    kt, kc = treated.schema["t"].dataType.simpleString(), placed.schema["c"].dataType.simpleString()
    return spark.createDataFrame(out, f"t {kt}, c {kc}, w double, dist double, side int, rank int")


def effect(rows: DataFrame, outcome: str) -> dict[str, float]:
    """ATT: difference of weighted means over the support, with analytic-weight variances."""
    y, w = number(outcome), F.col("_weight")
    part = rows.filter("_support = 1 and _weight > 0").filter(y.isNotNull())
    stats = {r["_treated"]: r for r in part.groupBy("_treated").agg(F.count("*").alias("n"), (F.sum(w * y) / F.sum(w)).alias("m"), (F.sum(w * y * y) / F.sum(w)).alias("s")).collect()}
    if 0 not in stats or 1 not in stats:
        return {"att": float("nan"), "se": float("nan"), "t": float("nan"), "n_treated": 0, "n_control": 0}
    center = {k: r["m"] for k, r in stats.items()}
    dev = F.pow(y - F.when(F.col("_treated") == 1, F.lit(center[1])).otherwise(F.lit(center[0])), F.lit(2))
    var = {r["_treated"]: r["v"] for r in part.groupBy("_treated").agg((F.sum(w * dev) / F.sum(w)).alias("v")).collect()}
    n1, n0 = stats[1]["n"], stats[0]["n"]
    v1, v0 = (var[k] * n / max(n - 1, 1) for k, n in ((1, n1), (0, n0)))
    att, se = center[1] - center[0], (v1 / n1 + v0 / n0) ** 0.5
    return {"att": att, "se": se, "t": att / se if se > 0 else float("nan"), "n_treated": n1, "n_control": n0, "y1": center[1], "y0": center[0]}

