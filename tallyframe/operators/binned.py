"""Quantile-binned means with controls, absorbed effects and polynomial fits."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..common import EngineError, need, number, same
from ..functions.order_stats import order_statistics
from .fe import absorb, complete
from .moments import cross, dot, independent

ORDERS = {"none": 0, "connect": 0, "linear": 1, "qfit": 2, "cubic": 3}


@dataclass
class Binned:
    """``bins``: by columns, bin, n, sum_w, x_mean, y_mean, y_se. ``fits``: by values to (coefficients from the constant up, R2).
    ``rows``: the sample with __bin. ``controls``: coefficients of the controls."""

    bins: DataFrame
    fits: dict[tuple, tuple[list[float], float]]
    rows: DataFrame
    controls: dict[str, float] = field(default_factory=dict)

    def fits_df(self, spark) -> DataFrame:
        """group, term (power of x), coef, r2."""
        out = [("|".join(map(str, k)), i, float(c), float(r2)) for k, (coef, r2) in self.fits.items() for i, c in enumerate(coef)]
        return spark.createDataFrame(out, "group string, term int, coef double, r2 double")


def assign_bins(rows: DataFrame, x: Column, nq: int, by: list[str], weight: Column | None, discrete: bool) -> DataFrame:
    """Add __bin, 1..nq: the first q whose cut point, the ceil(q N / nq)-th value, is at least x; equal values stay together.

    With weights: the whole part of the cumulated weight, the value's own included, over the weight of
    a bin, plus 1, at most nq. ``discrete``: one bin for each distinct value.
    """
    rows = rows.withColumn("__x", x)
    if not by and weight is None and not discrete:
        n = rows.count()
        at = {q: -(-q * n // nq) for q in range(1, nq)}
        stats = order_statistics(rows, "__x", list(at.values())) if n else {}
        cuts = [stats[at[q]] for q in range(1, nq)] if n else []
        return rows.withColumn("__bin", sum((F.when(F.col("__x") > c, 1).otherwise(0) for c in cuts), F.lit(0)) + 1)
    w = weight if weight is not None else F.lit(1.0)
    values = rows.groupBy(*by, "__x").agg(F.count("*").alias("__c"), F.sum(w).alias("__w"))
    group = W.partitionBy(*(by or [F.lit(1)]))
    upto = group.orderBy("__x").rowsBetween(W.unboundedPreceding, 0)
    if discrete:
        bin_ = F.row_number().over(group.orderBy("__x"))
    elif weight is None:
        before = F.sum("__c").over(upto) - F.col("__c")
        bin_ = F.least(F.floor(before * nq / F.sum("__c").over(group)) + 1, F.lit(nq))
    else:
        total = F.sum("__w").over(group)
        bin_ = F.when(total > 0, F.least(F.floor(F.sum("__w").over(upto) / (total / nq)) + 1, F.lit(nq))).otherwise(1)
    keyed = values.select(*[F.col(b).alias(f"__b{i}") for i, b in enumerate(by)], F.col("__x").alias("__v"), bin_.cast("int").alias("__bin"))
    cond = F.col("__x") == F.col("__v")
    for i, b in enumerate(by):
        cond = cond & same(F.col(b), F.col(f"__b{i}"))
    return rows.join(keyed, cond).drop("__v", *[f"__b{i}" for i in range(len(by))])


def polynomial(rows: DataFrame, x: Column, y: Column, order: int, w: Column) -> tuple[list[float], float]:
    """Least-squares polynomial of ``order`` and its R2; powers are taken about the mean and expanded afterwards."""
    s = rows.agg(F.sum(w), F.sum(w * x) / F.sum(w), F.sum(w * y) / F.sum(w), F.stddev(x)).first()
    if not s[0]:
        return [], float("nan")
    mean, scale = s[1], s[3] or 1.0
    z = (x - F.lit(mean)) / F.lit(scale)
    g = cross(rows, [*[F.pow(z, F.lit(i)) for i in range(order + 1)], y - F.lit(s[2])], weight=w)
    k = order + 1
    keep = independent(g[:k, :k])
    b = np.zeros(k)
    b[keep] = np.linalg.solve(g[np.ix_(keep, keep)], g[keep, k])
    rss = g[k, k] - b @ g[:k, k]
    out = np.poly1d([0.0])
    for i in range(k):
        out = out + b[i] * np.poly1d([1 / scale, -mean / scale]) ** i
    coef = np.zeros(k)
    coef[: len(out.c)] = out.c[::-1]
    coef[0] += s[2]
    return coef.tolist(), float(1 - rss / g[k, k]) if g[k, k] > 0 else float("nan")


def binned_means(
    df: DataFrame,
    y: str,
    x: str,
    nquantiles: int = 20,
    controls: list[str] | None = None,
    absorb_: list[str] | None = None,
    by: list[str] | None = None,
    weight: str | None = None,
    discrete: bool = False,
    method: str = "classic",
    linetype: str = "linear",
    genxq: str | None = None,
) -> Binned:
    """Means of ``y`` and ``x`` in quantile bins of ``x``, always by the exact rule, within the groups of ``by``.

    classic: controls and absorbed effects are removed from both y and x, and the means added back,
    before binning. binsreg: bins of raw x; bin means of y less what the within-bin regression on
    controls and effects attributes to how the bin's controls differ from the overall mean.
    ``genxq`` names a column of bin numbers in ``rows``.
    """
    controls, effects, by = list(controls or []), list(absorb_ or []), list(by or [])
    need(df, y, x, *controls, *effects, *by, *([weight] if weight else []))
    if method not in ("classic", "binsreg"):
        raise EngineError(198, f"unknown method {method}")
    if linetype not in ORDERS:
        raise EngineError(198, f"unknown linetype {linetype}")
    if not 2 <= nquantiles <= 1000 and not discrete:
        raise EngineError(198, "nquantiles is out of range")
    rows = complete(df, list(dict.fromkeys([y, x, *controls, *effects, *([weight] if weight else [])])))
    if weight:
        rows = rows.filter(F.col(weight) > 0)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = rows.withColumns({"__y": number(y), "__xr": number(x), "__w": w})
    gamma: dict[str, float] = {}
    if method == "classic" and (controls or effects):
        part = absorb(rows, effects, {"y": F.col("__y"), "x": F.col("__xr"), **{f"c{i}": number(c) for i, c in enumerate(controls)}}, "__w", keep_singletons=True)
        data, cols = part.data, [F.col(f"d_c{i}") for i in range(len(controls))]
        g = cross(data, [*cols, F.col("d_y"), F.col("d_x")], weight=F.col("__w"))
        k = len(controls)
        keep = independent(g[:k, :k])
        inv = np.linalg.inv(g[np.ix_(keep, keep)]) if keep else np.zeros((0, 0))
        by_y, by_x = inv @ g[keep, k], inv @ g[keep, k + 1]
        gamma = {controls[i]: float(v) for i, v in zip(keep, by_y, strict=True)}
        used = [cols[i] for i in keep]
        rows = data.withColumns({"__y": F.col("d_y") - dot(used, by_y) + F.lit(part.means["y"]), "__xr": F.col("d_x") - dot(used, by_x) + F.lit(part.means["x"])})
    rows = assign_bins(rows, F.col("__xr"), nquantiles, by, F.col("__w") if weight else None, discrete)
    wsum = F.sum("__w")
    mean = lambda c: F.sum(F.col("__w") * c) / wsum
    y_mean = mean(F.col("__y"))
    bins = rows.groupBy(*by, F.col("__bin").alias("bin")).agg(
        F.count("*").alias("n"), wsum.alias("sum_w"), mean(F.col("__xr")).alias("x_mean"), y_mean.alias("y_mean"),
        (F.sqrt(F.var_samp("__y") / F.count("*"))).alias("y_se"),
        *[mean(number(c)).alias(f"__m_{i}") for i, c in enumerate(controls)],
    )
    if method == "binsreg" and (controls or effects):
        # Within-bin regression: y on bin dummies, controls and effects; the bin is one more effect.
        key = F.concat_ws("|", *[F.coalesce(F.col(b).cast("string"), F.lit("?")) for b in by], F.col("__bin").cast("string"))
        part = absorb(rows.withColumn("__cell", key), ["__cell", *effects], {"y": F.col("__y"), **{f"c{i}": number(c) for i, c in enumerate(controls)}}, "__w", keep_singletons=True)
        cols = [F.col(f"d_c{i}") for i in range(len(controls))]
        g = cross(part.data, [*cols, F.col("d_y")], weight=F.col("__w"))
        k = len(controls)
        keep = independent(g[:k, :k])
        b = np.linalg.solve(g[np.ix_(keep, keep)], g[keep, k]) if keep else np.zeros(0)
        gamma = {controls[i]: float(v) for i, v in zip(keep, b, strict=True)}
        if effects:
            # The effects of bins themselves: those of y less those of the controls, re-centred at the mean of y.
            t = part.effects[0]
            e = F.col("__e0_y") - dot([F.col(f"__e0_c{i}") for i in keep], b)
            cells = rows.withColumn("__cell", key).groupBy("__cell", *by, "__bin").agg(wsum.alias("__sw"))
            level = cells.join(t.select(F.col("__level").alias("__cell"), e.alias("__e")), "__cell")
            center = level.agg((F.sum(F.col("__sw") * F.col("__e")) / F.sum("__sw"))).first()[0]
            keyed = level.select(*[F.col(c).alias(f"__j{i}") for i, c in enumerate(by)], F.col("__bin").alias("__jb"), (F.col("__e") - F.lit(center) + F.lit(part.means["y"])).alias("__adj"))
            cond = F.col("bin") == F.col("__jb")
            for i, c in enumerate(by):
                cond = cond & same(F.col(c), F.col(f"__j{i}"))
            bins = bins.join(keyed, cond).withColumn("y_mean", F.col("__adj")).drop("__adj", "__jb", *[f"__j{i}" for i in range(len(by))])
        else:
            overall = rows.agg(*[mean(number(c)).alias(f"m{i}") for i, c in enumerate(controls)]).first()
            shift = F.lit(0.0)
            for i, v in zip(keep, b, strict=True):
                shift = shift + (F.col(f"__m_{i}") - F.lit(overall[f"m{i}"])) * F.lit(float(v))
            bins = bins.withColumn("y_mean", F.col("y_mean") - shift)
    bins = bins.drop(*[f"__m_{i}" for i in range(len(controls))])
    fits: dict[tuple, tuple[list[float], float]] = {}
    order = ORDERS[linetype]
    if order:
        groups = [tuple(r) for r in rows.select(*by).distinct().collect()] if by else [()]
        for g in groups:
            part_rows = rows
            for c, v in zip(by, g, strict=True):
                part_rows = part_rows.filter(same(F.col(c), F.lit(v)))
            fits[g] = polynomial(part_rows, F.col("__xr"), F.col("__y"), order, F.col("__w"))
    keep_cols = [c for c in df.columns]
    out_rows = rows.select(*keep_cols, F.col("__bin").alias(genxq or "__bin"))
    return Binned(bins, fits, out_rows, gamma)
