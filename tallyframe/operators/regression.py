"""Least squares with absorbed fixed effects, and prediction after estimation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..common import EngineError, fresh, need, number
from .fe import absorb, complete, nested_in
from .moments import Result, clusters_meat, cross, dot, independent, inverse, wald

KINDS = ("aw", "fw", "pw", "iw")


def factor_columns(df: DataFrame, name: str, base: object = None, most: int = 10_000) -> dict[str, Column]:
    """Dummies of the levels of ``name`` without the base level, which is the lowest by default."""
    need(df, name)
    levels = [r[0] for r in df.select(name).filter(F.col(name).isNotNull()).distinct().orderBy(name).limit(most + 1).collect()]
    if len(levels) > most:
        raise EngineError(134, "too many levels; absorb the factor instead")
    base = levels[0] if base is None and levels else base
    return {f"{level}.{name}": (F.col(name) == F.lit(level)).cast("double") for level in levels if level != base}


def interaction(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    return {f"{x}#{y}": a[x] * b[y] for x in a for y in b}


def lagged(df: DataFrame, name: str, time: str, panel: list[str] | None = None, lag: int = 1) -> Column:
    """The value ``lag`` periods before (negative: after) in the same panel; missing where the period is not there."""
    w = W.partitionBy(*(panel or [])).orderBy(F.col(time))
    span = w.rangeBetween(-lag, -lag)
    return F.max(number(name)).over(span)


def differenced(df: DataFrame, name: str, time: str, panel: list[str] | None = None) -> Column:
    return number(name) - lagged(df, name, time, panel)


def weighted_sample(df: DataFrame, columns: list[str], weight: str | None, kind: str) -> tuple[DataFrame, str | None]:
    """Complete rows with positive weights; a copy of the weight is in ``__wt``."""
    if kind not in KINDS:
        raise EngineError(198, f"unknown weight {kind}")
    need(df, *columns, *([weight] if weight else []))
    rows = complete(df, [*dict.fromkeys([*columns, *([weight] if weight else [])])])
    if not weight:
        return rows, None
    return rows.filter(F.col(weight) > 0).withColumn("__wt", F.col(weight).cast("double")), "__wt"


def fe_ols(
    df: DataFrame,
    y: str,
    x: list[str],
    absorb_: list[str] | None = None,
    vce: str = "unadjusted",
    cluster: list[str] | str | None = None,
    weight: str | None = None,
    weight_kind: str = "aw",
    dofadjustments: str = "all",
    tolerance: float = 1e-8,
    iterate: int = 10_000,
    extra: dict[str, Column] | None = None,
) -> Result:
    """Regress ``y`` on ``x`` and a constant, absorbing the effects ``absorb_``.

    ``vce``: unadjusted, robust (HC1) or cluster. ``extra`` adds regressors given as columns, such
    as factor dummies. Weights: aw and pw are scaled to sum to the rows (pw implies robust), fw
    repeat rows. Rows with a missing value in any variable, and singleton levels, are left out.
    Collinear regressors get a zero coefficient, in order.

    ``sample`` of the result holds the rows used, with columns __resid (residual), __xb and __d
    (the sum of the effects).
    """
    effects = list(absorb_ or [])
    cluster = [cluster] if isinstance(cluster, str) else list(cluster or [])
    if cluster and vce == "unadjusted":
        vce = "cluster"
    if vce not in ("unadjusted", "robust", "cluster") or (vce == "cluster") != bool(cluster):
        raise EngineError(198, f"vce {vce}")
    if dofadjustments not in ("all", "none", "firstpair", "pairwise"):
        raise EngineError(198, f"dofadjustments {dofadjustments}")
    if weight and weight_kind == "pw" and vce == "unadjusted":
        vce = "robust"
    rows, w_name = weighted_sample(df, [y, *x, *effects, *cluster], weight, weight_kind)
    names = [*x, *(extra or {})]
    columns = {"y": number(y), **{f"x{i}": number(c) for i, c in enumerate(x)}}
    for i, c in enumerate((extra or {}).values(), len(x)):
        columns[f"x{i}"] = c.cast("double")
    if extra:
        for i in range(len(x), len(names)):
            rows = rows.filter(columns[f"x{i}"].isNotNull())
    part = absorb(rows, effects, columns, w_name, tolerance, iterate)
    data = part.data
    xs = [F.col(f"d_x{i}") for i in range(len(names))]
    n_rows = part.n_rows
    if n_rows == 0:
        raise EngineError(2000, "no observations")
    total_w = data.agg(F.sum(w_name)).first()[0] if w_name else float(n_rows)
    fw = w_name is not None and weight_kind == "fw"
    scale = 1.0 if w_name is None or fw else n_rows / total_w
    w = F.col(w_name) * F.lit(scale) if w_name else F.lit(1.0)
    n = total_w if fw else float(n_rows)
    # One aggregation gives all second moments, within and about the mean.
    around = [F.col(f"v_{v}") - F.lit(part.means[v]) for v in columns]
    both = cross(data, [*xs, F.col("d_y"), *around], weight=w)
    k = len(names)
    gram, xy, yy = both[:k, :k], both[:k, k], both[k, k]
    tss = both[k + 1, k + 1]
    own = np.diag(both)[k + 2 :]
    keep = independent(gram, own)
    means = np.array([part.means[f"x{i}"] for i in range(k)])
    xx = gram[np.ix_(keep, keep)]
    bread = inverse(xx)
    b_keep = bread @ xy[keep]
    rss = float(max(yy - xy[keep] @ b_keep, 0.0))
    df_a, kk = part.df_a(dofadjustments), len(keep)
    nested = [part.levels[g] for g, f in enumerate(effects) if vce == "cluster" and nested_in(data, f, cluster)]
    df_nested = sum(nested)
    df_a_free = df_a - df_nested
    m = means[keep]
    full = np.zeros((kk + 1, kk + 1))
    full[:kk, :kk] = bread
    full[:kk, kk] = full[kk, :kk] = -bread @ m
    full[kk, kk] = 1 / n + m @ bread @ m
    resid = F.col("d_y") - dot([xs[i] for i in keep], b_keep)
    data = data.withColumn("__resid", resid)
    scores = [(F.col(f"d_x{i}") + F.lit(float(means[i]))) * F.col("__resid") for i in keep] + [F.col("__resid")]
    df_r = n - kk - df_a
    n_clusters = None
    if vce == "unadjusted":
        v_keep = full * (rss / max(df_r, 1))
    elif vce == "robust":
        v_keep = full @ cross(data, scores, weight=w if fw else w * w) @ full * (n / max(n - kk - df_a, 1))
    else:
        meat, n_clusters = clusters_meat(data, cluster, scores, w)
        adj = (n - 1) / max(n - (1 if df_nested else 0) - kk - df_a_free, 1) * n_clusters / max(n_clusters - 1, 1)
        v_keep = full @ meat @ full * adj if n_clusters > 1 else np.zeros_like(full)
        df_r = min(n_clusters - 1, n - kk - df_a_free)
    df_r = max(df_r, 1)
    b, v = np.zeros(k + 1), np.zeros((k + 1, k + 1))
    at = [*keep, k]
    b[at] = np.append(b_keep, part.means["y"] - m @ b_keep)
    v[np.ix_(at, at)] = v_keep
    used = max(n - kk - df_a_free - df_nested, 1)
    f_wald, _ = wald(b_keep, v_keep[:kk, :kk], df_r)
    f = ((yy - rss) / kk) / (rss / df_r) if vce == "unadjusted" and kk and rss > 0 else f_wald
    scalars = {
        "N": n, "df_m": kk, "df_r": df_r, "df_a": df_a, "rss": rss, "tss": tss, "tss_within": yy, "r2": 1 - rss / tss if tss > 0 else float("nan"), "r2_within": 1 - rss / yy if yy > 0 else float("nan"),
        "r2_a": 1 - (rss / used) / (tss / (n - 1)) if tss > 0 and n > 1 else float("nan"), "rmse": (rss / used) ** 0.5, "F": f, "singletons": part.singletons, "components": part.components,
    }
    if n_clusters is not None:
        scalars["N_clust"] = n_clusters
    xb = F.lit(float(b[k]))
    for i in range(k):
        xb = xb + F.col(f"v_x{i}") * F.lit(float(b[i]))
    data = data.withColumn("__xb", xb).withColumn("__d", F.col("v_y") - F.col("__xb") - F.col("__resid"))
    sample = data.select(*[c for c in df.columns], "__resid", "__xb", "__d")
    dropped = [names[i] for i in range(k) if i not in keep]
    out = Result([*names, "_cons"], b, v, scalars, dropped, sample=sample)
    out.model = {"y": y, "x": x, "extra": extra or {}, "effects": effects}
    if effects and part.effects:
        out.effects = {f: _effect_table(t, g, f, b, k) for g, (f, t) in enumerate(zip(effects, part.effects, strict=True))}
    if part.groups is not None:
        out.effects["__groups"] = part.groups
    return out


def _effect_table(t: DataFrame, g: int, name: str, b: np.ndarray, k: int) -> DataFrame:
    """level and effect: the fixed effects themselves, those of y less those of x times the coefficients."""
    e = F.col(f"__e{g}_y")
    for i in range(k):
        e = e - F.col(f"__e{g}_x{i}") * F.lit(float(b[i]))
    return t.select(F.col("__level").alias(name), e.alias("effect"))


def predict(df: DataFrame, result: Result, kind: str = "xb", name: str = "prediction") -> DataFrame:
    """Add a prediction: xb (linear part), stdp (its standard error), and, for the rows of the estimation sample,
    residuals (what is left after linear part and effects), d (effects), xbd (linear part and effects), dresiduals (y less linear part)."""
    m = result.model
    terms = {**{c: number(c) for c in m["x"]}, **{c: e.cast("double") for c, e in m["extra"].items()}}
    cons = result.names[-1] == "_cons"
    cols = [terms[n] for n in result.names if n != "_cons"]
    xb = dot(cols, result.b[: len(cols)]) + (F.lit(float(result.b[-1])) if cons else F.lit(0.0))
    if kind == "xb":
        fresh(df, name)
        return df.withColumn(name, xb)
    if kind == "stdp":
        fresh(df, name)
        both = [*cols, F.lit(1.0)] if cons else cols
        v = F.lit(0.0)
        for i in range(len(both)):
            for j in range(len(both)):
                if result.v[i, j]:
                    v = v + both[i] * both[j] * F.lit(float(result.v[i, j]))
        return df.withColumn(name, F.sqrt(F.greatest(v, F.lit(0.0))))
    if kind in ("residuals", "d", "xbd", "dresiduals"):
        s = result.sample
        value = {"residuals": F.col("__resid"), "d": F.col("__d"), "xbd": F.col("__xb") + F.col("__d"), "dresiduals": F.col("__resid") + F.col("__d")}[kind]
        return s.withColumn(name, value).drop("__resid", "__xb", "__d")
    raise EngineError(198, f"unknown prediction {kind}")
