"""Instrumental-variable estimation with absorbed fixed effects, on cross-moments."""

from __future__ import annotations

from math import cos, pi, sin

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import EngineError, number
from ..functions.distributions import chi2_tail, f_tail
from .fe import absorb, nested_in
from .moments import Result, clusters_meat, cross, dot, independent, wald
from .regression import weighted_sample

KERNELS = ("bartlett", "parzen", "quadratic-spectral", "truncated", "tukey-hanning")


def kernel_weight(kernel: str, lag: int, bandwidth: float) -> float:
    """Weight of an autocovariance; Bartlett, Parzen and Tukey-Hanning end at the bandwidth."""
    u = lag / bandwidth
    if kernel == "truncated":
        return 1.0 if u <= 1 else 0.0
    if kernel == "bartlett":
        return max(0.0, 1 - u)
    if kernel == "parzen":
        return 1 - 6 * u * u + 6 * u**3 if u <= 0.5 else 2 * (1 - u) ** 3 if u <= 1 else 0.0
    if kernel == "tukey-hanning":
        return 0.5 * (1 + cos(pi * u)) if u <= 1 else 0.0
    if kernel == "quadratic-spectral":
        if lag == 0:
            return 1.0
        x = 6 * pi * u / 5
        return 25 / (12 * pi * pi * u * u) * (sin(x) / x - cos(x))
    raise EngineError(198, f"unknown kernel {kernel}")


def autocovariances(data: DataFrame, columns: list[Column], time: str, panel: list[str], kernel: str, bandwidth: float) -> dict[int, np.ndarray]:
    """For every lag that the kernel weighs the sum over periods of the products of the columns with the lagged ones.

    The columns are summed by panel and period first; one join carries all lags.
    """
    cols = [f"__g{i}" for i in range(len(columns))]
    per = data.groupBy(*panel, time).agg(*[F.sum(s).alias(c) for s, c in zip(columns, cols, strict=True)])
    out = {0: cross(per, [F.col(c) for c in cols])}
    span = int(per.agg((F.max(time) - F.min(time)).cast("long")).first()[0] or 0)
    last = span if kernel == "quadratic-spectral" else min(span, int(bandwidth) if kernel == "truncated" or bandwidth != int(bandwidth) else int(bandwidth) - 1)
    if last < 1:
        return out
    lags = per.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(panel)], F.explode(F.sequence(F.lit(1), F.lit(last))).alias("__lag"), F.col(time).alias("__t"), *[F.col(c).alias(f"__b{c}") for c in cols])
    cond = F.col(time) == F.col("__t") + F.col("__lag")
    for i, p in enumerate(panel):
        cond = cond & F.col(p).eqNullSafe(F.col(f"__p{i}"))
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols))]
    rows = per.join(lags, cond).groupBy("__lag").agg(*[F.sum(F.col(cols[i]) * F.col(f"__b{cols[j]}")).alias(f"m{k}") for k, (i, j) in enumerate(pairs)]).collect()
    for r in rows:
        out[r["__lag"]] = np.array([r[f"m{k}"] or 0.0 for k in range(len(pairs))]).reshape(len(cols), len(cols))
    return out


def hac_meat(data: DataFrame, scores: list[Column], time: str, panel: list[str], kernel: str, bandwidth: float) -> np.ndarray:
    """Kernel-weighted sum of the autocovariances of the scores, within panels."""
    gammas = autocovariances(data, scores, time, panel, kernel, bandwidth)
    return gammas[0] + sum((kernel_weight(kernel, lag, bandwidth) * (g + g.T) for lag, g in gammas.items() if lag), np.zeros_like(gammas[0]))


def ac_meat(data: DataFrame, z: list[Column], e: Column, n: float, time: str, panel: list[str], kernel: str, bandwidth: float) -> np.ndarray:
    """The same where errors may be autocorrelated but not heteroskedastic: autocovariances of e times those of z."""
    gammas = autocovariances(data, [e, *z], time, panel, kernel, bandwidth)
    return sum((kernel_weight(kernel, lag, bandwidth) * g[0, 0] / n * (g[1:, 1:] + (g[1:, 1:].T if lag else 0)) for lag, g in gammas.items()), np.zeros((len(z), len(z))))


def partialled(g: np.ndarray, on: list[int]) -> np.ndarray:
    """Moments of all columns after projecting on the columns ``on``."""
    if not on:
        return g
    return g - g[:, on] @ np.linalg.solve(g[np.ix_(on, on)], g[on])


def root_inverse(m: np.ndarray) -> np.ndarray:
    value, vector = np.linalg.eigh(m)
    return vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-300))) @ vector.T


class Problem:
    """Residualised data and its moments; 0 is y, then endogenous, exogenous and excluded columns."""

    def __init__(self, data: DataFrame, columns: list[Column], weight: Column, square: Column, n: float, n_endog: int, n_exog: int, df_a: float, meat):
        self.data, self.columns, self.weight, self.square, self.n, self.df_a, self.meat = data, columns, weight, square, n, df_a, meat
        self.g = cross(data, columns, weight=weight)
        self.endog = list(range(1, 1 + n_endog))
        self.exog = list(range(1 + n_endog, 1 + n_endog + n_exog))
        self.excl = list(range(1 + n_endog + n_exog, len(columns)))

    def part(self, a: list[int], b: list[int]) -> np.ndarray:
        return self.g[np.ix_(a, b)]

    def residual(self, x: list[int], b: np.ndarray) -> Column:
        return self.columns[0] - dot([self.columns[i] for i in x], b)

    def rss(self, x: list[int], b: np.ndarray) -> float:
        g = np.concatenate([[1.0], -b])
        at = [0, *x]
        return float(g @ self.part(at, at) @ g)

    def k_class(self, x: list[int], z: list[int], k: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and the bread."""
        a, q = self.part(x, z), self.part(z, z)
        proj = a @ np.linalg.solve(q, a.T)
        rhs = a @ np.linalg.solve(q, self.part(z, [0])[:, 0])
        m = (1 - k) * self.part(x, x) + k * proj
        return np.linalg.solve(m, (1 - k) * self.part(x, [0])[:, 0] + k * rhs), np.linalg.inv(m)

    def gmm(self, x: list[int], z: list[int], s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = self.part(x, z)
        si = np.linalg.inv(s)
        bread = np.linalg.inv(a @ si @ a.T)
        return bread @ a @ si @ self.part(z, [0])[:, 0], bread

    def j(self, x: list[int], z: list[int], b: np.ndarray, s: np.ndarray) -> float:
        r = self.part(z, [0])[:, 0] - self.part(z, x) @ b
        return float(r @ np.linalg.solve(s, r))

    def liml_lambda(self) -> float:
        ys = [0, *self.endog]
        w = partialled(self.g, [*self.exog, *self.excl])[np.ix_(ys, ys)]
        w1 = partialled(self.g, self.exog)[np.ix_(ys, ys)]
        r = root_inverse(w)
        return float(np.linalg.eigvalsh(r @ w1 @ r)[0])


def fe_iv(
    df: DataFrame,
    y: str,
    endog: list[str],
    instruments: list[str],
    exog: list[str] | None = None,
    absorb_: list[str] | None = None,
    vce: str = "unadjusted",
    cluster: list[str] | str | None = None,
    method: str = "2sls",
    fuller: float = 0.0,
    kclass: float | None = None,
    b0: list[float] | None = None,
    bw: float | None = None,
    kernel: str = "bartlett",
    dkraay: float | None = None,
    kiefer: bool = False,
    panel: list[str] | None = None,
    time: str | None = None,
    center: bool = False,
    dofminus: float = 0.0,
    sdofminus: float = 0.0,
    partial: list[str] | None = None,
    orthog: list[str] | None = None,
    endogtest: list[str] | None = None,
    redundant: list[str] | None = None,
    weight: str | None = None,
    weight_kind: str = "aw",
    tolerance: float = 1e-8,
    iterate: int = 10_000,
) -> Result:
    """Regress ``y`` on ``endog`` and ``exog`` with ``instruments`` for the former, absorbing ``absorb_``.

    ``method``: 2sls, liml (``fuller`` lowers its k), kclass, gmm2s or cue. ``vce``: unadjusted,
    robust or cluster (one or two columns). ``bw`` with ``kernel`` gives errors consistent under
    autocorrelation (robust with vce='robust'), within panels; ``dkraay`` sums over the cross
    section first; ``kiefer`` takes all lags of a panel. ``partial`` projects exogenous columns out
    instead of reporting them. The constant is always projected out.

    Scalars hold identification tests (idstat, widstat, cdf, per-regressor first-stage F and partial
    R2), over-identification (j), endogeneity (dwh), and for the named options cstat, endogtest
    and redstat, each with degrees of freedom and tail.
    """
    exog, effects = list(exog or []), list(absorb_ or [])
    cluster = [cluster] if isinstance(cluster, str) else list(cluster or [])
    if len(cluster) > 2:
        raise EngineError(198, "at most two cluster columns")
    if cluster and vce == "unadjusted":
        vce = "cluster"
    if method not in ("2sls", "liml", "kclass", "gmm2s", "cue", "ols"):
        raise EngineError(198, f"unknown method {method}")
    if (bw or dkraay or kiefer) and not time:
        raise EngineError(459, "a time column is needed")
    if weight and weight_kind == "pw" and vce == "unadjusted":
        vce = "robust"
    partial = list(partial or [])
    if set(partial) - set(exog):
        raise EngineError(198, "partial takes exogenous regressors")
    names = [*endog, *exog, *instruments]
    rows, w_name = weighted_sample(df, [y, *names, *effects, *cluster, *(panel or []), *([time] if time else [])], weight, weight_kind)
    columns = {"y": number(y), **{f"x{i}": number(c) for i, c in enumerate(names)}}
    part = absorb(rows, effects, columns, w_name, tolerance, iterate)
    data, n_rows = part.data, part.n_rows
    fw = w_name is not None and weight_kind == "fw"
    total_w = data.agg(F.sum(w_name)).first()[0] if w_name else float(n_rows)
    scale = 1.0 if w_name is None or fw else n_rows / total_w
    w = F.col(w_name) * F.lit(scale) if w_name else F.lit(1.0)
    n = total_w if fw else float(n_rows)
    df_a = part.df_a()
    nested = sum(part.levels[g] for g, f in enumerate(effects) if len(cluster) == 1 and nested_in(data, f, cluster))

    own = cross(data, [F.col(f"v_x{i}") - F.lit(part.means[f"x{i}"]) for i in range(len(names))], weight=w)
    inner = cross(data, [F.col(f"d_x{i}") for i in range(len(names))], weight=w)
    order = [*range(len(endog), len(endog) + len(exog)), *range(len(endog)), *range(len(endog) + len(exog), len(names))]
    ok = {order[i] for i in independent(inner[np.ix_(order, order)], np.diag(own)[order])}
    drop = [names[i] for i in range(len(names)) if i not in ok]
    endog, exog, instruments = ([c for c in cols if c not in drop] for cols in (endog, exog, instruments))
    if len(instruments) < len(endog):
        raise EngineError(481, "fewer instruments than endogenous regressors")
    at = {c: F.col(f"d_x{names.index(c)}") for c in names}
    cols = [F.col("d_y"), *[at[c] for c in [*endog, *exog, *instruments]]]
    data = data.select(*df.columns, *(["__wt"] if w_name else []), *[c.alias(f"__c{i}") for i, c in enumerate(cols)])
    cols = [F.col(f"__c{i}") for i in range(len(cols))]
    square = w if fw else w * w

    clusters: dict[str, int] = {}
    hac_panel = list(panel or [])

    def meat(z: list[int], e: Column, sigma2: float | None = None) -> np.ndarray:
        """Covariance of the summed moments z * e; with ``sigma2`` the homoskedastic one."""
        p = problem
        scores = [p.columns[i] * e for i in z]
        if center and vce != "unadjusted":
            mean = p.data.agg(*[F.sum(w * s).alias(f"s{k}") for k, s in enumerate(scores)]).first()
            scores = [s - F.lit((m or 0.0) / n) for s, m in zip(scores, mean, strict=True)]
        if dkraay:
            return hac_meat(p.data, [w * s for s in scores], time, [], kernel, dkraay)
        if kiefer:
            return clusters_meat(p.data, hac_panel, scores, w)[0]
        if bw:
            if vce == "unadjusted":
                return ac_meat(p.data, [F.sqrt(w) * p.columns[i] for i in z], F.sqrt(w) * e, n, time, hac_panel, kernel, bw)
            return hac_meat(p.data, [w * s for s in scores], time, hac_panel, kernel, bw)
        if vce == "cluster":
            out, g1 = clusters_meat(p.data, cluster[:1], scores, w)
            clusters["1"] = g1
            if len(cluster) == 2:
                m2, g2 = clusters_meat(p.data, cluster[1:], scores, w)
                m12, g12 = clusters_meat(p.data, cluster, scores, w)
                clusters["2"], clusters["12"] = g2, g12
                f1, f2, f12 = (c / max(c - 1, 1) for c in (g1, g2, g12))
                return (out * f1 + m2 * f2 - m12 * f12) / (min(g1, g2) / max(min(g1, g2) - 1, 1))
            return out
        if vce == "robust":
            return cross(p.data, scores, weight=square)
        return p.part(z, z) * (sigma2 if sigma2 is not None else float("nan"))

    problem = Problem(data, cols, w, square, n, len(endog), len(exog), df_a, meat)
    if partial:
        onto = [problem.exog[exog.index(c)] for c in partial if c in exog]
        g = problem.g
        new = []
        for i in range(len(cols)):
            coef = np.linalg.solve(g[np.ix_(onto, onto)], g[onto, i]) if onto else np.zeros(0)
            new.append(cols[i] - dot([cols[o] for o in onto], coef))
        keep = [i for i in range(len(cols)) if i not in onto]
        exog = [c for c in exog if c not in partial]
        data = problem.data.withColumns({f"__r{i}": new[i] for i in keep})
        problem = Problem(data, [F.col(f"__r{i}") for i in keep], w, square, n, len(endog), len(exog), df_a, meat)
    p = problem
    n_partial = len(partial)
    x, z = [*p.endog, *p.exog], [*p.exog, *p.excl]
    k, ell = len(x), len(z)
    robust = vce != "unadjusted" or bool(bw or dkraay or kiefer)

    lam = None
    if not endog or method == "ols":
        z, ell = x, k
        b, bread = p.k_class(x, x, 1.0)
    elif method in ("liml", "kclass"):
        lam = (p.liml_lambda() if ell > k else 1.0) if method == "liml" else float(kclass if kclass is not None else 1.0)
        if method == "liml" and fuller:
            lam -= fuller / (n - ell - n_partial)
        b, bread = p.k_class(x, z, lam)
    else:
        b, bread = p.k_class(x, z, 1.0)
    b_2sls = b if method in ("2sls", "gmm2s", "cue", "ols") else p.k_class(x, z, 1.0)[0]

    df_r = n - k - df_a - n_partial - dofminus - sdofminus
    sigma2 = p.rss(x, b) / n
    s = meat(z, p.residual(x, b_2sls), p.rss(x, b_2sls) / n)
    if method == "gmm2s" and ell >= k and endog:
        b, bread = p.gmm(x, z, s)
        s_final = meat(z, p.residual(x, b), p.rss(x, b) / n) if not robust else s
    elif method == "cue" and endog:
        b = _cue(p, x, z, np.array(b0, float) if b0 is not None else b_2sls, vce, cluster, robust)
        s_final = meat(z, p.residual(x, b), p.rss(x, b) / n)
        bread = p.gmm(x, z, s_final)[1]
    else:
        s_final = meat(z, p.residual(x, b), p.rss(x, b) / n) if method in ("liml", "kclass") else s
    rss = p.rss(x, b)
    sigma2 = rss / n

    g_min = min(v for c, v in clusters.items() if c != "12") if clusters else None
    if vce == "cluster":
        free = df_a - nested
        adj = (n - 1) / max(n - (1 if nested else 0) - k - free - n_partial - sdofminus, 1) * g_min / max(g_min - 1, 1)
        df_t = g_min - 1
    elif dkraay:
        periods = data.select(time).distinct().count()
        adj, df_t = periods / max(periods - 1, 1) * (n - 1) / max(df_r, 1), periods - 1
    else:
        adj, df_t = n / max(df_r, 1), df_r
    if method in ("gmm2s", "cue") and endog:
        v = np.linalg.inv(p.part(x, z) @ np.linalg.solve(s_final, p.part(z, x))) * adj
    elif robust:
        q = p.part(z, z)
        a = p.part(x, z) @ np.linalg.inv(q)
        v = bread @ a @ s_final @ a.T @ bread * adj
    else:
        v = bread * (rss / max(df_r, 1))
    f, f_p = wald(b, v, max(df_t, 1))
    tss = p.g[0, 0]
    scalars: dict[str, float] = {"N": n, "df_m": k, "df_r": df_t, "df_a": df_a, "rss": rss, "tss_within": tss, "r2": 1 - rss / tss if tss > 0 else float("nan"), "rmse": (rss / max(df_r, 1)) ** 0.5, "F": f, "F_p": f_p, "singletons": part.singletons}
    if lam is not None:
        scalars["lambda"] = lam
    scalars |= {f"N_clust{'' if c == '1' else c}": float(v_) for c, v_ in clusters.items()}
    if endog and method != "ols":
        scalars |= _identification(p, x, z, df_a + n_partial, robust, vce, g_min)
        scalars |= _overid(p, x, z, b, s_final, robust, rss, method)
        scalars |= _dwh(p, x, z, n, df_a + n_partial)
        if orthog:
            scalars |= _orthog(p, x, z, orthog, exog, instruments, s, robust)
        if endogtest:
            scalars |= _endogtest(p, x, z, endogtest, endog, robust)
        if redundant:
            scalars |= _redundancy(p, redundant, instruments)
    resid = p.residual(x, b)
    sample = p.data.withColumn("__resid", resid)
    raw_xb = dot([number(c) for c in [*endog, *exog]], b)
    sample = sample.withColumn("__xb", raw_xb).withColumn("__d", number(y) - F.col("__xb") - F.col("__resid")).select(*df.columns, "__resid", "__xb", "__d")
    out = Result([*endog, *exog], b, v, scalars, drop, sample=sample)
    out.model = {"y": y, "x": [*endog, *exog], "extra": {}, "effects": effects}
    out.effects = {"first_stage": _first_stage(p, endog, exog, instruments), "reduced_form": _reduced_form(p, exog, instruments)}
    return out


def _tensor(p: Problem, x: list[int], z: list[int], cluster: list[str], robust: bool) -> np.ndarray:
    """Sums of products of (z v) and (z v) with v = y, x: the robust weight of any residual follows from it."""
    v = [0, *x]
    terms = [p.columns[i] * p.columns[j] for i in z for j in v]
    t = clusters_meat(p.data, cluster[:1], terms, p.weight)[0] if cluster else cross(p.data, terms, weight=p.square)
    return t.reshape(len(z), len(v), len(z), len(v))


def _cue(p: Problem, x, z, start: np.ndarray, vce: str, cluster: list[str], robust: bool) -> np.ndarray:
    """Continuously updated GMM: BFGS on the objective, whose weight is a polynomial in the coefficients."""
    tensor = _tensor(p, x, z, cluster if vce == "cluster" else [], robust) if robust else None
    zy, zx, q = p.part(z, [0])[:, 0], p.part(z, x), p.part(z, z)

    def objective(b: np.ndarray) -> float:
        g = np.concatenate([[1.0], -b])
        s = np.einsum("ivjw,v,w->ij", tensor, g, g) if tensor is not None else q * (p.rss(x, b) / p.n)
        r = zy - zx @ b
        return float(r @ np.linalg.solve(s, r))

    scale = 1 / np.sqrt(np.maximum(np.diag(p.part(x, x)) / p.n, 1e-300))

    def gradient(b: np.ndarray) -> np.ndarray:
        h = 1e-5 * np.maximum(np.abs(b), scale * 1e-2)
        return np.array([(objective(b + e) - objective(b - e)) / (2 * e[i]) for i, e in enumerate(np.diag(h))])

    b, inv, g = start.copy(), np.linalg.inv(p.part(x, z) @ np.linalg.solve(q * (p.rss(x, start) / p.n), p.part(z, x))) / 2, gradient(start)
    for _ in range(200):
        step, t = -inv @ g, 1.0
        f0 = objective(b)
        while t > 1e-10 and objective(b + t * step) > f0 + 1e-4 * t * (g @ step):
            t /= 2
        new = b + t * step
        g_new = gradient(new)
        s, d = new - b, g_new - g
        if np.all(np.abs(s) <= 1e-10 * np.maximum(np.abs(b), scale)):
            return new
        if s @ d > 1e-300:
            rho = 1 / (s @ d)
            left = np.eye(len(b)) - rho * np.outer(s, d)
            inv = left @ inv @ left.T + rho * np.outer(s, s)
        b, g = new, g_new
    return b


def _identification(p: Problem, x, z, lost: float, robust: bool, vce: str, g_min) -> dict[str, float]:
    g = partialled(p.g, p.exog)
    k, ell = len(p.endog), len(p.excl)
    xx, zz, xz = g[np.ix_(p.endog, p.endog)], g[np.ix_(p.excl, p.excl)], g[np.ix_(p.endog, p.excl)]
    rest = p.n - lost - len(p.exog) - ell
    rx, rz = root_inverse(xx), root_inverse(zz)
    theta = rx @ xz @ rz
    u, sv, vt = np.linalg.svd(theta)
    cc = float(min(sv[:k]) ** 2)
    out = {"idstat": p.n * cc, "iddf": ell - k + 1, "cdf": cc / max(1 - cc, 1e-300) * rest / ell}
    out["widstat"] = out["cdf"]
    fitted = xz @ np.linalg.solve(zz, xz.T)
    for i, e in enumerate(p.endog):
        r2 = float(fitted[i, i] / xx[i, i])
        f = r2 / ell / max((1 - r2) / rest, 1e-300)
        out |= {f"first_F{i + 1}": f, f"first_p{i + 1}": f_tail(f, ell, rest), f"partial_r2_{i + 1}": r2}
        if k > 1:
            out[f"shea_r2_{i + 1}"] = float(np.linalg.inv(xx)[i, i] / np.linalg.inv(fitted)[i, i])
    if robust:
        # Kleibergen-Paap: the smallest singular direction of the standardised first stage and its covariance.
        coef_z = np.linalg.solve(p.part(p.exog, p.exog), p.part(p.exog, p.excl)) if p.exog else np.zeros((0, ell))
        coef_x = np.linalg.solve(p.part(p.exog, p.exog), p.part(p.exog, p.endog)) if p.exog else np.zeros((0, k))
        zt = [p.columns[c] - dot([p.columns[e] for e in p.exog], coef_z[:, i]) for i, c in enumerate(p.excl)]
        xt = [p.columns[c] - dot([p.columns[e] for e in p.exog], coef_x[:, i]) for i, c in enumerate(p.endog)]
        work = p.data.withColumns({**{f"__z{i}": c for i, c in enumerate(zt)}, **{f"__x{i}": c for i, c in enumerate(xt)}})
        pi = np.linalg.solve(zz, xz.T)  # ell by k
        # Under the null the rank is k - 1: the last left and right singular directions vanish.
        a_perp, b_perp = u[:, k - 1 :], vt[k - 1 :].T
        lam = (a_perp.T @ theta @ b_perp).ravel()
        sel = np.kron(a_perp.T, b_perp.T) @ np.kron(rx, rz)
        for wald_form in (False, True):
            e = [F.col(f"__x{i}") - (dot([F.col(f"__z{j}") for j in range(ell)], pi[:, i]) if wald_form else F.lit(0.0)) for i in range(k)]
            pairs = work.withColumns({f"__k{i}_{j}": e[i] * F.col(f"__z{j}") for i in range(k) for j in range(ell)})
            omega = _score_cov(p, pairs, [F.col(f"__k{i}_{j}") for i in range(k) for j in range(ell)])
            rk = float(lam @ np.linalg.pinv(sel @ omega @ sel.T) @ lam)
            if wald_form:
                clustered = vce == "cluster" and g_min
                adj = (g_min - 1) / g_min if clustered else 1.0
                out["widstat"] = rk / (p.n - 1 if clustered else p.n) * rest * adj / ell
            else:
                out["idstat"] = rk
    out["idp"] = chi2_tail(out["idstat"], out["iddf"])
    return out


def _score_cov(p: Problem, data: DataFrame, scores: list[Column]) -> np.ndarray:
    """Covariance of summed scores in the form that the estimation asked for, by its own meat function."""
    saved_data, saved_cols = p.data, p.columns
    try:
        p.data, p.columns = data, scores
        return p.meat(list(range(len(scores))), F.lit(1.0))
    finally:
        p.data, p.columns = saved_data, saved_cols


def _overid(p: Problem, x, z, b, s, robust: bool, rss: float, method: str) -> dict[str, float]:
    df = len(z) - len(x)
    if df <= 0:
        return {"j": 0.0, "jdf": 0}
    if robust and method in ("2sls", "liml", "kclass"):
        b2, _ = p.gmm(x, z, s)
        j = p.j(x, z, b2, s)
    else:
        j = p.j(x, z, b, s if robust else p.part(z, z) * (rss / p.n))
    return {"j": j, "jdf": df, "jp": chi2_tail(j, df)}


def _dwh(p: Problem, x, z, n: float, lost: float) -> dict[str, float]:
    """Durbin-Wu-Hausman: F of the first-stage residuals added to the regression."""
    q = p.part(z, z)
    pi = np.linalg.solve(q, p.part(z, p.endog))
    basis = np.eye(len(p.g))
    extra = np.zeros((len(p.endog), len(p.g)))
    for i, e in enumerate(p.endog):
        extra[i] = basis[e]
        extra[i, z] -= pi[:, i]
    rows = np.vstack([basis[x], extra])
    m, my = rows @ p.g @ rows.T, rows @ p.g[:, 0]
    keep = independent(m)
    full = p.g[0, 0] - my[keep] @ np.linalg.solve(m[np.ix_(keep, keep)], my[keep])
    base = p.g[0, 0] - my[: len(x)] @ np.linalg.solve(m[: len(x), : len(x)], my[: len(x)])
    q_df = len(keep) - len(x)
    rest = n - lost - len(keep)
    if q_df <= 0 or rest <= 0 or full <= 0:
        return {}
    f = (base - full) / q_df / (full / rest)
    return {"dwh": f, "dwh_df": q_df, "dwh_p": f_tail(f, q_df, rest)}


def _j_of(p: Problem, x, z, s: np.ndarray | None, sigma2: float | None) -> float:
    if len(z) <= len(x):
        return 0.0
    weight = s if s is not None else p.part(z, z) * sigma2
    b, _ = p.gmm(x, z, weight)
    return p.j(x, z, b, weight)


def _orthog(p: Problem, x, z, tested, exog, instruments, s, robust) -> dict[str, float]:
    """C statistic: J of all instruments less J without the tested ones, with one weight."""
    names = {**dict(zip(exog, p.exog, strict=True)), **dict(zip(instruments, p.excl, strict=True))}
    if set(tested) - set(names):
        raise EngineError(198, "orthog takes instruments")
    out = [names[c] for c in tested]
    rest = [i for i in z if i not in out]
    at = [z.index(i) for i in rest]
    if len(rest) < len(x):
        raise EngineError(481, "the equation is not identified without the tested instruments")
    b_full = p.k_class(x, z)[0]
    sigma2 = p.rss(x, b_full) / p.n
    c = _j_of(p, x, z, s if robust else None, sigma2) - _j_of(p, x, rest, s[np.ix_(at, at)] if robust else None, sigma2)
    c = max(c, 0.0)
    return {"cstat": c, "cstat_df": len(out), "cstat_p": chi2_tail(c, len(out))}


def _endogtest(p: Problem, x, z, tested, endog, robust) -> dict[str, float]:
    """J with the tested regressors as their own instruments less the original J, with the weight of the former."""
    if set(tested) - set(endog):
        raise EngineError(198, "endogtest takes endogenous regressors")
    more = [p.endog[endog.index(c)] for c in tested]
    big = [*z, *more]
    b = p.k_class(x, big)[0]
    sigma2 = p.rss(x, b) / p.n
    s = p.meat(big, p.residual(x, b), sigma2)
    small = list(range(len(z)))
    c = _j_of(p, x, big, s if robust else None, sigma2) - _j_of(p, x, z, s[np.ix_(small, small)] if robust else None, sigma2)
    c = max(c, 0.0)
    return {"estat": c, "estat_df": len(more), "estat_p": chi2_tail(c, len(more))}


def _redundancy(p: Problem, tested, instruments) -> dict[str, float]:
    """LM test that the tested instruments add nothing to the others for the endogenous regressors."""
    if set(tested) - set(instruments):
        raise EngineError(198, "redundant takes excluded instruments")
    t = [p.excl[instruments.index(c)] for c in tested]
    g = partialled(p.g, [*p.exog, *[i for i in p.excl if i not in t]])
    zx = g[np.ix_(t, p.endog)]
    lm = p.n * float(np.trace(zx.T @ np.linalg.solve(g[np.ix_(t, t)], zx) @ np.linalg.inv(g[np.ix_(p.endog, p.endog)])))
    df = len(p.endog) * len(t)
    return {"redstat": lm, "redstat_df": df, "redstat_p": chi2_tail(lm, df)}


def _first_stage(p: Problem, endog, exog, instruments) -> list[tuple[str, str, float]]:
    """(endogenous regressor, instrument, coefficient) of every first stage."""
    z = [*p.exog, *p.excl]
    pi = np.linalg.solve(p.part(z, z), p.part(z, p.endog)) if endog else np.zeros((0, 0))
    return [(e, c, float(pi[i, j])) for j, e in enumerate(endog) for i, c in enumerate([*exog, *instruments])]


def _reduced_form(p: Problem, exog, instruments) -> list[tuple[str, float]]:
    z = [*p.exog, *p.excl]
    b = np.linalg.solve(p.part(z, z), p.part(z, [0])[:, 0]) if z else np.zeros(0)
    return [(c, float(v)) for c, v in zip([*exog, *instruments], b, strict=True)]
