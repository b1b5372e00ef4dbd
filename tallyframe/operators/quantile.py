"""Quantile regression: exact linear-programming solutions, sparsity estimates and variances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import EngineError, need, number, written
from ..functions.distributions import normal_pdf, normal_quantile
from ..functions.order_stats import order_statistics
from .fe import absorb, complete
from .moments import Result, clusters_meat, cross, dot, independent

#: Numbers (rows times columns) that the solver holds on the driver; larger problems shrink first.
MOST_NUMBERS = 20_000_000


def bandwidth(n: float, tau: float, method: str = "hsheather", alpha: float = 0.05) -> float:
    z, za = normal_quantile(tau), normal_quantile(1 - alpha / 2)
    f = normal_pdf(z)
    if method == "hsheather":
        return n ** (-1 / 3) * za ** (2 / 3) * (1.5 * f * f / (2 * z * z + 1)) ** (1 / 3)
    if method == "bofinger":
        return (4.5 * f**4 / (n * (2 * z * z + 1) ** 2)) ** 0.2
    if method == "chamberlain":
        return za * (tau * (1 - tau) / n) ** 0.5
    raise EngineError(198, f"unknown bandwidth {method}")


def interior_point(x: np.ndarray, y: np.ndarray, tau: float, w: np.ndarray | None = None, tol: float = 1e-12, most: int = 200) -> np.ndarray:
    """Minimise the check loss by a primal-dual interior point with predictor and corrector steps.

    Solves max y'a over x'a = (1 - tau) x'1 with 0 <= a <= 1 (times the row weights).
    """
    n, k = x.shape
    cap = np.ones(n) if w is None else w
    a = (1 - tau) * cap
    s = cap - a
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    r = y - x @ b
    r = np.where(r == 0, 1e-3 * max(1.0, np.abs(y).max()), r)
    z = np.maximum(-r, 0) + 1e-3 * max(np.abs(r).mean(), 1e-12)
    v = z + r  # v - z = y - x b; both positive
    low = v <= 0
    z[low] -= v[low] - 1e-3 * max(np.abs(r).mean(), 1e-12)
    v = z + r
    gap = a @ z + s @ v
    scale = max(1.0, np.abs(y).sum())
    for _ in range(most):
        if gap <= tol * scale:
            break
        q = 1 / (z / a + v / s)
        rhs_r = y - x @ b - v + z
        xq = x * q[:, None]
        m = xq.T @ x
        rd = (1 - tau) * x.T @ cap - x.T @ a

        def solve(ca: np.ndarray, cs: np.ndarray, m=m, q=q, a=a, s=s, rhs_r=rhs_r, rd=rd):
            # ca, cs: right sides of a z and s v; da from the normal equations.
            t = rhs_r + ca / a - cs / s
            db = np.linalg.solve(m, x.T @ (q * t) - rd)
            da = q * (t - x @ db)
            return db, da, (ca - z * da) / a, (cs + v * da) / s

        db, da, dz, dv = solve(-a * z, -s * v)

        def step(p: np.ndarray, d: np.ndarray) -> float:
            neg = d < 0
            return min(1.0, 0.9995 * float(np.min(-p[neg] / d[neg]))) if neg.any() else 1.0

        fp, fd = min(step(a, da), step(s, -da)), min(step(z, dz), step(v, dv))
        mu = gap / (2 * n)
        aff = (a + fp * da) @ (z + fd * dz) + (s - fp * da) @ (v + fd * dv)
        target = mu * (aff / gap) ** 3
        db, da, dz, dv = solve(target - a * z - da * dz, target - s * v + da * dv)
        fp, fd = min(step(a, da), step(s, -da)), min(step(z, dz), step(v, dv))
        a, s, b, z, v = a + fp * da, s - fp * da, b + fd * db, z + fd * dz, v + fd * dv
        new = a @ z + s @ v
        if not np.isfinite(new) or abs(new - gap) <= 1e-16 * scale:
            break
        gap = new
    return vertex(x, y, tau, b, cap)


def check_loss(r: np.ndarray, tau: float, w: np.ndarray | float = 1.0) -> float:
    return float((w * r * (tau - (r < 0))).sum())


def vertex(x: np.ndarray, y: np.ndarray, tau: float, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The exact solution next to ``b``: k rows of zero residual, then simplex steps while the loss falls."""
    n, k = x.shape
    r = y - x @ b
    order = np.argsort(np.abs(r), kind="stable")
    basis: list[int] = []
    q = np.zeros((0, k))
    for i in order[: max(50 * k, 500)]:
        row = x[i] - q.T @ (q @ x[i])
        if np.linalg.norm(row) > 1e-9 * max(np.linalg.norm(x[i]), 1e-300):
            q = np.vstack([q, row / np.linalg.norm(row)])
            basis.append(int(i))
            if len(basis) == k:
                break
    if len(basis) < k:
        return b
    best = np.linalg.solve(x[basis], y[basis])
    for _ in range(200):
        r = y - x @ best
        r[basis] = 0.0
        inv = np.linalg.inv(x[basis])
        outside = np.ones(n, bool)
        outside[basis] = False
        sign = np.where(r > 0, tau, np.where(r < 0, tau - 1, 0.0)) * w
        dual = inv.T @ (x[outside].T @ sign[outside])  # row i of the basis may take -dual in [-(1 - tau), tau] w
        hi, lo = dual - (1 - tau) * w[basis], -dual - tau * w[basis]
        gain = np.maximum(hi, lo)
        i = int(np.argmax(gain))
        if gain[i] <= 1e-9 * max(1.0, np.abs(dual).max()):
            return best
        # The basis row i gets a residual: below zero if its dual is too large, above if too small.
        direction = inv[:, i] * (1.0 if hi[i] > lo[i] else -1.0)
        slope = x @ direction
        ok = outside & (np.abs(slope) > 1e-12)
        t = np.where(ok, r / np.where(ok, slope, 1), np.inf)
        t[~(t > 1e-14)] = np.inf
        hits = np.argsort(t, kind="stable")
        fall = -gain[i]
        chosen = None
        for h in hits:
            if not np.isfinite(t[h]):
                break
            fall += abs(slope[h]) * w[h]
            if fall >= 0:
                chosen = int(h)
                break
        if chosen is None:
            return best
        new_basis = [*basis[:i], chosen, *basis[i + 1 :]]
        try:
            new = np.linalg.solve(x[new_basis], y[new_basis])
        except np.linalg.LinAlgError:
            return best
        if check_loss(y - x @ new, tau, w) >= check_loss(y - x @ best, tau, w) - 1e-15 * abs(check_loss(y - x @ best, tau, w)):
            return best
        best, basis = new, new_basis
    return best


def solve_quantile(df: DataFrame, x: list[Column], y: Column, tau: float, rows: int, tol: float, most: int) -> np.ndarray:
    """Solve on the driver if the numbers fit; else fit a sample, keep the rows near the fit, fold the rest into two sums, check and repeat."""
    k = len(x)
    work = df.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], y.alias("y"))
    names = [f"x{i}" for i in range(k)]

    def arrays(d: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        t = d.toArrow()
        return np.column_stack([t.column(n).to_numpy() for n in names]).astype(float), t.column("y").to_numpy().astype(float)

    if rows * (k + 1) <= MOST_NUMBERS:
        return interior_point(*arrays(work), tau, tol=tol, most=most)
    work = written(work, "qr-rows")
    size = int(MOST_NUMBERS / (k + 1) / 4)
    sample = work.filter(F.pmod(F.xxhash64(*names, "y"), F.lit(1_000_000)) < int(1_000_000 * size / rows))
    b = interior_point(*arrays(sample), tau, tol=tol, most=most)
    fit = lambda b: F.col("y") - dot([F.col(n) for n in names], b)
    share = size / rows
    for _ in range(30):
        lo, hi = (order_statistics(work.select(fit(b).alias("r")), "r", [max(1, int(rows * max(0.0, tau - share))), min(rows, int(rows * min(1.0, tau + share)) + 1)])[r] for r in (max(1, int(rows * max(0.0, tau - share))), min(rows, int(rows * min(1.0, tau + share)) + 1)))
        r = fit(b)
        side = F.when(r < lo, -1).when(r > hi, 1).otherwise(0)
        globs = work.withColumn("s", side).filter("s <> 0").groupBy("s").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names], F.sum("y").alias("y")).collect()
        gx, gy = arrays(work.filter(side == 0))
        far = 1e6 * max(1.0, np.abs(gy).max(initial=1.0)) * 10
        ex = np.array([[g[n] for n in names] for g in globs], float).reshape(-1, k)
        ey = np.array([g["s"] * far * g["n"] for g in globs], float)
        new = interior_point(np.vstack([gx, ex]), np.append(gy, ey), tau, tol=tol, most=most)
        wrong = work.filter(((r < lo) & (fit(new) > 0)) | ((r > hi) & (fit(new) < 0))).count()
        b = new
        if wrong == 0:
            return b
        share = min(1.0, share * 1.5)
    raise EngineError(430, "the quantile regression did not converge")


def quantile_reg(
    df: DataFrame,
    y: str,
    x: list[str],
    quantile: float = 0.5,
    absorb_: list[str] | None = None,
    vce: str = "iid",
    cluster: list[str] | str | None = None,
    denmethod: str = "fitted",
    bwmethod: str = "hsheather",
    tolerance: float = 1e-12,
    maxiter: int = 200,
) -> Result:
    """Quantile regression of ``y`` on ``x`` and a constant.

    ``vce``: iid, robust (Powell) or cluster. ``denmethod``: fitted (two more fits at quantile plus and
    minus the bandwidth), residual (difference quotient of residual quantiles) or kernel
    (Epanechnikov). ``absorb_`` removes effects from y and x first, which approximates.
    """
    if not 0 < quantile < 1:
        raise EngineError(198, "the quantile lies between 0 and 1")
    cluster = [cluster] if isinstance(cluster, str) else list(cluster or [])
    if vce not in ("iid", "robust", "cluster") or (vce == "cluster") != bool(cluster):
        raise EngineError(198, f"vce {vce}")
    if denmethod not in ("fitted", "residual", "kernel"):
        raise EngineError(198, f"unknown denmethod {denmethod}")
    effects = list(absorb_ or [])
    need(df, y, *x, *effects, *cluster)
    rows = complete(df, list(dict.fromkeys([y, *x, *effects, *cluster])))
    df_a = 0
    if effects:
        part = absorb(rows, effects, {"y": number(y), **{f"x{i}": number(c) for i, c in enumerate(x)}})
        data = part.data.select(*df.columns, F.col("d_y").alias("__y"), *[F.col(f"d_x{i}").alias(f"__x{i}") for i in range(len(x))])
        df_a = part.df_a()
    else:
        data = rows.select(*df.columns, number(y).alias("__y"), *[number(c).alias(f"__x{i}") for i, c in enumerate(x)])
    data = written(data.withColumn(f"__x{len(x)}", F.lit(1.0)), "qr-data")
    every = [F.col(f"__x{i}") for i in range(len(x) + 1)]
    yc = F.col("__y")
    gram = cross(data, every)
    n = int(round(gram[-1, -1]))
    if n == 0:
        raise EngineError(2000, "no observations")
    first = [len(x), *range(len(x))]  # the constant stays whatever the regressors are
    keep = sorted(first[i] for i in independent(gram[np.ix_(first, first)]))
    cols, k = [every[i] for i in keep], len(keep)
    solve = lambda tau: solve_quantile(data, cols, yc, tau, n, tolerance, maxiter)
    b = solve(quantile)
    resid = yc - dot(cols, b)
    h = bandwidth(n, quantile, bwmethod)
    inside = 0 < quantile - h and quantile + h < 1
    xx = gram[np.ix_(keep, keep)]
    inv = np.linalg.inv(xx)
    means = gram[keep, -1] / n
    data = data.withColumn("__resid", resid)
    density: Column | None = None
    if denmethod == "fitted":
        if inside:
            up, down = solve(quantile + h), solve(quantile - h)
            sparsity = float(means @ (up - down)) / (2 * h)
            density = F.lit(2 * h) / F.greatest(dot(cols, up - down), F.lit(1e-10))
        else:
            sparsity = 1.0
    elif denmethod == "residual":
        lo, hi = max(1.0 / n, quantile - h), min(1 - 1.0 / n, quantile + h)
        r1, r2 = -(-int(n * lo * 1e9) // 10**9) or 1, -(-int(n * hi * 1e9) // 10**9) or 1
        found = order_statistics(data.select("__resid"), "__resid", [r1, r2])
        sparsity = (found[r2] - found[r1]) / (hi - lo)
    else:
        sd = data.agg(F.stddev("__resid")).first()[0] or 1.0
        q1, q3 = (order_statistics(data.select("__resid"), "__resid", [max(1, n // 4), max(1, 3 * n // 4)])[r] for r in (max(1, n // 4), max(1, 3 * n // 4)))
        width = min(sd, (q3 - q1) / 1.34 or sd) * (normal_quantile(min(0.999, quantile + h)) - normal_quantile(max(0.001, quantile - h)))
        u = F.col("__resid") / F.lit(max(width, 1e-300))
        f0 = data.agg(F.sum(F.when(F.abs(u) < 1, 0.75 * (1 - u * u)).otherwise(0.0))).first()[0] / (n * max(width, 1e-300))
        sparsity = 1 / max(f0, 1e-300)
    tau2 = quantile * (1 - quantile)
    n_clust = None
    if vce == "iid":
        v = sparsity**2 * tau2 * inv
    elif vce == "robust":
        if density is not None:
            d = np.linalg.inv(cross(data, cols, weight=density))
            v = tau2 * d @ xx @ d
        else:
            psi = F.lit(quantile) - (F.col("__resid") < 0).cast("double")
            v = sparsity**2 * inv @ cross(data, [c * psi for c in cols]) @ inv
    else:
        psi = F.lit(quantile) - (F.col("__resid") < 0).cast("double")
        meat, n_clust = clusters_meat(data, cluster, [c * psi for c in cols])
        v = sparsity**2 * inv @ meat @ inv * n_clust / max(n_clust - 1, 1) * (n - 1) / max(n - k, 1)
    tau = F.lit(quantile)
    raw_rank = min(n, max(1, int(np.ceil(n * quantile))))
    raw = order_statistics(data.select("__y"), "__y", [raw_rank])[raw_rank]
    loss = lambda r: F.sum(r * (tau - (r < 0).cast("double")))
    dev, raw_dev = data.agg(loss(F.col("__resid")), loss(yc - F.lit(raw))).first()
    names = [*x, "_cons"]
    full_b, full_v = np.zeros(len(names)), np.zeros((len(names), len(names)))
    full_b[keep] = b
    full_v[np.ix_(keep, keep)] = v
    scalars = {"N": n, "df_m": k - 1, "df_r": (n_clust - 1) if n_clust else n - k - df_a, "q": quantile, "q_v": raw, "sum_adev": dev, "sum_rdev": raw_dev, "r2_p": 1 - dev / raw_dev if raw_dev > 0 else float("nan"), "sparsity": sparsity, "bwidth": h, "df_a": df_a}
    if n_clust is not None:
        scalars["N_clust"] = n_clust
    xb = dot([number(c) for c in x], full_b[:-1]) + F.lit(float(full_b[-1]))
    sample = data.withColumn("__xb", xb).withColumn("__d", F.lit(0.0)).select(*df.columns, "__resid", "__xb", "__d")
    out = Result(names, full_b, full_v, scalars, [names[i] for i in range(len(x)) if i not in keep], sample=sample)
    out.model = {"y": y, "x": x, "extra": {}, "effects": effects}
    return out
