"""Estimators against dense NumPy computations on dummies."""

import numpy as np
import pandas as pd
import pytest

from tallyframe.common import EngineError
from tallyframe.functions.distributions import chi2_tail, f_tail, normal_quantile, t_tail
from tallyframe.operators.iv import KERNELS, fe_iv, kernel_weight
from tallyframe.operators.matching import binary_fit, normal_column
from tallyframe.operators.quantile import check_loss, interior_point, quantile_reg
from tallyframe.operators.regression import differenced, factor_columns, fe_ols, lagged, predict


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    n = 600
    f1, f2, t = rng.integers(0, 25, n), rng.integers(0, 12, n), rng.integers(0, 20, n)
    x1, z1, z2 = rng.normal(size=n) + f1 / 10, rng.normal(size=n), rng.normal(size=n)
    u = rng.normal(size=n)
    x2 = 0.7 * z1 + 0.4 * z2 + 0.5 * u + f2 / 5
    y = 1 + 2 * x1 - x2 + f1 / 3 - f2 / 4 + u
    w = rng.integers(1, 5, n).astype(float)
    pdf = pd.DataFrame({"id": np.arange(n), "f1": f1, "f2": f2, "t": t, "x1": x1, "x2": x2, "z1": z1, "z2": z2, "y": y, "w": w})
    return pdf, spark.createDataFrame(pdf).cache()


def dummies(*codes):
    return np.column_stack([np.eye(c.max() + 1)[c] for c in codes])


def residualise(d, *cols):
    q = d @ np.linalg.pinv(d)
    return [c - q @ c for c in cols]


def test_two_way_effects(panel):
    pdf, df = panel
    d = dummies(pdf.f1.values, pdf.f2.values)
    y, x1, x2 = residualise(d, pdf.y.values, pdf.x1.values, pdf.x2.values)
    x = np.column_stack([x1, x2])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    n, rank = len(y), np.linalg.matrix_rank(d)
    r = fe_ols(df, "y", ["x1", "x2"], ["f1", "f2"])
    assert np.allclose(r.b[:2], b, rtol=1e-7)
    assert r.scalars["df_a"] == rank
    v = np.linalg.inv(x.T @ x) * (e @ e) / (n - 2 - rank)
    assert np.allclose(r.v[:2, :2], v, rtol=1e-6)
    got = {row["id"]: row["__resid"] for row in r.sample.select("id", "__resid").collect()}
    assert np.allclose([got[i] for i in pdf.id], e, atol=1e-6)
    rob = fe_ols(df, "y", ["x1", "x2"], ["f1", "f2"], vce="robust")
    i = np.linalg.inv(x.T @ x)
    assert np.allclose(rob.v[:2, :2], i @ (x.T * e**2) @ x @ i * n / (n - 2 - rank), rtol=1e-6)
    clu = fe_ols(df, "y", ["x1", "x2"], ["f1", "f2"], cluster="t")
    g = np.array([(x * e[:, None])[pdf.t.values == t].sum(axis=0) for t in np.unique(pdf.t)])
    m = len(g)
    assert np.allclose(clu.v[:2, :2], i @ g.T @ g @ i * (n - 1) / (n - 2 - rank) * m / (m - 1), rtol=1e-6)
    assert clu.scalars["df_r"] == m - 1


def test_no_effects_and_weights(panel):
    pdf, df = panel
    x = np.column_stack([pdf.x1, pdf.x2, np.ones(len(pdf))])
    for kind in ("aw", "fw"):
        w = pdf.w.values if kind == "fw" else pdf.w.values * len(pdf) / pdf.w.sum()
        b = np.linalg.solve((x.T * w) @ x, (x.T * w) @ pdf.y.values)
        n = w.sum()
        e = pdf.y.values - x @ b
        r = fe_ols(df, "y", ["x1", "x2"], weight="w", weight_kind=kind)
        assert np.allclose(r.b, b, rtol=1e-8)
        assert np.allclose(r.v, np.linalg.inv((x.T * w) @ x) * (w * e**2).sum() / (n - 3), rtol=1e-7)
    rob = fe_ols(df, "y", ["x1", "x2"], vce="robust")
    b = np.linalg.lstsq(x, pdf.y.values, rcond=None)[0]
    e = pdf.y.values - x @ b
    i = np.linalg.inv(x.T @ x)
    assert np.allclose(rob.v, i @ (x.T * e**2) @ x @ i * len(e) / (len(e) - 3), rtol=1e-7)


def test_collinear_singletons_and_distributed_path(panel, spark):
    from pyspark.sql import functions as F

    from tallyframe.operators.fe import absorb

    pdf, df = panel
    r = fe_ols(df.withColumn("x3", F.col("x1") * 2 + F.col("x2")), "y", ["x1", "x2", "x3"], ["f1"])
    assert r.dropped == ["x3"] and r.b[2] == 0
    lone = df.unionByName(df.limit(1).withColumn("f1", F.lit(99).cast("long")).withColumn("id", F.lit(-1).cast("long")))
    s = fe_ols(lone, "y", ["x1"], ["f1", "f2"])
    assert s.scalars["singletons"] == 1 and s.scalars["N"] == len(pdf)
    cols = {"y": F.col("y"), "x": F.col("x1")}
    a = absorb(df, ["f1", "f2"], cols, tol=1e-9)
    b = absorb(df, ["f1", "f2"], cols, tol=1e-9, most_cells=0)
    left = {r.id: (r.d_y, r.d_x) for r in a.data.select("id", "d_y", "d_x").collect()}
    right = {r.id: (r.d_y, r.d_x) for r in b.data.select("id", "d_y", "d_x").collect()}
    assert np.allclose([left[i] for i in pdf.id], [right[i] for i in pdf.id], atol=1e-6)
    assert (a.levels, a.components) == (b.levels, b.components)
    assert dict(b.groups.dtypes)["__group"] == "int" and sorted({r["__group"] for r in b.groups.collect()}) == list(range(1, b.components + 1))

    def whole(part, variable):  # the sum of a row's effects, which both paths agree on
        out = df
        for g, f in enumerate(("f1", "f2")):
            out = out.join(part.effects[g].select(F.col("__level").alias(f), F.col(f"__e{g}_{variable}").alias(f"e{g}")), f)
        return {r.id: r.e0 + r.e1 for r in out.collect()}

    for v in "yx":
        left, right = whole(a, v), whole(b, v)
        assert np.allclose([left[i] for i in pdf.id], [right[i] for i in pdf.id], atol=1e-6)


def test_estimators_on_the_distributed_path(panel, monkeypatch):
    from functools import partial

    from tallyframe.operators import binned, fe, iv, regression

    pdf, df = panel

    def run():
        ols = fe_ols(df, "y", ["x1"], ["f1", "f2"])
        means = binned.binned_means(df, "y", "x1", nquantiles=5, absorb_=["f1"], method="binsreg").bins.orderBy("bin").toPandas()
        two = fe_iv(df, "y", ["x2"], ["z1", "z2"], absorb_=["f1"])
        return ols, means, two

    ols, means, two = run()
    for module in (regression, binned, iv):
        monkeypatch.setattr(module, "absorb", partial(fe.absorb, most_cells=0))
    far, far_means, far_two = run()
    assert np.allclose(ols.b, far.b, atol=1e-7) and np.allclose(ols.v, far.v, rtol=1e-5) and np.allclose(two.b, far_two.b, atol=1e-6)
    assert np.allclose(means.y_mean, far_means.y_mean, atol=1e-6)
    assert set(far.effects) == set(ols.effects) == {"f1", "f2", "__groups"} and all(far.effects[f].count() == ols.effects[f].count() for f in far.effects)


def test_factors_lags_and_prediction(panel):
    from pyspark.sql import functions as F

    pdf, df = panel
    r = fe_ols(df, "y", ["x1"], extra=factor_columns(df, "f2"))
    a = fe_ols(df, "y", ["x1"], ["f2"])
    assert np.isclose(r.b[0], a.b[0], rtol=1e-8)
    out = predict(df, a, "xb", "p").toPandas()
    assert np.allclose(out.p, a.b[0] * out.x1 + a.b[1])
    d = predict(df, a, "xbd", "p").toPandas()
    res = predict(df, a, "residuals", "e").toPandas()
    assert np.allclose(d.sort_values("id").p.values + res.sort_values("id").e.values, pdf.y.values, atol=1e-8)
    s = df.sparkSession.createDataFrame([(1, 1, 5.0), (1, 2, 7.0), (1, 4, 9.0), (2, 1, 1.0)], "p int, t int, v double")
    got = {(x.p, x.t): (x.l, x.d) for x in s.select("p", "t", lagged(s, "v", "t", ["p"]).alias("l"), differenced(s, "v", "t", ["p"]).alias("d")).collect()}
    assert got == {(1, 1): (None, None), (1, 2): (5.0, 2.0), (1, 4): (None, None), (2, 1): (None, None)}
    with pytest.raises(EngineError):
        predict(df, a, "nonsense")
    assert F is not None


def two_sls(x, z, y):
    p = z @ np.linalg.solve(z.T @ z, z.T @ x)
    b = np.linalg.solve(p.T @ x, p.T @ y)
    return b, p


def test_iv(panel):
    pdf, df = panel
    d = dummies(pdf.f1.values)
    y, x1, x2, z1, z2 = residualise(d, *(pdf[c].values for c in ("y", "x1", "x2", "z1", "z2")))
    x, z = np.column_stack([x2, x1]), np.column_stack([x1, z1, z2])
    n, a, k, ell = len(y), d.shape[1], 2, 3
    b, p = two_sls(x, z, y)
    e = y - x @ b
    r = fe_iv(df, "y", ["x2"], ["z1", "z2"], ["x1"], ["f1"], orthog=["z2"], endogtest=["x2"], redundant=["z2"])
    assert np.allclose(r.b, b, rtol=1e-7)
    bread = np.linalg.inv(p.T @ p)
    assert np.allclose(r.v, bread * (e @ e) / (n - k - a), rtol=1e-7)
    proj = z @ np.linalg.solve(z.T @ z, z.T @ e)
    assert np.isclose(r.scalars["j"], n * (e @ proj) / (e @ e), rtol=1e-6) and r.scalars["jdf"] == 1
    # first stage F by two regressions
    full, part = np.linalg.lstsq(z, x2, rcond=None)[0], np.linalg.lstsq(x1[:, None], x2, rcond=None)[0]
    rss1, rss0 = ((x2 - z @ full) ** 2).sum(), ((x2 - x1 * part) ** 2).sum()
    f = (rss0 - rss1) / 2 / (rss1 / (n - a - ell))
    assert np.isclose(r.scalars["cdf"], f, rtol=1e-6) and np.isclose(r.scalars["first_F1"], f, rtol=1e-6)
    assert np.isclose(r.scalars["idstat"], n * (1 - rss1 / rss0), rtol=1e-6)
    assert np.isclose(r.scalars["cstat"], r.scalars["j"], rtol=1e-6)  # one over-identifying restriction
    v = x2 - z @ full
    big = np.column_stack([x, v])
    rss_b = ((y - big @ np.linalg.lstsq(big, y, rcond=None)[0]) ** 2).sum()
    rss_s = ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()
    assert np.isclose(r.scalars["dwh"], (rss_s - rss_b) / (rss_b / (n - a - 3)), rtol=1e-6)
    rob = fe_iv(df, "y", ["x2"], ["z1", "z2"], ["x1"], ["f1"], vce="robust")
    assert np.allclose(rob.v, bread @ (p.T * e**2) @ p @ bread * n / (n - k - a), rtol=1e-6)
    s = (z.T * e**2) @ z
    g = fe_iv(df, "y", ["x2"], ["z1", "z2"], ["x1"], ["f1"], vce="robust", method="gmm2s")
    xz = x.T @ z
    bg = np.linalg.solve(xz @ np.linalg.solve(s, xz.T), xz @ np.linalg.solve(s, z.T @ y))
    assert np.allclose(g.b, bg, rtol=1e-6)
    gz = z.T @ (y - x @ bg)
    assert np.isclose(rob.scalars["j"], gz @ np.linalg.solve(s, gz), rtol=1e-6)
    # robust weak-identification F: Wald of the excluded instruments in the first stage
    zt = z[:, 1:] - np.outer(x1, x1 @ z[:, 1:] / (x1 @ x1))
    xt = x2 - x1 * (x1 @ x2 / (x1 @ x1))
    pi = np.linalg.solve(zt.T @ zt, zt.T @ xt)
    m = (zt.T * (xt - zt @ pi) ** 2) @ zt
    q = zt.T @ zt
    wald = pi @ q @ np.linalg.solve(m, q @ pi)
    assert np.isclose(rob.scalars["widstat"], wald / n * (n - a - ell) / 2, rtol=1e-6)
    m0 = (zt.T * xt**2) @ zt
    assert np.isclose(rob.scalars["idstat"], (zt.T @ xt) @ np.linalg.solve(m0, zt.T @ xt), rtol=1e-6)


def test_iv_k_class_cue_and_clusters(panel):
    pdf, df = panel
    args = ("y", ["x2"], ["z1", "z2"], ["x1"])
    one = np.ones(len(pdf))
    y, x1, x2, z1, z2 = residualise(one[:, None], *(pdf[c].values for c in ("y", "x1", "x2", "z1", "z2")))
    x, z = np.column_stack([x2, x1]), np.column_stack([x1, z1, z2])

    def anderson_rubin(b):
        e = y - x2 * b
        ex = e - x1 * (x1 @ e / (x1 @ x1))
        ez = e - z @ np.linalg.lstsq(z, e, rcond=None)[0]
        return (ex @ ex) / (ez @ ez)

    liml = fe_iv(df, *args, method="liml")
    base = anderson_rubin(liml.b[0])
    assert np.isclose(base, liml.scalars["lambda"], rtol=1e-6)
    assert all(anderson_rubin(liml.b[0] + h) >= base for h in (-1e-3, 1e-3))
    full = fe_iv(df, *args, method="liml", fuller=1.0)
    assert np.isclose(full.scalars["lambda"], liml.scalars["lambda"] - 1 / (len(pdf) - 3), rtol=1e-9)
    assert np.allclose(fe_iv(df, *args, method="kclass", kclass=1.0).b, fe_iv(df, *args).b, rtol=1e-9)
    cue = fe_iv(df, *args, method="cue", vce="robust")

    def objective(b):
        e = y - x @ b
        g = z.T @ e
        return g @ np.linalg.solve((z.T * e**2) @ z, g)

    assert all(objective(cue.b + np.array(h)) >= objective(cue.b) - 1e-9 for h in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)))
    b, p = two_sls(x, z, y)
    e = y - x @ b
    bread = np.linalg.inv(p.T @ p)

    def meat(c):
        g = np.array([(p * e[:, None])[c == v].sum(axis=0) for v in np.unique(c)])
        return g.T @ g * len(g) / (len(g) - 1), len(g)

    n = len(y)
    m1, g1 = meat(pdf.f1.values)
    m2, g2 = meat(pdf.f2.values)
    m12, _ = meat(pdf.f1.values * 100 + pdf.f2.values)
    two = fe_iv(df, *args, cluster=["f1", "f2"])
    assert np.allclose(two.v, bread @ (m1 + m2 - m12) @ bread * (n - 1) / (n - 2 - 1), rtol=1e-6)
    assert two.scalars["df_r"] == min(g1, g2) - 1


def test_iv_autocorrelation(panel, spark):
    rng = np.random.default_rng(3)
    rows = [(i, t, *rng.normal(size=3)) for i in range(15) for t in range(12)]
    pdf = pd.DataFrame(rows, columns=["i", "t", "z", "u", "v"])
    pdf["x"] = pdf.z + 0.5 * pdf.u
    pdf["y"] = pdf.x * 2 + pdf.u
    df = spark.createDataFrame(pdf)
    y, x, z = residualise(np.ones((len(pdf), 1)), pdf.y.values, pdf.x.values, pdf.z.values)
    b = (z @ y) / (z @ x)
    s = z * (y - b * x)
    n = len(y)
    r = fe_iv(df, "y", ["x"], ["z"], vce="robust", bw=3, time="t", panel=["i"])
    total = (s**2).sum()
    for lag, weight in ((1, 2 / 3), (2, 1 / 3)):
        for i in range(15):
            own = s[pdf.i.values == i]
            total += 2 * weight * (own[lag:] @ own[:-lag])
    assert np.isclose(r.v[0, 0], total / (z @ x) ** 2 * n / (n - 2), rtol=1e-7)
    e = y - b * x
    ac = fe_iv(df, "y", ["x"], ["z"], bw=2, time="t", panel=["i"])
    total = (e @ e) / n * (z @ z)
    ge = sum(e[pdf.i.values == i][1:] @ e[pdf.i.values == i][:-1] for i in range(15))
    gz = sum(z[pdf.i.values == i][1:] @ z[pdf.i.values == i][:-1] for i in range(15))
    total += 2 * 0.5 * ge / n * gz
    assert np.isclose(ac.v[0, 0], total / (z @ x) ** 2 * n / (n - 2), rtol=1e-7)
    for kernel in KERNELS:
        assert kernel_weight(kernel, 0, 4) == 1 and abs(kernel_weight(kernel, 3, 4)) <= 1
        assert fe_iv(df, "y", ["x"], ["z"], vce="robust", bw=3, kernel=kernel, time="t", panel=["i"]).se[0] > 0
    dk = fe_iv(df, "y", ["x"], ["z"], dkraay=2, time="t")
    by_t = np.array([s[pdf.t.values == t].sum() for t in range(12)])
    total = by_t @ by_t + 2 * 0.5 * (by_t[1:] @ by_t[:-1])
    assert np.isclose(dk.v[0, 0], total / (z @ x) ** 2 * 12 / 11 * (n - 1) / (n - 2), rtol=1e-7)
    ki = fe_iv(df, "y", ["x"], ["z"], kiefer=True, time="t", panel=["i"])
    by_i = np.array([s[pdf.i.values == i].sum() for i in range(15)])
    assert np.isclose(ki.v[0, 0], by_i @ by_i / (z @ x) ** 2 * n / (n - 2), rtol=1e-7)


def test_iv_partial_and_errors(panel):
    _, df = panel
    a = fe_iv(df, "y", ["x2"], ["z1", "z2"], ["x1"])
    b = fe_iv(df, "y", ["x2"], ["z1", "z2"], ["x1"], partial=["x1"])
    assert np.isclose(a.b[0], b.b[0], rtol=1e-8)
    with pytest.raises(EngineError):
        fe_iv(df, "y", ["x1", "x2"], ["z1"])
    with pytest.raises(EngineError):
        fe_iv(df, "y", ["x2"], ["z1"], bw=2)


def test_quantile_solver_and_variances(panel):
    pdf, df = panel
    x = np.column_stack([pdf.x1, pdf.x2, np.ones(len(pdf))])
    for tau in (0.1, 0.5, 0.8):
        r = quantile_reg(df, "y", ["x1", "x2"], tau)
        best = check_loss(pdf.y.values - x @ r.b, tau)
        assert np.isclose(best, r.scalars["sum_adev"], rtol=1e-9)
        rng = np.random.default_rng(0)
        assert all(check_loss(pdf.y.values - x @ (r.b + 1e-3 * rng.normal(size=3)), tau) >= best - 1e-9 for _ in range(100))
        assert (np.abs(pdf.y.values - x @ r.b) < 1e-8).sum() >= 3
    for options in ({"vce": "robust"}, {"vce": "cluster", "cluster": "f1"}, {"denmethod": "kernel"}, {"denmethod": "residual"}, {"bwmethod": "bofinger"}, {"absorb_": ["f1"]}):
        assert np.all(quantile_reg(df, "y", ["x1"], 0.4, **options).se > 0)
    with pytest.raises(EngineError):
        quantile_reg(df, "y", ["x1"], 1.5)


def test_quantile_large_path(panel, monkeypatch):
    from tallyframe.operators import quantile

    pdf, df = panel
    whole = quantile_reg(df, "y", ["x1", "x2"], 0.3).b
    monkeypatch.setattr(quantile, "MOST_NUMBERS", 1_600)
    assert np.allclose(quantile_reg(df, "y", ["x1", "x2"], 0.3).b, whole, atol=1e-6)


def test_quantile_ties():
    rng = np.random.default_rng(2)
    y = np.round(rng.normal(size=300), 1)
    x = np.column_stack([np.round(rng.normal(size=300)), np.ones(300)])
    b = interior_point(x, y, 0.5)
    assert all(check_loss(y - x @ (b + 1e-3 * rng.normal(size=2)), 0.5) >= check_loss(y - x @ b, 0.5) - 1e-9 for _ in range(100))


def test_binary_models(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    t = (0.3 + 0.8 * x + rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "t": t}))
    from statistics import NormalDist

    cdf = np.vectorize(NormalDist().cdf)

    def loglik(b, link):
        eta = b[0] * x + b[1]
        p = cdf(eta) if link == "probit" else 1 / (1 + np.exp(-eta))
        return (t * np.log(p) + (1 - t) * np.log(1 - p)).sum()

    for link in ("probit", "logit"):
        b = binary_fit(df, "t", ["x"], link)
        assert all(loglik(b + np.array(h), link) <= loglik(b, link) + 1e-12 for h in ((1e-4, 0), (-1e-4, 0), (0, 1e-4), (0, -1e-4)))
    points = [-9.0, -5.5, -2.0, 0.0, 0.3, 4.9, 5.1, 8.0]
    got = [r.c for r in spark.createDataFrame([(i, p) for i, p in enumerate(points)], "i int, p double").orderBy("i").select(normal_column(F.col("p")).alias("c")).collect()]
    assert np.allclose(got, [NormalDist().cdf(p) for p in points], rtol=1e-9)


def test_distributions():
    assert np.isclose(chi2_tail(3.841458820694124, 1), 0.05) and np.isclose(f_tail(4.964602743730711, 1, 10), 0.05)
    assert np.isclose(t_tail(2.2281388519649385, 10), 0.05) and np.isclose(normal_quantile(0.975), 1.959963984540054)
