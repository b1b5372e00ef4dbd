"""Rules that the registered queries do not show: errors, missing values, edge tables."""

import math

import pytest
from pyspark.sql import functions as F

from tallyframe.common import EngineError, with_position
from tallyframe.functions.order_stats import order_statistics
from tallyframe.operators import matching
from tallyframe.operators import relational as R
from tallyframe.operators.binned import binned_means
from tallyframe.operators.matching import psm_match
from tallyframe.operators.sampling import bootstrap_rows, sample_rows
from tallyframe.operators.windows import range_stats, winsorize


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def code(info):
    return info.value.code


def test_merge_errors(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 5)], "k int, w int")
    with pytest.raises(EngineError) as e:
        R.keyed_merge(a, b, ["k"], "1:1")
    assert code(e) == 459
    with pytest.raises(EngineError) as e:
        R.keyed_merge(a, b, ["z"], "m:1")
    assert code(e) == 111
    with pytest.raises(EngineError) as e:
        R.keyed_merge(a.withColumn("_merge", F.lit(1)), b, ["k"], "m:1")
    assert code(e) == 110
    s = b.withColumn("k", F.col("k").cast("string"))
    with pytest.raises(EngineError) as e:
        R.keyed_merge(a, s, ["k"], "m:1")
    assert code(e) == 106
    assert R.keyed_merge(a, s, ["k"], "m:1", force=True).filter("_merge = 3").count() == 2
    with pytest.raises(EngineError) as e:
        R.keyed_merge(a.unionByName(a.limit(1).withColumn("k", F.lit(9))), b, ["k"], "m:1", assert_={3}, keep={3})
    assert code(e) == 9


def test_merge_empty_sides_and_null_keys(spark):
    a = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    b = spark.createDataFrame([(None, 7)], "k int, w int")
    assert rows(R.keyed_merge(a, b, ["k"], "1:1").select("k", "v", "w", "_merge")) == rows(spark.createDataFrame([(None, 1, 7, 3), (2, 2, None, 1)], "k int, v int, w int, m int"))
    assert {r._merge for r in R.keyed_merge(a, b.limit(0), ["k"], "1:1").collect()} == {1}
    assert {r._merge for r in R.keyed_merge(a.limit(0), b, ["k"], "1:1").collect()} == {2}


def test_m_m_repeats_the_last_row(spark):
    a = spark.createDataFrame([(1, i) for i in range(4)], "k int, a int")
    b = spark.createDataFrame([(1, i * 10) for i in range(2)], "k int, b int")
    got = rows(R.keyed_merge(a, b, ["k"], "m:m", master_order=["a"], using_order=["b"]).select("a", "b"))
    assert got == [(0, 0), (1, 10), (2, 10), (3, 10)]


def test_sort_missing_last(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("", 3), ("a", 4)], "s string, i int")
    assert [r.i for r in R.sort_rows(df, ["s"], ["i"]).collect()] == [3, 4, 1, 2]
    with pytest.raises(EngineError):
        R.sort_rows(df, ["s"], algorithm="bogo")
    assert sorted(r.n for r in with_position(df, "n", ["i"]).collect()) == [1, 2, 3, 4]


def test_dictionary_errors(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "s string, i int")
    with pytest.raises(EngineError) as e:
        R.encode_labels(df, ["i"], ["c"])
    assert code(e) == 107
    with pytest.raises(EngineError) as e:
        R.encode_labels(df, ["s"], ["c"], most=1)
    assert code(e) == 134
    with pytest.raises(EngineError) as e:
        R.decode_labels(df, ["s"], spark.createDataFrame([(1, "x")], "code int, label string"), ["t"])
    assert code(e) == 108
    coded, d = R.encode_labels(df, ["s"])
    back = R.decode_labels(coded, ["s"], d)
    assert rows(back) == rows(df)


@pytest.mark.parametrize("text, want", [("1", 1.0), (" -2.5e3 ", -2500.0), ("+.5", 0.5), ("5.", 5.0), ("", None), (".", None), ("NA", None), ("nan", None), ("1e+", "bad"), ("1.5d", "bad"), ("inf", "bad"), ("0x10", "bad"), ("1 2", "bad"), (None, None), ("--1", "bad")])
def test_number_grammar(spark, text, want):
    v, bad = R.parsed(F.col("t"))
    r = spark.createDataFrame([(text,)], "t string").select(v.alias("v"), bad.alias("b")).first()
    assert (r.b, r.v) == ((True, None) if want == "bad" else (False, want))


def test_parse_raises_without_force(spark):
    df = spark.createDataFrame([("1",), ("x",)], "t string")
    with pytest.raises(EngineError) as e:
        R.parse_numeric(df, ["t"], ["n"])
    assert code(e) == 109
    assert rows(R.parse_numeric(df, ["t"], ["n"], on_error="null").select("n")) == [(1.0,), (None,)]


def test_sampling_is_reproducible(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    a, b = sample_rows(df, ["id"], percent=10, by=["g"], seed=5), sample_rows(df.repartition(7), ["id"], percent=10, by=["g"], seed=5)
    assert rows(a) == rows(b) != rows(sample_rows(df, ["id"], percent=10, by=["g"], seed=6))
    assert sample_rows(df, ["id"], count=5000).count() == 1000 and sample_rows(df, ["id"], percent=0).count() == 0
    assert sample_rows(df, ["id"], percent=50, where=F.col("g") == 0, keep_outside=False).count() == 167
    w = bootstrap_rows(df, ["id"], seed=2, weight="w")
    e = bootstrap_rows(df, ["id"], seed=2)
    assert w.agg(F.sum("w")).first()[0] == 1000 == e.count() and w.count() == 1000
    assert rows(e.groupBy("id").count()) == rows(w.filter("w > 0").select("id", "w"))
    c = bootstrap_rows(df, ["id"], cluster=["g"], seed=3, weight="w").groupBy("g").agg(F.countDistinct("w"), F.max("w")).collect()
    assert all(r[1] == 1 for r in c) and sum(r[2] for r in c) == 3


def test_range_self_window_and_both_bounds_positive(spark):
    df = spark.range(1, 11).select(F.col("id").cast("double").alias("t"), F.col("id").cast("double").alias("x"))
    out = range_stats(df, {"n": ("count", "x"), "m": ("mean", "x")}, "t", 0, 0, excludeself=True)
    assert {(r.n, r.m) for r in out.collect()} == {(0, None)}
    got = {r.t: (r.n, r.s, r.md) for r in range_stats(df, {"n": ("count", "x"), "s": ("sum", "x"), "md": ("median", "x")}, "t", 1.5, 3.5).collect()}
    assert got[1.0] == (2, 7.0, 3.5) and got[8.0] == (1, 10.0, 10.0) and got[10.0] == (0, None, None)
    with pytest.raises(EngineError):
        range_stats(df, {"n": ("mode", "x")}, "t", 0, 1)


def test_winsor_small_groups_and_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 100.0), (2, 1.0), (2, 2.0), (2, None), (2, 50.0)], "g int, x double")
    out = winsorize(df, ["x"], 40, 60, by=["g"], suffix="_w")
    assert {(r.g, r.x, r.x_w) for r in out.collect()} == {(1, 1.0, 1.0), (1, 100.0, 100.0), (2, 1.0, 2.0), (2, 2.0, 2.0), (2, None, None), (2, 50.0, 2.0)}
    with pytest.raises(EngineError):
        winsorize(df, ["x"], 60, 40)


def test_order_statistics(spark):
    import random

    random.seed(1)
    values = [random.choice([0.0, -5.5, 3.25, random.random() * 1e6]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ranks = [1, 2, 700, 1500, 2999, 3000]
    from tallyframe.functions import order_stats

    for fetch in (20_000, 10):
        order_stats.FETCH = fetch
        assert order_statistics(df, "x", ranks) == {r: sorted(values)[r - 1] for r in ranks}
    order_stats.FETCH = 20_000


def test_binned_errors_and_ties(spark):
    df = spark.createDataFrame([(float(i), float(i // 5)) for i in range(20)], "y double, x double")
    b = rows(binned_means(df, "y", "x", 10, linetype="none").bins.select("bin", "n"))
    assert sum(n for _, n in b) == 20 and all(n == 5 for _, n in b)
    for bad in ({"method": "other"}, {"linetype": "wave"}, {"nquantiles": 1}):
        with pytest.raises(EngineError):
            binned_means(df, "y", "x", **bad)
    assert binned_means(df, "y", "x", genxq="q", linetype="none").rows.columns == ["y", "x", "q"]


def test_matching_edges(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 0, 0.4), (3, 0, 0.6), (4, 1, 0.9), (5, 0, 0.6), (6, 1, 0.1)], "id int, t int, p double")
    near = {r.treated: r.control for r in psm_match(df, "t", "id", pscore="p").pairs.collect()}
    assert near == {1: 2, 4: 5, 6: 2}
    ties = psm_match(df, "t", "id", pscore="p", ties=True).pairs
    assert rows(ties.filter("treated = 4").select("control", "weight")) == [(3, 0.5), (5, 0.5)]
    one = {r.treated: r.control for r in psm_match(df, "t", "id", pscore="p", replacement=False).pairs.collect()}
    assert one == {6: 2, 1: 3, 4: 5}
    common = {r.id: r._support for r in psm_match(df, "t", "id", pscore="p", common=True).rows.collect()}
    assert common == {1: 1, 2: 1, 3: 1, 4: 0, 5: 1, 6: 0}
    none = psm_match(df, "t", "id", pscore="p", caliper=0.05).rows.filter("_treated = 1")
    assert {(r._support, r._weight) for r in none.collect()} == {(1, 0.0)}
    with pytest.raises(EngineError):
        psm_match(df.withColumn("t", F.col("id")), "t", "id", pscore="p")
    with pytest.raises(EngineError):
        psm_match(df, "t", "id", pscore="p", replacement=False, neighbor=2)


@pytest.fixture
def kept_rows(monkeypatch):
    """Numbers of rows of the intermediate tables that matching writes."""
    counts, write = {}, matching.written

    def counted(df, name):
        out = write(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(matching, "written", counted)
    return counts


def _scored(spark, n=240):
    """Few distinct scores, so that many tie; every control is within .3 of some treated row."""
    data = [(i, i % 3 == 0, (i * 7 % 41) / 60, float(i % 17)) for i in range(n)]
    return data, spark.createDataFrame([(i, int(t), p, y) for i, t, p, y in data], "id long, t int, p double, y double")


def _by_hand(data, reach, kernel):
    pairs = {}
    for i, _, p, _ in (r for r in data if r[1]):
        near = [(j, abs(p - q), q) for j, t, q, _ in data if not t and abs(p - q) <= reach and kernel(abs(p - q)) > 0]
        total = sum(kernel(d) for _, d, _ in near)
        pairs |= {(i, j): (kernel(d) / total, d, q) for j, d, q in near}
    return pairs


def test_radius_effect_keeps_no_pairs(spark, monkeypatch, kept_rows):
    monkeypatch.setattr(matching, "BLOCK", 16, raising=False)
    data, df = _scored(spark)
    m = psm_match(df, "t", "id", outcome="y", pscore="p", method="radius", caliper=0.3)
    pairs = _by_hand(data, 0.3, lambda d: 1.0)
    assert len(pairs) > 8000 and max(kept_rows.values()) <= 3 * len(data)
    got = {r.id: r for r in m.rows.collect()}
    for i, t, p, _ in data:
        own = [(d, q >= p, q, j) for (a, j), (_, d, q) in pairs.items() if a == i]
        share = sum(w for (_, j), (w, _, _) in pairs.items() if j == i)
        assert got[i]._weight == pytest.approx(float(bool(own)) if t else share)
        assert (got[i]._nn, got[i]._id) == ((len(own), min(own)[3]) if t else (None, None))
    means = [sum(r.y * r._weight for r in got.values() if r.t == t) / sum(r._weight for r in got.values() if r.t == t) for t in (0, 1)]
    assert m.att["att"] == pytest.approx(means[1] - means[0])


def test_radius_pairs_are_not_kept(spark, monkeypatch, kept_rows):
    monkeypatch.setattr(matching, "BLOCK", 16, raising=False)
    data, df = _scored(spark)
    got = psm_match(df, "t", "id", pscore="p", method="radius", caliper=0.3).pairs.collect()
    want = _by_hand(data, 0.3, lambda d: 1.0)
    assert max(kept_rows.values()) <= 3 * len(data) < len(got)
    assert {(r.treated, r.control): (r.weight, r.distance) for r in got} == {k: pytest.approx(v[:2]) for k, v in want.items()} and len(got) == len(want)


KERNELS = {
    "epan": lambda u: 0.75 * (1 - u * u) if u < 1 else 0,
    "normal": lambda u: math.exp(-u * u / 2),
    "biweight": lambda u: (1 - u * u) ** 2 if u < 1 else 0,
    "uniform": lambda u: 0.5,
    "tricube": lambda u: (1 - u**3) ** 3 if u < 1 else 0,
}


@pytest.mark.parametrize("kind", ["tricube", "epan", "normal", "biweight", "uniform"])
def test_kernel_pairs_are_not_kept(spark, monkeypatch, kept_rows, kind):
    monkeypatch.setattr(matching, "BLOCK", 16, raising=False)
    data, df = _scored(spark)
    h = 0.05 if kind == "normal" else 0.29
    got = psm_match(df, "t", "id", pscore="p", method="kernel", kerneltype=kind, bwidth=h).pairs.collect()
    want = _by_hand(data, 6 * h if kind == "normal" else h, lambda d: KERNELS[kind](d / h))
    assert max(kept_rows.values()) <= 3 * len(data) < len(got)
    assert {(r.treated, r.control): (r.weight, r.distance) for r in got} == {k: pytest.approx(v[:2]) for k, v in want.items()} and len(got) == len(want)
