"""Statistics over key-range windows, and winsorizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..common import EngineError, fresh, is_numeric, need, number, same
from ..functions.order_stats import order_statistics

PERCENTILES = {"p1": 0.01, "p5": 0.05, "p10": 0.10, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}
ADDITIVE = ("count", "mean", "sum", "sd", "variance", "skewness", "kurtosis", "min", "max")
#: Segments of the key range that windows are computed in.
SEGMENTS = 256
STATS = (*ADDITIVE, "iqr", "first", "firstnm", "last", "lastnm", *PERCENTILES)


def from_moments(stat: str, n: Column, s1: Column, s2: Column, s3: Column, s4: Column, shift: Column) -> Column:
    """A statistic from the count and the power sums of x - shift."""
    mean = s1 / n
    m2 = F.greatest(s2 / n - mean * mean, F.lit(0.0))
    if stat == "count":
        return F.coalesce(n, F.lit(0)).cast("long")
    if stat == "mean":
        return F.when(n > 0, mean + shift)
    if stat == "sum":
        return F.when(n > 0, s1 + n * shift)
    if stat in ("sd", "variance"):
        v = F.when(n > 1, m2 * n / (n - 1))
        return F.sqrt(v) if stat == "sd" else v
    m3 = s3 / n - 3 * mean * s2 / n + 2 * mean * mean * mean
    flat = m2 <= 1e-12 * F.greatest(F.abs(s2 / n), F.lit(1e-300))
    if stat == "skewness":
        return F.when((n > 2) & ~flat, m3 / F.pow(m2, 1.5))
    m4 = s4 / n - 4 * mean * s3 / n + 6 * mean * mean * s2 / n - 3 * mean * mean * mean * mean
    return F.when((n > 3) & ~flat, m4 / (m2 * m2))


def sorted_percentile(values: Column, p: float) -> Column:
    """Linear interpolation at p * (n - 1) in an ascending array."""
    n = F.size(values)
    at = (n - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    a = F.get(values, low)
    b = F.get(values, F.least(low + 1, n - 1))
    return F.when(n > 0, a + (b - a) * (at - low))


def _ordered_stat(stat: str, window: Column, ordered: bool = False) -> Column:
    """A statistic of the array of (key, row, x), or (order, key, row, x), of a window without missing x."""
    x = F.transform(window, lambda s: s["x"])
    if stat in ("first", "firstnm", "last", "lastnm"):
        if ordered and stat.startswith("last"):
            top = F.array_max(F.transform(window, lambda s: s["o"]))
            return F.array_min(F.filter(window, lambda s: s["o"] == top))["x"]
        s = F.array_sort(window)
        return F.get(s, F.lit(0) if stat.startswith("first") else F.size(s) - 1)["x"]
    if stat in ("min", "max"):
        return F.array_min(x) if stat == "min" else F.array_max(x)
    s = F.array_sort(x)
    if stat == "iqr":
        return sorted_percentile(s, 0.75) - sorted_percentile(s, 0.25)
    return sorted_percentile(s, PERCENTILES[stat])


def _segments(work: DataFrame, low: float | None, high: float | None):
    """A function that deals rows out to segments of the key range, so that a large group is many tasks.

    A row goes to every segment whose windows it may lie in, its own included; ``__home`` marks the copy in its
    own segment, whose window is complete. Segments are at least as wide as the interval, so a row has few
    copies. None if the interval is unbounded.
    """
    if low is None or high is None:
        return None
    first, last = work.agg(F.min("__key"), F.max("__key")).first()
    width = max(high - low, ((last or 0.0) - (first or 0.0)) / SEGMENTS) or 1.0
    at = lambda c: F.floor(c / F.lit(float(width)))
    home = at(F.col("__key"))

    def deal(df: DataFrame) -> DataFrame:
        reach = F.sequence(F.least(home, at(F.col("__key") - F.lit(float(high)))), F.greatest(home, at(F.col("__key") - F.lit(float(low)))))
        out = df.withColumn("__seg", F.explode(F.when(F.col("__key").isNull(), F.array(F.lit(None).cast("long"))).otherwise(reach)))
        return out.withColumn("__home", F.col("__key").isNull() | (F.col("__seg") == home))

    return deal


def _frame(by: list[str], low: float | None, high: float | None) -> str:
    """A range frame in SQL, where bounds may be fractions and lie on one side."""

    def bound(x: float | None, end: str) -> str:
        return f"UNBOUNDED {end}" if x is None else "CURRENT ROW" if x == 0 else f"{abs(float(x))!r}D {'PRECEDING' if x < 0 else 'FOLLOWING'}"

    part = "PARTITION BY " + ", ".join(f"`{b}`" for b in by) if by else ""
    return f"({part} ORDER BY `__key` ASC NULLS LAST RANGE BETWEEN {bound(low, 'PRECEDING')} AND {bound(high, 'FOLLOWING')})"


def range_stats(
    df: DataFrame,
    stats: dict[str, tuple[str, str]],
    key: str,
    low: float | None,
    high: float | None,
    by: list[str] | None = None,
    excludeself: bool = False,
    row_id: str | None = None,
    order: Column | None = None,
) -> DataFrame:
    """Add statistics over all rows of the same group whose key lies within [key + low, key + high].

    ``stats`` maps a new column to (statistic, column). ``low`` or ``high`` None is unbounded. Rows
    with a missing key get missing results (a count too) and are in no window; count of an empty
    window is 0; first and last skip missing values and settle equal keys by ``row_id``. ``order`` is
    a number that they go by in place of the key; of equal ones both take the lower key.

    Statistics that add up are taken over one partial sum for each group and key, so a wide window
    reads each key once, not each row. Percentiles, first and last hold the window's values.
    ``excludeself`` leaves out the row itself, not the rows that share its key.
    """
    by = by or []
    need(df, key, *by)
    fresh(df, *stats)
    for s, c in stats.values():
        need(df, c)
        if s not in STATS:
            raise EngineError(198, f"unknown statistic {s}")
        if not is_numeric(df, c):
            raise EngineError(107, f"{c} is not numeric")
    if low is not None and high is not None and low > high:
        raise EngineError(198, "the interval is empty")
    columns = list(dict.fromkeys(c for _, c in stats.values()))
    additive = [c for c in columns if any(s in ADDITIVE and c == v and not (excludeself and s in ("min", "max")) for s, v in stats.values())]
    k = number(key)
    work = df.withColumn("__key", k)
    split = _segments(work, low, high)
    frame = _frame([*by, "__seg"] if split else by, low, high)
    usable = F.col("__key").isNotNull()

    if additive:
        # Power sums around the group mean, one row for each group and key, then a frame over those.
        x = {c: F.when(usable, number(c)) for c in additive}
        centers = work.groupBy(*by).agg(*[F.coalesce(F.avg(x[c]), F.lit(0.0)).alias(f"__c_{c}") for c in additive], F.count("*").alias("__rows")) if by else None
        if by:
            names = [f"__b{i}" for i in range(len(by))]
            cent = centers.select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], *[f"__c_{c}" for c in additive])
            cond = F.lit(True)
            for b, n in zip(by, names, strict=True):
                cond = cond & same(F.col(b), F.col(n))
            work = work.join(cent, cond).drop(*names)
        else:
            row = work.agg(*[F.coalesce(F.avg(x[c]), F.lit(0.0)).alias(c) for c in additive]).first()
            work = work.withColumns({f"__c_{c}": F.lit(row[c]) for c in additive})
        d = {c: F.when(usable, number(c)) - F.col(f"__c_{c}") for c in additive}
        partial = []
        for c in additive:
            partial += [F.count(d[c]).alias(f"__n_{c}"), *[F.sum(F.pow(d[c], F.lit(i))).alias(f"__s{i}_{c}") for i in (1, 2, 3, 4)], F.min(F.when(usable, number(c))).alias(f"__min_{c}"), F.max(F.when(usable, number(c))).alias(f"__max_{c}")]
        cells = work.filter(usable).groupBy(*by, "__key").agg(*partial)
        sums = []
        for c in additive:
            sums += [F.expr(f"{f}(`__{v}_{c}`) OVER {frame} AS `__w{v.removeprefix('s')}_{c}`") for f, v in (("sum", "n"), ("sum", "s1"), ("sum", "s2"), ("sum", "s3"), ("sum", "s4"), ("min", "min"), ("max", "max"))]
        on = [*by, "__key"]
        cells = split(cells) if split else cells.withColumn("__home", F.lit(True))
        windows = cells.select(*[F.col(b).alias(f"__o{i}") for i, b in enumerate(on)], "__home", *sums).filter("__home").drop("__home")
        cond = F.lit(True)
        for i, b in enumerate(on):
            cond = cond & same(F.col(b), F.col(f"__o{i}"))
        work = work.join(windows, cond, "left").drop(*[f"__o{i}" for i in range(len(on))])

    held = [c for c in columns if any(v == c and (s not in ADDITIVE or (excludeself and s in ("min", "max"))) for s, v in stats.values())]
    if held:
        work = work.withColumn("__row", F.col(row_id) if row_id else F.monotonically_increasing_id())
        if order is not None:
            work = work.withColumn("__order", number(order))
        work = split(work) if split else work
        for c in held:
            item = F.struct(*([F.col("__order").alias("o")] if order is not None else []), F.col("__key").alias("k"), F.col("__row").alias("r"), number(c).alias("x"))
            work = work.withColumn(f"__i_{c}", F.when(usable & number(c).isNotNull(), item)).withColumn(f"__h_{c}", F.expr(f"collect_list(`__i_{c}`) OVER {frame}"))
            if excludeself:
                work = work.withColumn(f"__h_{c}", F.filter(f"__h_{c}", lambda s: s["r"] != F.col("__row")))

        if split:
            work = work.filter("__home")

    inside_self = (F.lit(low is None or low <= 0)) & (F.lit(high is None or high >= 0))
    out = {}
    for new, (s, c) in stats.items():
        if c in held and (s not in ADDITIVE or (excludeself and s in ("min", "max"))):
            value = _ordered_stat(s, F.col(f"__h_{c}"), order is not None)
        elif s in ("min", "max"):
            value = F.col(f"__w{s}_{c}")
        else:
            n, sums_of = F.col(f"__wn_{c}"), [F.col(f"__w{i}_{c}") for i in (1, 2, 3, 4)]
            if excludeself:
                own = F.when(inside_self & number(c).isNotNull() & usable, number(c) - F.col(f"__c_{c}"))
                n = n - F.when(own.isNotNull(), 1).otherwise(0)
                sums_of = [v - F.coalesce(F.pow(own, F.lit(i)), F.lit(0.0)) for i, v in enumerate(sums_of, 1)]
            n = F.when(n > 0, n)
            value = from_moments(s, n, *sums_of, F.col(f"__c_{c}"))
        out[new] = F.when(usable, value)
    return work.select(*df.columns, *[v.alias(n) for n, v in out.items()])


# ------------------------------------------------------------------------------------- winsorizing


def winsor_bounds(df: DataFrame, columns: list[str], p: float, q: float, by: list[str]) -> DataFrame:
    """Per group: lower and upper bound of each column, null for fewer than three values.

    The p-th percentile of n values: with h = n p / 100 and j its whole part, the (j + 1)-th value if
    h has a fraction, else the mean of the j-th and (j + 1)-th; the smallest for h = 0 and the
    largest for j >= n. Values are counted, so a task holds distinct values in order, not rows.
    """
    if not by:
        bounds = {}
        for c in columns:
            x = df.select(number(c).alias("__x")).filter("__x is not null")
            n = x.count()
            ranks = {pct: _ranks(n, pct) for pct in (p, q)}
            found = order_statistics(x, "__x", [r for pair in ranks.values() for r in pair]) if n >= 3 else {}
            for name, pct in ((f"__lo_{c}", p), (f"__hi_{c}", q)):
                bounds[name] = F.lit((found[ranks[pct][0]] + found[ranks[pct][1]]) / 2 if found else None).cast("double")
        return df.sparkSession.range(1).select(*[v.alias(k) for k, v in bounds.items()])
    out = None
    for c in columns:
        x = number(c)
        counts = df.select(*by, x.alias("__x")).filter("__x is not null").groupBy(*by, "__x").agg(F.count("*").alias("__c"))
        w = W.partitionBy(*by)
        upto = F.sum("__c").over(w.orderBy("__x").rowsBetween(W.unboundedPreceding, 0))
        placed = counts.withColumn("__n", F.sum("__c").over(w)).withColumn("__to", upto)

        def at(pct: float) -> Column:
            h = F.col("__n") * F.lit(float(pct)) / 100
            j = F.floor(h)
            whole = h == j
            first = F.greatest(F.least(F.when(whole, j).otherwise(j + 1), F.col("__n")), F.lit(1))
            second = F.greatest(F.least(j + 1, F.col("__n")), F.lit(1))
            a = F.min(F.when(F.col("__to") >= first, F.col("__x")))
            b = F.min(F.when(F.col("__to") >= second, F.col("__x")))
            return F.when(F.max("__n") >= 3, (a + b) / 2)

        one = placed.groupBy(*by).agg(at(p).alias(f"__lo_{c}"), at(q).alias(f"__hi_{c}"))
        if out is None:
            out = one
        else:
            right = one.select(*[F.col(b).alias(f"__r{i}") for i, b in enumerate(by)], f"__lo_{c}", f"__hi_{c}")
            cond = F.lit(True)
            for i, b in enumerate(by):
                cond = cond & same(F.col(b), F.col(f"__r{i}"))
            out = out.join(right, cond, "full").select(*[F.coalesce(b, f"__r{i}").alias(b) for i, b in enumerate(by)], *[n for n in [*out.columns, *right.columns] if n.startswith(("__lo_", "__hi_"))])
    return out


def _ranks(n: int, pct: float) -> tuple[int, int]:
    """The two ranks whose values are averaged; the same rank twice where there is nothing to average."""
    h = n * float(pct) / 100
    j = int(h // 1)
    first = j if h == j else j + 1
    return min(max(first, 1), n), min(max(j + 1, 1), n)


def winsorize(
    df: DataFrame,
    columns: list[str],
    p: float = 1,
    q: float = 99,
    *,
    cuts: tuple[float, float] | None = None,
    trim: bool = False,
    by: list[str] | None = None,
    suffix: str = "",
    prefix: str = "",
    replace: bool = False,
) -> DataFrame:
    """Clamp (or, with ``trim``, make missing) values beyond the p-th and q-th percentiles of their group.

    Missing values stay missing; groups of fewer than three values stay as they are. Without
    ``suffix`` and ``prefix`` the columns are overwritten.
    """
    by = by or []
    p, q = cuts or (p, q)
    need(df, *columns, *by)
    if not 0 <= p < q <= 100:
        raise EngineError(198, "0 <= p < q <= 100")
    if replace and (suffix or prefix):
        raise EngineError(198, "replace excludes suffix and prefix")
    for c in columns:
        if not is_numeric(df, c):
            raise EngineError(107, f"{c} is not numeric")
    names = {c: f"{prefix}{c}{suffix}" for c in columns}
    if suffix or prefix:
        fresh(df, *names.values())
    bounds = winsor_bounds(df, columns, p, q, by)
    if by:
        keyed = bounds.select(*[F.col(b).alias(f"__b{i}") for i, b in enumerate(by)], *[n for n in bounds.columns if n.startswith("__")])
        cond = F.lit(True)
        for i, b in enumerate(by):
            cond = cond & same(F.col(b), F.col(f"__b{i}"))
        work = df.join(keyed, cond, "left")
    else:
        r = bounds.first()
        work = df.withColumns({n: F.lit(r[n] if r else None).cast("double") for c in columns for n in (f"__lo_{c}", f"__hi_{c}")})
    out = {}
    for c in columns:
        x, lo, hi = number(c), F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        out[names[c]] = F.when(x.isNull(), None).when(lo.isNull(), x).when((x < lo) | (x > hi), None if trim else F.when(x < lo, lo).otherwise(hi)).otherwise(x)
    return work.withColumns(out).select(*df.columns, *[n for n in names.values() if n not in df.columns])

