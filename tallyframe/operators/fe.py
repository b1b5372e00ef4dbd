"""Absorbing many-level fixed effects.

Projections on fixed effects use sums by level only, so they run on the table of cells (the
combinations of levels that occur) rather than on rows. One aggregation builds it. Up to
``MOST_CELLS`` cells conjugate gradients solve for the level effects on the driver; beyond that the
same projections alternate as DataFrame joins, each round written to the shared folder. Rows are
then residualised by joining one small table of effects for each fixed effect.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import EngineError, need, small, with_position, written

MOST_CELLS = 2_000_000
MOST_BROADCAST = 200_000


@dataclass
class Absorbed:
    """``data``: the sample with a column d_<v> for each residualised variable; ``levels``: levels of each effect."""

    data: DataFrame
    n_rows: int
    levels: list[int]
    singletons: int
    components: int
    iterations: int
    redundant: list[int] = field(default_factory=list)
    effects: list[DataFrame] = field(default_factory=list)
    groups: DataFrame | None = None
    means: dict[str, float] = field(default_factory=dict)

    def df_a(self, adjustments: str = "all") -> int:
        """Levels less redundant ones: connected components of the first two, and one for each further effect."""
        if not self.levels:
            return 1
        total = sum(self.levels)
        if adjustments == "none" or len(self.levels) == 1:
            return total
        return total - self.components - (max(0, len(self.levels) - 2) if adjustments in ("all", "pairwise") else 0)


def component_of(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Component number of each level of the first effect in the graph whose edges are the cells."""
    label = np.arange(n_a + n_b)
    pairs = np.unique(np.stack([a, b + n_a]), axis=1)
    while True:  # labels fall to the smallest neighbour's and then to that one's own label
        least = np.minimum(label[pairs[0]], label[pairs[1]])
        new = label.copy()
        np.minimum.at(new, pairs[0], least)
        np.minimum.at(new, pairs[1], least)
        new = new[new]
        if (new == label).all():
            return np.unique(label, return_inverse=True)[1]
        label = new


def solve_effects(codes: list[np.ndarray], sizes: list[int], w: np.ndarray, sums: np.ndarray, tol: float, most: int) -> tuple[list[np.ndarray], int]:
    """Effects that minimise the weighted squares of cell mean less effects, by preconditioned conjugate gradients.

    ``sums``: weighted sums of each variable by cell, one column for each.
    """
    start = np.concatenate([[0], np.cumsum(sizes)])
    diag = np.concatenate([np.bincount(c, weights=w, minlength=n) for c, n in zip(codes, sizes, strict=True)])
    diag = np.where(diag > 0, diag, 1.0)

    def spread(alpha: np.ndarray) -> np.ndarray:
        return sum(alpha[start[g] + c] for g, c in enumerate(codes))

    def gather(cell: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(c, weights=cell, minlength=n) for c, n in zip(codes, sizes, strict=True)])

    out, rounds = np.zeros((start[-1], sums.shape[1])), 0
    for v in range(sums.shape[1]):
        target = gather(sums[:, v])
        x = np.zeros(start[-1])
        r = target.copy()
        z = r / diag
        p = z.copy()
        rz = r @ z
        first = rz
        for i in range(most):
            if rz <= tol * tol * max(first, 1e-300):
                break
            ap = gather(w * spread(p))
            step = rz / max(p @ ap, 1e-300)
            x += step * p
            r -= step * ap
            z = r / diag
            rz, old = r @ z, rz
            p = z + (rz / old) * p
            rounds = max(rounds, i + 1)
        else:
            raise EngineError(430, "the fixed effects did not converge")
        out[:, v] = x
    return [out[start[g] : start[g + 1]] for g in range(len(sizes))], rounds


def level_join(df: DataFrame, table: DataFrame, fe: str, rows: int) -> DataFrame:
    """Join a table keyed by ``__level``; missing levels were dropped before."""
    return df.join(small(table, rows, MOST_BROADCAST), F.col(fe) == F.col("__level")).drop("__level")


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a missing value (NaN counts as missing) in any of ``columns``."""
    cond = F.lit(True)
    for c in columns:
        numeric = dict(df.dtypes)[c] in ("double", "float")
        cond = cond & F.col(c).isNotNull() & (~F.isnan(c) if numeric else F.lit(True))
    return df.filter(cond)


def absorb(df: DataFrame, effects: list[str], variables: dict[str, Column], weight: str | None = None, tol: float = 1e-8, most: int = 10_000, keep_singletons: bool = False, most_cells: int = MOST_CELLS) -> Absorbed:
    """Residualise ``variables`` (name to column) on ``effects``, in weighted least squares.

    Levels that occur once are dropped, again and again until none is left. Without effects the
    weighted means are removed.
    """
    need(df, *effects, *([weight] if weight else []))
    w = F.col(weight) if weight else F.lit(1.0)
    base = df.withColumns({f"v_{n}": c for n, c in variables.items()})
    names = list(variables)
    if not effects:
        row = base.agg(F.count("*").alias("n"), *[(F.sum(w * F.col(f"v_{n}")) / F.sum(w)).alias(f"m_{n}") for n in names]).first()
        means = {n: row[f"m_{n}"] or 0.0 for n in names}
        data = base.withColumns({f"d_{n}": F.col(f"v_{n}") - F.lit(means[n]) for n in names})
        return Absorbed(data, row["n"], [], 0, 0, 0, means=means)

    row = base.agg(F.count("*").alias("n"), *[(F.sum(w * F.col(f"v_{n}")) / F.sum(w)).alias(f"m_{n}") for n in names]).first()
    total_rows, centers = row["n"], {n: row[f"m_{n}"] or 0.0 for n in names}
    if not total_rows:
        raise EngineError(2000, "no observations")
    cells = base.groupBy(*effects).agg(F.count("*").alias("__n"), F.sum(w).alias("__w"), *[F.sum(w * (F.col(f"v_{n}") - F.lit(centers[n]))).alias(f"__s_{n}") for n in names])
    cells = written(cells, "fe-cells")
    if cells.count() > most_cells:
        return _absorb_in_frames(base, effects, names, w, tol, most, keep_singletons, total_rows, centers)
    table = cells.toArrow()
    n = table.column("__n").to_numpy()
    weights = table.column("__w").to_numpy().astype(float)
    sums = np.column_stack([table.column(f"__s_{v}").to_numpy().astype(float) for v in names]) if names else np.zeros((len(n), 0))
    values, codes = [], []
    for f in effects:
        enc = table.column(f).combine_chunks().dictionary_encode()
        values.append(np.array(enc.dictionary.to_pylist(), object))
        codes.append(enc.indices.to_numpy().astype(np.int64))
    alive = np.ones(len(n), bool)
    while not keep_singletons:
        once = np.zeros(len(n), bool)
        for c, v in zip(codes, values, strict=True):
            once |= np.bincount(c[alive], weights=n[alive], minlength=len(v))[c] == 1
        once &= alive
        if not once.any():
            break
        alive &= ~once
    kept = [np.unique(c[alive]) for c in codes]
    now = [np.searchsorted(k, c[alive]) for k, c in zip(kept, codes, strict=True)]
    sizes = [len(k) for k in kept]
    if not alive.any():
        raise EngineError(2001, "insufficient observations")
    effect, rounds = solve_effects(now, sizes, weights[alive], sums[alive], tol * 1e-2, most)
    spark = df.sparkSession
    tables, data = [], base
    schemas = {f: df.schema[f].dataType.simpleString() for f in effects}
    for g, f in enumerate(effects):
        rows = [(values[g][k], *map(float, effect[g][i])) for i, k in enumerate(kept[g])]
        t = spark.createDataFrame(rows, f"__level {schemas[f]}, " + ", ".join(f"`__e{g}_{v}` double" for v in names) if names else f"__level {schemas[f]}")
        tables.append(t)
        data = level_join(data, t, f, sizes[g])
    # A dropped row has a level that went with it, so the joins leave it out.
    dropped = total_rows - int(n[alive].sum())
    groups, components = None, 0
    if len(effects) > 1:
        comp = component_of(now[0], now[1], sizes[0], sizes[1])
        components = int(comp.max()) + 1
        groups = spark.createDataFrame([(values[0][k], int(comp[i]) + 1) for i, k in enumerate(kept[0])], f"__level {schemas[effects[0]]}, __group int")
    out = {}
    for v in names:
        r = F.col(f"v_{v}") - F.lit(centers[v])
        for g in range(len(effects)):
            r = r - F.col(f"__e{g}_{v}")
        out[f"d_{v}"] = r
    data = data.withColumns(out)
    data = data.drop(*[f"__e{g}_{v}" for g in range(len(effects)) for v in names])
    means = sums_means(data, names, w)
    return Absorbed(data, total_rows - dropped, sizes, dropped, components, rounds, effects=tables, groups=groups, means=means)


def sums_means(data: DataFrame, names: list[str], w: Column) -> dict[str, float]:
    if not names:
        return {}
    row = data.agg(*[(F.sum(w * F.col(f"v_{n}")) / F.sum(w)).alias(f"m_{n}") for n in names]).first()
    return {n: row[f"m_{n}"] or 0.0 for n in names}


def _absorb_in_frames(base, effects, names, w, tol, most, keep_singletons, total_rows, centers) -> Absorbed:
    """The same by DataFrames: for cell tables beyond the driver. The level effects are the sums of the means taken off."""
    data = base
    while not keep_singletons:
        before = data.count()
        for f in effects:
            once = data.groupBy(f).agg(F.count("*").alias("__c")).filter("__c > 1").select(F.col(f).alias("__level"))
            data = data.join(once, F.col(f) == F.col("__level"), "left_semi")
        data = written(data, "fe-sample")
        if data.count() == before:
            break
    data = data.withColumns({f"d_{v}": (F.col(f"v_{v}") - F.lit(centers[v])).cast("double") for v in names})
    found: list[DataFrame] = []
    for f in effects:
        zero = data.select(F.col(f).alias("__level")).distinct()
        found.append(written(zero.withColumns({f"__t_{v}": F.lit(0.0) for v in names}), "fe-effects"))
    rounds = 0
    for rounds in range(1, most + 1):
        for g, f in enumerate(effects):
            means = data.groupBy(F.col(f).alias("__level")).agg(*[(F.sum(w * F.col(f"d_{v}")) / F.sum(w)).alias(f"__a_{v}") for v in names])
            means = written(means, "fe-means")
            found[g] = written(found[g].join(means, "__level").select("__level", *[(F.col(f"__t_{v}") + F.col(f"__a_{v}")).alias(f"__t_{v}") for v in names]), "fe-effects")
            data = data.join(means, F.col(f) == F.col("__level")).drop("__level")
            data = data.withColumns({f"d_{v}": F.col(f"d_{v}") - F.col(f"__a_{v}") for v in names}).withColumn("__move", F.greatest(F.lit(0.0), *[F.abs(f"__a_{v}") / (1 + F.abs(f"v_{v}")) for v in names])).drop(*[f"__a_{v}" for v in names])
        data = written(data, "fe-round")
        if len(effects) == 1 or (data.agg(F.max("__move")).first()[0] or 0.0) < tol:
            break
    else:
        raise EngineError(430, "the fixed effects did not converge")
    data = data.drop("__move")
    sizes = [t.count() for t in found]
    tables = [t.select("__level", *[F.col(f"__t_{v}").alias(f"__e{g}_{v}") for v in names]) for g, t in enumerate(found)]
    n = data.count()
    if not n:
        raise EngineError(2001, "insufficient observations")
    components, groups = 0, None
    if len(effects) > 1:
        edges = written(data.select(effects[0], effects[1]).distinct(), "fe-edges")
        label = edges.groupBy(effects[0]).agg(F.min(F.xxhash64(effects[1])).alias("__g"))
        while True:
            other = edges.join(label, effects[0]).groupBy(effects[1]).agg(F.min("__g").alias("__g"))
            new = written(edges.join(other, effects[1]).groupBy(effects[0]).agg(F.min("__g").alias("__g")), "fe-label")
            if new.join(label.withColumnRenamed("__g", "__old"), effects[0]).filter("__g <> __old").limit(1).count() == 0:
                break
            label = new
        # Components are numbered from 1 in the order of their labels.
        numbers = with_position(label.select("__g").distinct(), "__group", ["__g"])
        components = numbers.count()
        groups = label.join(numbers, "__g").select(F.col(effects[0]).alias("__level"), F.col("__group").cast("int").alias("__group"))
    return Absorbed(data, n, sizes, total_rows - n, components, rounds, effects=tables, groups=groups, means=sums_means(data, names, w))


def nested_in(data: DataFrame, effect: str, cluster: list[str]) -> bool:
    """Whether every level of ``effect`` lies in one cluster."""
    if [effect] == cluster:
        return True
    key = F.struct(*cluster)
    return data.groupBy(effect).agg((F.min(key) == F.max(key)).alias("one")).filter("not one").limit(1).count() == 0

