"""Cross-moments of columns in one aggregation, and the small dense algebra on them."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distributions import f_tail, t_tail


def cross(df: DataFrame, left: list[Column], right: list[Column] | None = None, weight: Column | None = None) -> np.ndarray:
    """Matrix of sums of weight * left_i * right_j over all rows, one aggregation for all entries."""
    w = weight if weight is not None else F.lit(1.0)
    if right is None:
        at = [(i, j) for i in range(len(left)) for j in range(i, len(left))]
        pairs = [left[i] * left[j] for i, j in at]
    else:
        at = [(i, j) for i in range(len(left)) for j in range(len(right))]
        pairs = [left[i] * right[j] for i, j in at]
    out = np.zeros((len(left), len(right) if right is not None else len(left)))
    if not at:
        return out
    row = df.agg(*[F.sum(w * p).alias(f"m{k}") for k, p in enumerate(pairs)]).first()
    for k, (i, j) in enumerate(at):
        out[i, j] = row[k] or 0.0
        if right is None:
            out[j, i] = out[i, j]
    return out


def sums(df: DataFrame, columns: list[Column], weight: Column | None = None) -> np.ndarray:
    w = weight if weight is not None else F.lit(1.0)
    return np.array([x or 0.0 for x in df.agg(*[F.sum(w * c).alias(f"s{i}") for i, c in enumerate(columns)]).first()]) if columns else np.zeros(0)


def dot(columns: list[Column], weights: np.ndarray) -> Column:
    out = F.lit(0.0)
    for c, w in zip(columns, weights, strict=True):
        out = out + c * F.lit(float(w))
    return out


def independent(gram: np.ndarray, own: np.ndarray | None = None, tol: float = 1e-10) -> list[int]:
    """Columns that are not combinations of earlier ones, by pivots in the given order.

    ``own`` holds each column's sum of squares before anything was partialled out.
    """
    g = gram.astype(float).copy()
    scale = np.maximum(np.diag(gram), 0) if own is None else np.asarray(own, float)
    kept: list[int] = []
    for i in range(len(g)):
        if g[i, i] <= tol * max(scale[i], 1e-300) or g[i, i] < 1e-14 * max(1.0, scale.max(initial=0.0)) * 1e-6:
            continue
        kept.append(i)
        col = g[:, i] / g[i, i]
        g = g - np.outer(col, g[i])
    return kept


def inverse(m: np.ndarray) -> np.ndarray:
    return np.linalg.inv(m) if m.size else m


def clusters_meat(df: DataFrame, by: list[str], scores: list[Column], weight: Column | None = None) -> tuple[np.ndarray, int]:
    """Sum over clusters of the outer products of their summed scores, and the number of clusters."""
    w = weight if weight is not None else F.lit(1.0)
    per = df.groupBy(*by).agg(*[F.sum(w * s).alias(f"g{i}") for i, s in enumerate(scores)])
    cols = [F.col(f"g{i}") for i in range(len(scores))]
    names = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = per.agg(F.count("*").alias("n"), *[F.sum(cols[i] * cols[j]).alias(f"m{k}") for k, (i, j) in enumerate(names)]).first()
    out = np.zeros((len(cols), len(cols)))
    for k, (i, j) in enumerate(names):
        out[i, j] = out[j, i] = row[k + 1] or 0.0
    return out, row[0]


@dataclass
class Result:
    """An estimate: names, coefficients ``b``, their covariance ``v``, and named scalars."""

    names: list[str]
    b: np.ndarray
    v: np.ndarray
    scalars: dict[str, float] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    effects: dict = field(default_factory=dict)
    sample: DataFrame | None = None
    model: dict = field(default_factory=dict)

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.v), 0))

    def rows(self) -> list[tuple]:
        df = self.scalars.get("df_r")
        out = []
        for n, b, s in zip(self.names, self.b, self.se, strict=True):
            t = b / s if s > 0 else float("nan")
            out.append((n, float(b), float(s), float(t), float(t_tail(t, df)) if t == t else None))
        return out

    def to_df(self, spark: SparkSession) -> DataFrame:
        """term, coef, se, t, p: one row for each coefficient."""
        return spark.createDataFrame(self.rows(), "term string, coef double, se double, t double, p double")

    def scalars_df(self, spark: SparkSession) -> DataFrame:
        """name, value: one row for each scalar."""
        return spark.createDataFrame([(k, float(v)) for k, v in sorted(self.scalars.items()) if v is not None], "name string, value double")


def wald(b: np.ndarray, v: np.ndarray, df_r: float) -> tuple[float, float]:
    """F statistic that all coefficients are zero, and its tail."""
    if not len(b):
        return float("nan"), float("nan")
    f = float(b @ np.linalg.pinv(v) @ b) / len(b)
    return f, f_tail(f, len(b), df_r)
