"""Sorting, keyed merges, label dictionaries and numeric parsing, all as lazy plans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..common import EngineError, fresh, is_numeric, is_string, need, order_keys, same, with_position

ALGORITHMS = ("auto", "lsd", "msd", "timsort", "sample", "counting", "merge", "ips4o")


def sort_rows(df: DataFrame, keys: list[str], ties: list[str] | None = None, algorithm: str = "auto") -> DataFrame:
    """Ascending by ``keys``, missing last, strings by bytes; ``ties`` settle equal keys.

    Spark's sort is not stable, so a stable result needs ``ties`` that are unique; without them the
    position of the rows in ``df`` is used. ``algorithm`` is checked and otherwise left to Spark.
    """
    need(df, *keys, *(ties or []))
    if algorithm not in ALGORITHMS:
        raise EngineError(198, f"unknown algorithm {algorithm}")
    if ties is not None:
        return df.orderBy(*order_keys(keys, *ties))
    return df.withColumn("__at", F.monotonically_increasing_id()).orderBy(*order_keys(keys, "__at")).drop("__at")


# ---------------------------------------------------------------------------------------- merges


def _on(left: list[str], right: list[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right, strict=True):
        cond = cond & same(F.col(a), F.col(b))
    return cond


def _unique(df: DataFrame, keys: list[str], side: str) -> None:
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise EngineError(459, f"the keys do not identify the rows of the {side} data")


def _first(df: DataFrame, keys: list[str], order: list[str] | None) -> DataFrame:
    rows = df.withColumn("__at", F.struct(*order) if order else F.monotonically_increasing_id())
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), "__at").alias("__r"))
    return best.select("__r.*")


def keyed_merge(
    master: DataFrame,
    using: DataFrame,
    keys: list[str],
    kind: str = "1:1",
    *,
    keep: set[int] | None = None,
    assert_: set[int] | None = None,
    generate: str | None = "_merge",
    keepusing: list[str] | None = None,
    update: bool = False,
    replace: bool = False,
    replace_missing: bool = False,
    unchecked: bool = False,
    force: bool = False,
    master_order: list[str] | None = None,
    using_order: list[str] | None = None,
) -> DataFrame:
    """Merge two tables by key; ``generate`` names the indicator: 1 master only, 2 using only, 3 both.

    Missing keys match each other. 1:1, m:1 and 1:m require unique keys on the sides marked 1
    (error 459); ``unchecked`` takes the first row of each key instead. m:m pairs rows one by one
    in the given orders and repeats the last row of the shorter side; it is no cross product.

    ``keep`` decides the join type, so rows that go are never built. ``assert_`` (error 9) looks at
    the classes before ``keep``. Columns on both sides keep the master's value where there is one
    row of the master; ``update`` fills its missing values, ``replace`` overwrites with non-missing
    values of using, with ``replace_missing`` with missing ones too.
    """
    if kind not in ("1:1", "m:1", "1:m", "m:m"):
        raise EngineError(198, f"unknown merge {kind}")
    need(master, *keys)
    need(using, *keys)
    for k in keys:
        if is_string(master, k) != is_string(using, k):
            if not force:
                raise EngineError(106, f"{k} is a string on one side only")
            master, using = master.withColumn(k, F.col(k).cast("string")), using.withColumn(k, F.col(k).cast("string"))
    if generate:
        fresh(master, generate)
        fresh(using, generate)
    if keepusing is not None:
        need(using, *keepusing)
        using = using.select(*dict.fromkeys([*keys, *keepusing, *(using_order or [] if kind == "m:m" else [])]))
    if kind in ("1:1", "m:1"):
        if unchecked:
            using = _first(using, keys, using_order)
        else:
            _unique(using, keys, "using")
    if kind in ("1:1", "1:m"):
        if unchecked:
            master = _first(master, keys, master_order)
        else:
            _unique(master, keys, "master")
    left = master.select(*[F.col(c).alias(f"m_{c}") for c in master.columns], F.lit(True).alias("__m"))
    right = using.select(*[F.col(c).alias(f"u_{c}") for c in using.columns], F.lit(True).alias("__u"))
    lk, rk = [f"m_{k}" for k in keys], [f"u_{k}" for k in keys]
    if kind == "m:m":
        left, right = _paired(left, right, lk, rk, [f"m_{c}" for c in master_order or master.columns], [f"u_{c}" for c in using_order or using.columns])
        lk, rk = [*lk, "__tm"], [*rk, "__tu"]
    classes = set(keep) if keep else {1, 2, 3}
    if assert_ is not None and not {1, 2, 3} <= set(assert_):
        _assert(left, right, lk, rk, set(assert_))
    how = {frozenset({3}): "inner", frozenset({1, 3}): "left", frozenset({2, 3}): "right"}.get(frozenset(classes), "full")
    if classes == {1}:
        joined = left.join(right, _on(lk, rk), "left_anti").select("*", *[F.lit(None).cast(t).alias(c) for c, t in right.dtypes])
    elif classes == {2}:
        joined = right.join(left, _on(rk, lk), "left_anti").select("*", *[F.lit(None).cast(t).alias(c) for c, t in left.dtypes])
    else:
        joined = left.join(right, _on(lk, rk), how)
    return _merged_columns(joined, master, using, keys, classes, generate, update, replace, replace_missing)


def _merged_columns(joined, master, using, keys, classes, generate, update, replace, replace_missing) -> DataFrame:
    has_m, has_u = F.col("__m").isNotNull(), F.col("__u").isNotNull()
    which = F.when(has_m & has_u, 3).when(has_m, 1).otherwise(2)
    out = []
    for c in master.columns:
        m = F.col(f"m_{c}")
        if c in keys:
            out.append(F.when(has_m, m).otherwise(F.col(f"u_{c}")).alias(c))
        elif c in using.columns:
            u = F.col(f"u_{c}")
            both = u if replace and replace_missing else F.coalesce(u, m) if replace else F.coalesce(m, u) if update else m
            out.append(F.when(~has_m, u).when(has_u, both).otherwise(m).alias(c))
        else:
            out.append(m.alias(c))
    out += [F.col(f"u_{c}").alias(c) for c in using.columns if c not in master.columns]
    if classes != {1, 2, 3}:
        joined = joined.filter(which.isin(*classes))
    return joined.select(*out, *([which.alias(generate)] if generate else []))


def _assert(left: DataFrame, right: DataFrame, lk: list[str], rk: list[str], allowed: set[int]) -> None:
    checks = {1: ("left_anti", left, right, lk, rk), 2: ("left_anti", right, left, rk, lk), 3: ("left_semi", left, right, lk, rk)}
    for c in {1, 2, 3} - allowed:
        how, a, b, ka, kb = checks[c]
        if a.join(b, _on(ka, kb), how).limit(1).count():
            raise EngineError(9, f"some rows are of merge class {c}")


def _paired(left, right, lk, rk, l_order, r_order) -> tuple[DataFrame, DataFrame]:
    """Number the rows of each key on both sides; the last row of the shorter side stands for all further numbers."""

    def side(df: DataFrame, other: DataFrame, keys: list[str], other_keys: list[str], order: list[str], name: str) -> DataFrame:
        n_other = other.groupBy(*other_keys).agg(F.count("*").alias("__no")).select(*[F.col(k).alias(f"__{k}") for k in other_keys], "__no")
        w = W.partitionBy(*keys)
        numbered = df.withColumn("__i", F.row_number().over(w.orderBy(*order_keys(order)))).withColumn("__n", F.count("*").over(w))
        met = numbered.join(n_other, _on(keys, [f"__{k}" for k in other_keys]), "left").drop(*[f"__{k}" for k in other_keys])
        last = F.when(F.col("__i") == F.col("__n"), F.greatest(F.col("__n"), F.coalesce("__no", F.lit(0)))).otherwise(F.col("__i"))
        return met.withColumn(name, F.explode(F.sequence(F.col("__i").cast("long"), last.cast("long")))).drop("__i", "__n", "__no")

    return side(left, right, lk, rk, l_order, "__tm"), side(right, left, rk, lk, r_order, "__tu")


def positional_merge(master: DataFrame, using: DataFrame, master_order: list[str] | None = None, using_order: list[str] | None = None, **options) -> DataFrame:
    """Pair rows by position: the n-th row of both, in the given orders."""
    a, b = with_position(master, "__row", master_order), with_position(using, "__row", using_order)
    return keyed_merge(a, b, ["__row"], "1:1", unchecked=False, **options).drop("__row")


def merge_counts(merged: DataFrame, generate: str = "_merge") -> DataFrame:
    """Rows of each merge class."""
    return merged.groupBy(generate).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------------- label dictionaries


def label_dictionary(df: DataFrame, column: str, first: int = 1, known: DataFrame | None = None) -> DataFrame:
    """code and label of the distinct non-empty strings of ``column``, in byte order from ``first``.

    With ``known`` (code, label) its codes stay and new strings follow its largest code.
    """
    need(df, column)
    if not is_string(df, column):
        raise EngineError(107, f"{column} is not a string column")
    labels = df.select(F.col(column).alias("label")).filter("label is not null and label <> ''").distinct()
    if known is not None:
        labels = labels.join(known.select("label"), "label", "left_anti")
        top = known.agg(F.max("code")).first()[0]
        first = (top or 0) + 1
    # Numbered through sorted partitions, not in one window over all labels.
    coded = with_position(labels, "__row", ["label"]).select((F.col("__row") + (first - 1)).cast("int").alias("code"), "label")
    return coded if known is None else known.select(F.col("code").cast("int").alias("code"), "label").unionByName(coded)


def encode_labels(df: DataFrame, columns: list[str], generate: list[str] | None = None, labels: DataFrame | None = None, noextend: bool = False, extend: bool = True, most: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """Integer codes for string columns and the dictionary (code, label) that the columns share.

    Codes run from 1 in byte order; empty and missing strings have none. ``labels`` with
    ``noextend``: only its strings are coded; with ``extend``: it is continued; with neither, it is
    replaced. Without ``generate`` the columns themselves are replaced.
    """
    if generate:
        fresh(df, *generate)
    both = None
    for c in columns:
        need(df, c)
        if not is_string(df, c):
            raise EngineError(107, f"{c} is not a string column")
        one = df.select(F.col(c).alias("label"))
        both = one if both is None else both.unionByName(one)
    if labels is not None and noextend:
        dictionary = labels.select(F.col("code").cast("int").alias("code"), "label")
    else:
        dictionary = label_dictionary(both, "label", known=labels if labels is not None and extend else None)
    n = dictionary.count()
    if n > most:
        raise EngineError(134, f"{n} distinct strings; at most {most}")
    table = F.broadcast(dictionary)  # at most `most` rows
    out = df
    for c, g in zip(columns, generate or columns, strict=True):
        coded = table.select(F.col("label").alias("__l"), F.col("code").alias("__c"))
        out = out.join(coded, F.col(c) == F.col("__l"), "left").withColumn(g, F.col("__c")).drop("__l", "__c")
    return out.select(*df.columns, *(generate or [])), dictionary


def decode_labels(df: DataFrame, columns: list[str], labels: DataFrame, generate: list[str] | None = None, maxlength: int | None = None, most: int = 65_536) -> DataFrame:
    """Strings for integer codes by a dictionary (code, label); codes without a label, and missing ones, give ''."""
    if labels is None or not labels.columns:
        raise EngineError(182, "no dictionary")
    if generate:
        fresh(df, *generate)
    for c in columns:
        need(df, c)
        if not is_numeric(df, c):
            raise EngineError(108, f"{c} is not numeric")
    n = labels.count()
    table = labels.select(F.col("code").cast("double").alias("__c"), F.col("label").alias("__l"))
    out = df
    for c, g in zip(columns, generate or columns, strict=True):
        text = F.coalesce(F.col("__l"), F.lit(""))
        text = F.substring(text, 1, maxlength) if maxlength else text
        out = out.join(F.broadcast(table) if n <= most else table, F.col(c).cast("double") == F.col("__c"), "left").withColumn(g, text).drop("__c", "__l")
    return out.select(*df.columns, *(generate or []))


def longest_label(labels: DataFrame) -> DataFrame:
    return labels.agg(F.coalesce(F.max(F.length("label")), F.lit(0)).alias("longest"))


# --------------------------------------------------------------------------------- numeric parsing

#: What reads as a number, and what reads as missing (in any case).
NUMBER = r"^[ \t]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\r\n]*$"
MISSING = ("", ".", "na", "nan")


def parsed(text: Column, ignore: str = "", percent: bool = False, decimal: str = ".", group: str = "") -> tuple[Column, Column]:
    """The number in a text, and whether the text is neither number nor missing."""
    drop = set(ignore) | set(group) - {decimal}
    clean = F.coalesce(text, F.lit(""))
    if drop:
        clean = F.translate(clean, "".join(sorted(drop)), "")
    has_percent = F.contains(clean, F.lit("%")) if percent else F.lit(False)
    if percent:
        clean = F.translate(clean, "%", "")
    if decimal != ".":
        clean = F.translate(F.regexp_replace(clean, re.escape("."), "?"), decimal, ".")
    bare = F.regexp_replace(clean, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    value = F.when(clean.rlike(NUMBER), bare.try_cast("double"))
    value = F.when(has_percent, value / 100).otherwise(value)
    empty = F.lower(bare).isin(*MISSING)
    return F.when(~empty, value), ~empty & value.isNull()


def parse_numeric(df: DataFrame, columns: list[str], generate: list[str] | None = None, ignore: str = "", force: bool = False, percent: bool = False, dpcomma: bool = False, float_: bool = False, on_error: str = "raise") -> DataFrame:
    """Numbers from string columns; numeric columns pass unchanged.

    A text that is no number raises (error 109) unless ``force`` or ``on_error='null'``, which make
    it missing. ``percent`` drops % signs and divides by 100; ``dpcomma`` reads 1.234,5.
    """
    need(df, *columns)
    if generate:
        fresh(df, *generate)
    decimal, group = (",", ".") if dpcomma else (".", "")
    values, bad = {}, F.lit(False)
    for c, g in zip(columns, generate or columns, strict=True):
        if is_numeric(df, c):
            continue
        v, failed = parsed(F.col(c), ignore, percent, decimal, group)
        values[g] = v.cast("float") if float_ else v
        bad = bad | failed
    if not force and on_error == "raise" and values and df.filter(bad).limit(1).count():
        raise EngineError(109, "a text is not a number; use force to make such texts missing")
    return df.withColumns(values)


def parse_counts(df: DataFrame, column: str, **options) -> DataFrame:
    """n_converted and n_failed of one column, in one pass."""
    v, failed = parsed(F.col(column), **options)
    return df.agg(F.count(v).alias("n_converted"), F.sum(failed.cast("long")).alias("n_failed"))
