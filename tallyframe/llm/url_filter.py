"""URL filtering: host and path rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import shipped

#: (verdict, rule): the host up to the first slash, then the path with it.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Most labelled URLs that the trees are trained on; they are the first by a hash of the URL.
TRAIN_ROWS = 20_000
NUMERIC = ("length", "host_length", "path_length", "depth", "labels", "digits", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "host_entropy", "parameters", "fragment", "longest_part", "secure")
SUFFIXES = ("last_label", "last_two_labels", "path_suffix", "first_folder")


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):  # later ones, being longer, win
        owner, slash, rest = rule.partition("/")
        fits = ((host == owner) | host.endswith("." + owner)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def entropy(text: str) -> float:
    if not text:
        return 0.0
    p = np.unique(np.frombuffer(text.encode(), np.uint8), return_counts=True)[1] / len(text.encode())
    return float(-(p * np.log2(p)).sum())


def features(url: str, host: str, path: str) -> tuple[list[float], list[str]]:
    tail = url[url.find("://") + 3 + len(host) + len(path) :] if "://" in url else ""
    query, _, fragment = tail.partition("#")
    digits = sum(c.isdigit() for c in url)
    parts = [p for p in path.split("/") if p]
    labels = host.split(".")
    numeric = [
        len(url), len(host), len(path), len(parts), len(labels), digits, digits / max(1, len(url)), sum(c.isdigit() for c in host) / max(1, len(host)),
        host.count("-"), entropy(url), entropy(host), query.count("=") if query else 0, float(bool(fragment)), max(map(len, [*parts, *labels])), float(url.startswith("https")),
    ]
    last = parts[-1] if parts else ""
    return numeric, [labels[-1], ".".join(labels[-2:]), last[last.rfind(".") :] if "." in last else "", parts[0] if len(parts) > 1 else ""]


@dataclass
class Trees:
    """Boosted regression trees on the logistic loss, with binned features and suffix statistics."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    smooth: float = 10.0
    base: float = 0.0
    stats: list[dict] = field(default_factory=list)
    trees: list[list[tuple]] = field(default_factory=list)

    def design(self, rows: list[tuple[list[float], list[str]]]) -> np.ndarray:
        numeric = np.array([r[0] for r in rows], float).reshape(len(rows), len(NUMERIC))
        known = [[s.get(r[1][i], self.base) for r in rows] for i, s in enumerate(self.stats)]
        return np.column_stack([numeric, *[np.array(k, float) for k in known]])

    def fit(self, rows: list[tuple[list[float], list[str]]], y: np.ndarray) -> Trees:
        mean = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(mean / (1 - mean)))
        for i in range(len(SUFFIXES)):  # smoothed log-odds of each suffix among the labelled URLs
            names, number = np.unique([r[1][i] for r in rows], return_inverse=True) if rows else (np.array([]), np.array([], int))
            n, hit = np.bincount(number, minlength=len(names)), np.bincount(number, weights=y, minlength=len(names))
            p = (hit + self.smooth * mean) / (n + self.smooth)
            self.stats.append(dict(zip(names.tolist(), np.log(p / (1 - p)).tolist(), strict=True)))
        if not len(y) or y.min() == y.max():
            return self
        x = self.design(rows)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            tree: list[tuple] = []
            self._grow(tree, binned, cuts, g, h, np.arange(len(y)), self.depth)
            self.trees.append(tree)
            f += self._leaf(tree, x)
        return self

    def _grow(self, tree, binned, cuts, g, h, rows, depth) -> int:
        """Appends the subtree over ``rows``; returns its number."""
        me = len(tree)
        tree.append((-1, 0.0, 0, 0, self.rate * g[rows].sum() / (h[rows].sum() + 1)))
        best = (1e-3, -1, 0)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for j in range(binned.shape[1]) if depth else []:
            width = len(cuts[j]) + 1
            left_g = np.cumsum(np.bincount(binned[rows, j], weights=g[rows], minlength=width))[:-1]
            left_h = np.cumsum(np.bincount(binned[rows, j], weights=h[rows], minlength=width))[:-1]
            if not len(left_g):
                continue
            gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
            gain[(left_h < 1) | (total_h - left_h < 1)] = 0
            b = int(np.argmax(gain))
            if gain[b] > best[0]:
                best = (gain[b], j, b)
        if best[1] >= 0:
            _, j, b = best
            go = binned[rows, j] <= b
            left = self._grow(tree, binned, cuts, g, h, rows[go], depth - 1)
            right = self._grow(tree, binned, cuts, g, h, rows[~go], depth - 1)
            tree[me] = (j, float(cuts[j][b]), left, right, 0.0)
        return me

    def _leaf(self, tree, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        feature, cut, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
        for _ in range(self.depth):
            j = feature[at]
            go = x[np.arange(len(x)), np.maximum(j, 0)] <= cut[at]
            at = np.where(j < 0, at, np.where(go, left[at], right[at]))
        return value[at]

    def blocked(self, rows: list[tuple[list[float], list[str]]]) -> np.ndarray:
        """Probability that each URL is to be blocked."""
        x = self.design(rows)
        return 1 / (1 + np.exp(-(self.base + sum((self._leaf(t, x) for t in self.trees), np.zeros(len(x))))))


def train(labelled: DataFrame, most: int = TRAIN_ROWS) -> Trees:
    """Fit the trees on ``labelled`` (url, label 1 = block): the first ``most`` distinct URLs by hash."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = labelled.select("url", host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label")).groupBy("url", "host", "path").agg(F.max("label").alias("label"))
    sample = rows.orderBy(F.xxhash64("url"), "url").limit(most).collect()
    return Trees().fit([features(r.url, r.host, r.path) for r in sample], np.array([r.label for r in sample], float))


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Judge the url of every row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    The longest fitting rule decides. A rule fits its host and all subdomains if the path starts
    with the rule's. Other URLs are judged by the trees, which are trained on ``labelled``
    (url, label) or, without it, on the URLs of ``pages`` that the rules decide.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is judged by
    the trees like any other. Without any labelled URL the trees allow. Null and repeated page_ids
    are kept row by row; an empty table gives an empty result; only page_id and url are read.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = shipped(pages).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "says": says})
    if labelled is None:
        labelled = rows.filter("says is not null").select("url", (F.col("says") == "block").cast("int").alias("label"))
    trees = pages.sparkSession.sparkContext.broadcast(train(labelled))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            urls, hosts, paths, rule_names, verdicts = (batch.column(i).to_pylist() for i in range(1, 6))
            open_rows = [i for i, v in enumerate(verdicts) if v is None]
            p = trees.value.blocked([features(urls[i] or "", hosts[i], paths[i]) for i in open_rows]) if open_rows else []
            for i, x in zip(open_rows, p, strict=True):
                verdicts[i] = "block" if x >= threshold else "allow"
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(rule_names, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = dict(rows.dtypes)["page_id"]
    return rows.select("page_id", "url", "host", "path", "rule", "says").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
