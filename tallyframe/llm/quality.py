"""Quality scores by Bradley-Terry pairwise ranking over document features."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lower_ascii, shipped, slices, span_hashes, text_bytes, word_spans

#: Most labelled documents that the model is fitted on: the first by a hash of doc_id.
TRAIN_ROWS = 8_000
#: Most bytes of their texts; a document that would go beyond is passed over.
TRAIN_BYTES = 64_000_000
#: Preference pairs drawn from them.
PAIRS = 40_000
KNOTS = (0.1, 0.25, 0.5, 0.75, 0.9)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _class(text: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(text)] = True
    return out


CLASSES = {
    "symbols": _class(b"#$%&*@^~|\\<>{}[]=+_"),
    "pipes": _class(b"|"),
    "marks": _class(b".,;:!?"),
    "stops": _class(b"."),
    "shouts": _class(b"!"),
    "digits": _class(b"0123456789"),
    "capitals": _class(bytes(range(65, 91))),
    "letters": _class(bytes([*range(65, 91), *range(97, 123)])),
    "beyond": _class(bytes(range(128, 256))),
    "lines": _class(b"\n"),
    "spaces": _SPACE,
}
NAMES = (*CLASSES, "log_bytes", "log_words", "word_bytes", "long_words", "short_words", "distinct", "repeat_next", "commonest", "line_words", "distinct_lines")


def _rows_sum(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[off])


def document_features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of features for each text, all texts side by side; empty texts have zeros."""
    n = len(off) - 1
    size = np.diff(off)
    out = [_rows_sum(flag[data], off) / np.maximum(size, 1) for flag in CLASSES.values()]
    low = lower_ascii(data)
    begin, end, row = word_spans(low, off, ~_SPACE)
    words = np.bincount(row, minlength=n)
    per_word = np.maximum(words, 1)
    length = end - begin
    out += [np.log1p(size), np.log1p(words), size / per_word, np.bincount(row, weights=length > 14, minlength=n) / per_word, np.bincount(row, weights=length <= 3, minlength=n) / per_word]
    h = span_hashes(low, begin, end)
    order = np.lexsort((h, row))
    same = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])]) if len(h) else np.zeros(0, bool)
    distinct = np.bincount(row[order], weights=~same, minlength=n)
    run = np.flatnonzero(~same)
    longest = np.zeros(n)
    np.maximum.at(longest, row[order][run], np.diff(np.append(run, len(same))))
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (row[1:] == row[:-1])]) if len(h) else np.zeros(0, bool)
    out += [distinct / per_word, np.bincount(row, weights=again, minlength=n) / per_word, longest / per_word]
    line_of = np.ones(256, bool)
    line_of[0x0A] = False
    lb, le, lrow = word_spans(data, off, line_of)
    lines = np.bincount(lrow, minlength=n)
    lh = span_hashes(data, lb, le)
    both = np.unique(np.stack([lrow.astype(np.uint64), lh]), axis=1)[0].astype(np.int64) if len(lh) else np.zeros(0, np.int64)
    out += [words / np.maximum(lines, 1), np.bincount(both, minlength=n) / np.maximum(lines, 1)]
    return np.column_stack(out)


@dataclass
class PairwiseRanker:
    """Scores whose difference is the log-odds that one document is preferred to another."""

    knots: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    slope: float

    @staticmethod
    def basis(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
        """The features and their excess over each knot, so that a feature can act differently at its ends."""
        return np.column_stack([x, *[np.maximum(x - k, 0) for k in knots]])

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, at: float, seed: int = 5, ridge: float = 1e-3) -> PairwiseRanker:
        """Fit on features and labels 0/1; scores at the quantile that separates the labels' shares become ``at``."""
        if not len(y) or y.min() == y.max():
            width = len(NAMES) * (1 + len(KNOTS))
            only = 0.0 if not len(y) else (1.0 if y[0] else -1.0)
            return cls(np.zeros((len(KNOTS), len(NAMES))), np.zeros(width), np.ones(width), np.zeros(width), -only, 1.0)
        knots = np.quantile(x, KNOTS, axis=0)
        z = cls.basis(x, knots)
        center, scale = z.mean(axis=0), z.std(axis=0)
        scale[scale < 1e-12] = 1
        z = (z - center) / scale
        rng = np.random.default_rng(seed)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
        w = np.zeros(z.shape[1])
        for _ in range(30):  # Newton steps on the logistic loss of the differences
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w)), d.T @ p / len(d) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        s = z @ w
        # Among cuts between neighbouring score quantiles, the one near the share of label 0 that errs least, both labels alike.
        share = 1 - y.mean()
        grid = np.quantile(s, np.clip(np.linspace(0.5 * share, min(1.5 * share, 1), 201), 0, 1))
        errs = [np.mean(s[bad] >= c) + np.mean(s[good] < c) for c in grid]
        best = np.flatnonzero(np.isclose(errs, min(errs)))
        threshold = float(grid[best[len(best) // 2]])
        slope = 4.0 / max(float(np.std(s)), 1e-9)
        shift = np.log(at / (1 - at)) / slope
        return cls(knots, center, scale, w, threshold - shift, slope)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.basis(x, self.knots) - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.slope * (z @ self.weight - self.threshold), -30, 30)))


def held_out() -> "F.Column":
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, text and y of labelled documents that are not held out: the first by a hash of doc_id, at most ``most``
    of them and whole texts of at most ``most_bytes`` bytes in all. A doc_id that stands on several rows gives one text,
    that of the smallest hash."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null").filter(~held_out())
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(most)
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    # Sizes first: the driver holds at most ``most`` rows of numbers, and no text before the bound is known.
    sizes = texts.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("h", F.octet_length("text").alias("n"))).alias("first"))
    sizes = sizes.select("doc_id", "y", "first.h", "first.n", F.xxhash64("doc_id", F.lit(3)).alias("at")).collect()
    chosen, held = [], 0
    for r in sorted(sizes, key=lambda r: (r["at"], r["doc_id"])):
        if held + r["n"] > most_bytes:
            continue
        held += r["n"]
        chosen.append({"doc_id": r["doc_id"], "h": r["h"], "y": r["y"]})
    made = F.from_json(F.lit(json.dumps(chosen)), "array<struct<doc_id: bigint, h: bigint, y: int>>")
    wanted = docs.sparkSession.range(1).select(F.inline(made))
    return texts.join(F.broadcast(wanted), ["doc_id", "h"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "y")


def feature_rows(rows: DataFrame, keep: str) -> DataFrame:
    """doc_id, ``keep`` (a long column of ``rows``) and the features x of each text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, batch.column(3).to_pylist(), 4_000_000):
                x = document_features(*text_bytes(part.column(1)))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), flat], ["doc_id", keep, "x"])

    return shipped(rows).select("doc_id", "text", F.col(keep).cast("long").alias(keep), F.octet_length("text").alias("n")).mapInArrow(run, f"doc_id long, {keep} long, x array<double>")


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, most: int = TRAIN_ROWS) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Pairs of a document labelled 1 and one labelled 0 are preferences; a logistic loss on the
    differences of their features gives the weights. The features come from the text alone. The
    model is fitted on at most ``most`` labelled rows (and ``TRAIN_BYTES`` bytes of text), none of them held out (crc32 of doc_id as
    text, modulo 4, is 2).

    Null and empty texts have zero features and a score like any other. Null doc_ids are not held
    out; null, tied and repeated rows are kept; labels without a document or value are passed
    over; without labels of both kinds all scores are equal. Empty tables give empty results.
    """
    sample = feature_rows(labelled_sample(docs, labels, label, most), "y").select("y", "x", "doc_id").collect()
    sample.sort(key=lambda r: (r.doc_id, r.y, r.x))
    x = np.array([r.x for r in sample], float).reshape(len(sample), len(NAMES))
    model = docs.sparkSession.sparkContext.broadcast(PairwiseRanker.fit(x, np.array([r.y for r in sample], int), threshold))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, batch.column(2).to_pylist(), 4_000_000):
                score = model.value.score(document_features(*text_bytes(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["doc_id", "score"])

    text = F.coalesce(F.col("text"), F.lit(""))
    read = shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).alias("n"))
    out = read.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
