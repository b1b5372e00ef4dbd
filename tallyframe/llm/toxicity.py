"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words sums, over all subsequences of three characters that both have, decay^span
of the one times decay^span of the other, so characters inserted between or left out lower it but
do not break it. Words carry marks at both ends and are scaled by the weight of all their triples.

A text is judged by its sentences and a sentence by its most insult-like unit, so training is
multiple-instance: the units that tell the toxic sentences from clean ones are the positives. The
machine is linear in the kernels with the landmarks; summed over the landmarks it is one weight for
each character triple, which is how texts are scored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import kept, shipped, slices, trimmed
from .quality import held_out, labelled_sample

#: Most labelled documents that the model is fitted on: the first by a hash of doc_id.
TRAIN_ROWS = 8_000
#: Most units that the machine is fitted on: insult-like ones by how many sentences they tell, clean ones at random
#: and by frequency, and in each round the clean ones with the highest margins. All units of the labelled rows are
#: counted, and all clean ones are searched for the highest margins.
POSITIVES, RANDOM_CLEAN, COMMON_CLEAN, WORST_CLEAN = 4_000, 4_000, 1_000, 1_500
LANDMARKS = 384
DECAY = 0.5
#: Characters that a subsequence may span.
SPAN = 8
#: Log-likelihood ratio above which a unit or prefix tells toxic sentences from clean ones.
TELLING = 11.0
PREFIXES = (4, 5)
#: Rounds of training, each with the worst clean units of the one before.
TURNS = 5
#: Longest unit that is compared as one; longer ones are cut into overlapping pieces that cover them.
WIDTH = 24
REMEMBERED = 200_000
ALPHABET = 64
_GAP = re.compile(r"[^\W_]+")
_SPELLED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def codes(words: list[str]) -> np.ndarray:
    """Characters of words of one length, with their marks, as 0..63: marks, letters, digits, others by code point."""
    o = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.int64)
    return np.select([o < 4, (o >= 97) & (o <= 122), (o >= 48) & (o <= 57)], [o - 2, o - 95, o - 20], 38 + o % 26)


@lru_cache(maxsize=None)
def triples(length: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Index triples of a unit of this length, the decay of each one's span, and the unit's norm."""
    at = np.array([c for c in combinations(range(length), 3) if c[2] - c[0] < SPAN], np.int64).reshape(-1, 3)
    weight = DECAY ** (at[:, 2] - at[:, 0] + 1.0) if len(at) else np.zeros(0)
    return at, weight, float(np.sqrt((weight**2).sum())) or 1.0


def token_units(token: str) -> set[str]:
    """The words that a token may stand for: all its letters without what is between them, and each part."""
    parts = _GAP.findall(token)
    return {"".join(parts), *parts} - {""}


def tokens(text: str) -> set[str]:
    """The distinct tokens of a text, and runs of at least three single characters joined."""
    low = text.lower()
    return {*low.split(), *("".join(run.split()) for run in _SPELLED.findall(low))}


def units(text: str) -> set[str]:
    return set().union(*map(token_units, tokens(text)))


def pieces(unit: str) -> list[str]:
    if len(unit) <= WIDTH:
        return [unit]
    step = WIDTH // 2
    return [unit[i : i + WIDTH] for i in range(0, len(unit) - step, step)]


def by_length(words: list[str]):
    """(numbers, code matrix) of the words of each length."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, rows in groups.items():
        for i in range(0, len(rows), 20_000):
            part = rows[i : i + 20_000]
            yield np.array(part), codes([words[r] for r in part])


def triple_codes(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each triple of each row, and its scaled weight."""
    at, weight, norm = triples(c.shape[1])
    return (c[:, at[:, 0]] * ALPHABET + c[:, at[:, 1]]) * ALPHABET + c[:, at[:, 2]], weight / norm


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Scaled subsequence kernel of every word with every landmark."""
    used = np.unique(np.concatenate([triple_codes(c)[0].ravel() for _, c in by_length(landmarks)]))
    phi = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    for rows, c in by_length(landmarks):
        t, w = triple_codes(c)
        for i, r in enumerate(rows):
            np.add.at(phi[:, r], np.searchsorted(used, t[i]), w)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for rows, c in by_length(words):
        step = max(1, 2_000_000 // (len(triples(c.shape[1])[0]) * len(landmarks) + 1))
        for i in range(0, len(rows), step):
            t, w = triple_codes(c[i : i + step])
            at = np.minimum(np.searchsorted(used, t), len(used) - 1)
            at[used[at] != t] = len(used)
            out[rows[i : i + step]] = np.einsum("ijk,j->ik", phi[at], w.astype(np.float32))
    return out


def svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 3e-5) -> np.ndarray:
    """Weights (last: bias) of the linear machine with squared hinge loss, by Newton steps; y is 1 or -1."""
    width = z.shape[1] + 1
    penalty = ridge * np.eye(width)
    penalty[-1, -1] = 1e-9
    w = np.zeros(width)
    for _ in range(50):
        gram, side = np.zeros((width, width)), np.zeros(width)
        for i in range(0, len(z), 2_000):  # in parts, so that no second copy of z is held
            part = np.column_stack([z[i : i + 2_000], np.ones(len(z[i : i + 2_000]))])
            c = cost[i : i + 2_000] * (1 - y[i : i + 2_000] * (part @ w) > 0)
            gram += (part * c[:, None]).T @ part
            side += part.T @ (c * y[i : i + 2_000])
        new = np.linalg.solve(gram / cost.sum() + penalty, side / cost.sum())
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


@dataclass
class StringMachine:
    """``table``: weight of each character triple; a unit's margin is its scaled triples' weights and the bias."""

    table: np.ndarray
    bias: float
    slope: float
    shift: float
    name: str = ""

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for rows, c in by_length(words):
            for i in range(0, len(rows), 1024):
                t, w = triple_codes(c[i : i + 1024])
                out[rows[i : i + 1024]] += self.table[t] @ w
        return out

    @property
    def floor(self) -> float:
        """Margin of a text without units: that of one which shares nothing with any landmark, or less."""
        return min(self.bias, -1.0)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


class Scorer:
    """Margins of texts: the largest of their tokens' units. Remembers the tokens it has seen."""

    def __init__(self, machine: StringMachine):
        self.machine, self.known = machine, {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        found = [tokens(t) for t in texts]
        known = self.known
        new = list(set().union(*found) - known.keys()) if found else []
        parts = [(i, p) for i, t in enumerate(new) for u in token_units(t) for p in pieces(u)]
        best = np.full(len(new), self.machine.floor)
        if parts:
            np.maximum.at(best, np.array([i for i, _ in parts]), self.machine.margins([p for _, p in parts]))
        known.update(zip(new, best.tolist(), strict=True))
        out = np.array([max(map(known.__getitem__, f), default=self.machine.floor) for f in found])
        if len(known) > REMEMBERED:  # the first tokens stay; these were for this call
            for t in new:
                del known[t]
        return out


def fit(texts: list[str], y: np.ndarray, at: float, landmarks: int = LANDMARKS, seed: int = 11) -> StringMachine:
    """Train on texts labelled 1 (toxic) or 0; probabilities of ``at`` fall between the labels' margins."""
    flat = StringMachine(np.zeros(ALPHABET**3), -1.0, 1.0, float(np.log(at / (1 - at))))
    if not len(y) or y.min() == y.max():
        return flat
    rng = np.random.default_rng(seed)
    # Units and prefixes by the distinct sentences they are in: copies of a text count once. Of clean
    # sentences only prefixes that toxic ones have are counted.
    seen: list[dict[str, int]] = [{}, {}]
    total = [0, 0]
    witness: dict[str, int] = {}
    toxic_sentences = []
    read: set[bytes] = set()
    for label in (1, 0):  # a sentence that texts of both labels have counts as one of a toxic text
        for text in (t for t, own in zip(texts, y.tolist(), strict=True) if own == label):
            for s in _SENTENCE.split(text):
                mark = hashlib.blake2b(s.encode(), digest_size=8).digest()
                if mark in read:
                    continue
                read.add(mark)
                u = {p for x in units(s) for p in pieces(x)}
                heads = {x[:n] + "\0" for x in u for n in PREFIXES if len(x) > n}
                total[label] += 1
                if label:
                    toxic_sentences.append(u)
                for x in u | (heads if label else heads & seen[1].keys()):
                    seen[label][x] = seen[label].get(x, 0) + 1
    del read
    share = total[1] / sum(total)

    def telling(x: str) -> float:
        c1, c0 = seen[1].get(x, 0), seen[0].get(x, 0)
        if c1 * (1 - share) <= 4 * c0 * share:
            return 0.0
        e1, e0 = (c1 + c0) * share, (c1 + c0) * (1 - share)
        return c1 * np.log(c1 / e1) + (c0 * np.log(c0 / e0) if c0 else 0.0)

    strength = {x: t for x in seen[1] if (t := telling(x)) > TELLING}
    for u in toxic_sentences:
        for x in u:
            if x in strength or any(x[:n] + "\0" in strength for n in PREFIXES):
                witness[x] = witness.get(x, 0) + 1
    if not witness:
        return flat
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    strong = sorted(witness, key=lambda u: (-witness[u], u))
    seen[0] = {x: c for x, c in seen[0].items() if not x.endswith("\0")}
    clean = sorted(seen[0], key=lambda u: (-seen[0][u], u))
    some = [clean[i] for i in sorted(rng.choice(len(clean), min(len(clean), RANDOM_CLEAN), replace=False))]
    common = clean[:COMMON_CLEAN]
    marks = strong[: landmarks * 3 // 4] + some[: landmarks // 4]
    gram = kernel(marks, marks).astype(float)
    value, vector = np.linalg.eigh(gram)
    keep = value > 1e-6 * value[-1]
    whiten = vector[:, keep] / np.sqrt(value[keep])
    positives = sorted(strong[:POSITIVES])
    negatives = sorted(set(common) | set(some))
    machine = flat
    for turn in range(TURNS):
        words = positives + negatives
        z = kernel(words, marks) @ whiten.astype(np.float32)
        label = np.array([1.0] * len(positives) + [-1.0] * len(negatives))
        share = np.sqrt(np.array([witness[p] for p in positives], float))
        cost = np.concatenate([share * len(negatives) / share.sum(), np.ones(len(negatives))])
        w = svm(z, label, cost)
        beta = whiten @ w[:-1]
        table = np.zeros(ALPHABET**3)
        for rows, c in by_length(marks):
            t, weight = triple_codes(c)
            for i, r in enumerate(rows):
                np.add.at(table, t[i], beta[r] * weight)
        machine = StringMachine(table, float(w[-1]), 1.0, 0.0)
        if turn < TURNS - 1:  # clean units that look most like insults become negatives
            m = machine.margins(clean)
            worst = np.argsort(-m)[:WORST_CLEAN]
            negatives = sorted(set(negatives) | {clean[i] for i in worst if m[i] > -0.9})
    scorer = Scorer(machine)
    score = np.concatenate([scorer(texts[i : i + 200]) for i in range(0, len(texts), 200)])
    del scorer
    order = np.unique(score)
    cuts = (order[1:] + order[:-1]) / 2 if len(order) > 1 else order
    high = np.sort(score[y == 1])
    low = np.sort(score[y == 0])
    missed = np.searchsorted(high, cuts) / n1
    false = 1 - np.searchsorted(low, cuts) / n0
    best = n1 * missed + 3 * n0 * false
    at_best = np.flatnonzero(np.isclose(best, best.min()))
    cut = cuts[at_best[len(at_best) // 2]]
    slope = 4.0 / max(float(np.median(high) - np.median(low)), 1e-6)
    return StringMachine(machine.table, machine.bias, slope, float(np.log(at / (1 - at)) - slope * cut), uuid.uuid4().hex)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.3, most: int = TRAIN_ROWS) -> StringMachine:
    sample = labelled_sample(docs, labels, label, most).collect()
    sample.sort(key=lambda r: (r.doc_id, r.y, r.text))
    texts, y = [r.text for r in sample], np.array([min(1, max(0, r.y)) for r in sample], int)
    del sample
    return fit(texts, y, threshold)


def scored(docs: DataFrame, machine: StringMachine, name: str = "toxic_score") -> DataFrame:
    """``docs`` (text among its columns) with the column ``name``, the score of every whole text, added."""
    machine.name = machine.name or uuid.uuid4().hex
    model = docs.sparkSession.sparkContext.broadcast(machine)
    names = [*docs.columns, name]
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        # What this worker has seen stays from task to task.
        score = kept(("toxicity", model.value.name), lambda: Scorer(model.value))
        for batch in batches:
            for part in slices(batch, pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist(), 1_000_000):
                p = model.value.probability(score([t or "" for t in part.column(at).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], names)
        trimmed()

    return shipped(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.3, most: int = TRAIN_ROWS) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    The machine is trained on at most ``most`` labelled rows, none of them held out (crc32 of
    doc_id as text, modulo 4, is 2); a score comes from the text alone.

    Null and empty texts score like a text without any insult. Null doc_ids are not held out;
    null, tied and repeated rows are kept; labels without a document or value are passed over;
    without labels of both kinds all scores are equal. Empty tables give empty results.
    """
    machine = train(docs, labels, label, threshold, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(rows, machine).withColumnRenamed("toxic_score", "score")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
