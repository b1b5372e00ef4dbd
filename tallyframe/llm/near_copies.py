"""Near copies by exact similarity of word shingles: SimHash and Golay anchors propose pairs, the texts decide.

op9's method, made wide enough for a similarity of 0.8: a fingerprint of ``WORDS`` times 64 bits, one for
over half of the hashes of a text's distinct shingles, is cut into ``BLOCKS`` blocks of 23 bits. It is at home
at each block's code word of the binary Golay code and visits the code words within one more bit. Texts that
meet at an anchor, one of them at home, are proposed if their first 128 bits are within ``REACH``. Fingerprints
of texts of similarity 0.8 differ in 15 % of the bits; at that rate a block joins 39.5 % of the pairs, 16
blocks miss 0.03 % and the reach 0.06 %. At most 31 differing bits in the 16 blocks always leave one where the texts meet.

Proposals are no rows: an anchor gives a spanning forest of them, and texts that a chain of proposals joins are a
crowd. All texts of a crowd are compared with each other, by their whole sets of shingles and inside the tasks, which
give spanning forests of the links. So a crowd's comparisons grow with its square, but no table of pairs is made.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import shipped, slices, staged, trimmed, with_small
from .simhash import PART, RADIUS, SENT_ROWS, anchors_within, components, survivors, text_key

WORDS, BLOCKS, WIDTH = 6, 16, 23
#: Differing bits, of the first 128, up to which two texts are proposed.
REACH = 33
#: Proposals of each text at one anchor, on the mean of those with any, that are given as they are; of more, a spanning forest is given.
MOST = 2
#: Texts at home at an anchor (and a quarter of its visits) that one task compares at once; larger anchors are split into a grid.
CELL = 10_000
#: Texts of a crowd that are compared with as many others at once, and the blocks up to which a crowd is split for that.
SHARE, GRID = 128, 24
#: Bytes of texts, in a block of a crowd, beyond which it is split further, and those that one task reads, about.
BYTES, TASK_BYTES = 8_000_000, 32_000_000
_SEEDS = np.random.default_rng(11).integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles of ``words`` words; of the whole sequence if there are fewer."""
    import xxhash

    tokens = text.lower().split()
    n = len(tokens)
    if n < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens))] if n else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, n)
    total = h[: n - words + 1].copy()
    for i in range(1, words):
        total = total * _MIX[0] + h[i : n - words + 1 + i]
    return np.unique(mixed(total))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets have a Jaccard similarity of ``percent`` or more; two empty ones have."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def fingerprint(hashes: np.ndarray) -> bytes:
    """A bit is 1 if it is set in over half of the ``hashes``, each mixed with ``WORDS`` seeds; no hashes: 0."""
    total = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(hashes), 16_384):
        h = mixed(hashes[i : i + 16_384, None] * _SEEDS[None, :])
        total += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * total > len(hashes), bitorder="little").tobytes()


def fingerprints(texts: DataFrame, words: int) -> DataFrame:
    """h, the hash of the set of shingles and its fingerprint for each row of ``texts`` (h, text)."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for part in slices(batch, batch.column(2).to_pylist(), 2_000_000):
                sets = [shingles(t.as_buffer().to_pybytes(), words) for t in part.column(1)]
                names = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array([fingerprint(s) for s in sets], pa.binary())], ["h", "name", "fp"])
        trimmed()

    return shipped(texts).select("h", "text", F.octet_length("text").alias("n")).mapInArrow(run, "h long, name long, fp binary")


def cover(fp: np.ndarray):
    """(anchor, row, home) for each block of the fingerprints, rows of bytes: at home within the radius, visits to one bit beyond."""
    bits = np.unpackbits(fp, axis=1, bitorder="little")
    for b in range(BLOCKS):
        value = bits[:, b * WIDTH : (b + 1) * WIDTH].astype(np.int64) @ (1 << np.arange(WIDTH))
        row, anchor = anchors_within(value, RADIUS + 1)
        yield b << 12 | anchor >> 11, row, np.bitwise_count(value[row] ^ anchor) <= RADIUS


class Forest:
    """Of the links between ``n`` nodes that it is shown, those that join what was apart until then."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.left, self.right = [], []

    def add(self, me: int, others: np.ndarray) -> None:
        far = others[self.label[others] != self.label[me]]
        if len(far):
            _, pick = np.unique(self.label[far], return_index=True)
            far = far[pick]
            self.left.append(np.full(len(far), me))
            self.right.append(far)
            joined = np.zeros(len(self.label), bool)
            joined[self.label[far]] = True
            self.label[joined[self.label]] = self.label[me]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *self.left]), np.concatenate([none, *self.right])


def proposals(homes: tuple, visits: tuple, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of texts at one anchor that are within reach, a > b; each is (h, first, second word).

    Of those with over ``most`` for each home a spanning forest is given, so the groups are the same; None gives all.
    """
    (h, *f), (v, *g) = homes, visits
    nodes = np.unique(np.concatenate([h, v]))
    at_home, at_visit = np.searchsorted(nodes, h), np.searchsorted(nodes, v)
    forest, left, right = Forest(len(nodes)), [], []
    step = max(1, 2_000_000 // max(1, len(v)))
    for i in range(0, len(h), step):
        at = slice(i, i + step)
        near = np.bitwise_count(f[0][at, None] ^ g[0][None, :]) + np.bitwise_count(f[1][at, None] ^ g[1][None, :]) <= REACH
        near &= at_home[at, None] != at_visit[None, :]
        some = np.flatnonzero(near.any(axis=1))
        if most is None or np.count_nonzero(near) <= most * len(some):
            r, c = np.nonzero(near)
            left.append(at_home[at][r])
            right.append(at_visit[c])
        else:
            for r in some:
                forest.add(at_home[i + r], at_visit[near[r]])
    a, b = (np.concatenate([*x, y]) for x, y in zip((left, right), forest.links(), strict=True))
    both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1) if len(a) else np.stack([a, b])
    return nodes[both[0]], nodes[both[1]]


def met(sets: DataFrame, most: int | None, cell: int = CELL) -> DataFrame:
    """The :func:`proposals` (a, b) of all anchors of ``sets`` (h, fp), some of them repeated."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, len(batch), 5_000):
                part = batch.slice(i, 5_000)
                fp = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(part), -1)
                h = part.column(0).to_numpy(zero_copy_only=False)
                words = fp.view(np.int64)[:, :2]
                for anchor, row, home in cover(fp):
                    got = [anchor.astype(np.int32), h[row], words[row, 0], words[row, 1], home]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["anchor", "h", "first", "second", "home"])
        trimmed()

    covered = shipped(sets).select("h", "fp").mapInArrow(run, "anchor int, h long, first long, second long, home boolean")
    sizes = staged(covered.groupBy("anchor").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("visits")), "near-anchors")
    one = F.lit(1).cast("long")
    wide, tall = F.greatest(one, F.ceil(F.col("homes") / cell)), F.greatest(one, F.ceil(F.col("visits") / (4 * cell)))
    grid = sizes.select("anchor", wide.alias("wide"), tall.alias("tall")).filter("wide > 1 or tall > 1")
    dealt = with_small(covered, grid, "anchor", grid.count(), how="left", most=100_000).withColumns({"wide": F.coalesce("wide", one), "tall": F.coalesce("tall", one)})
    row, col = F.pmod(F.xxhash64("h", F.lit(1)), F.col("tall")), F.pmod(F.xxhash64("h", F.lit(2)), F.col("wide"))
    # A visit goes to all columns of its row, a home to all rows of its column; both at once, so the anchors are found once.
    as_visit = F.transform(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1), lambda c: F.struct(c.alias("col"), row.alias("row"), F.lit(False).alias("at_home")))
    as_home = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tall") - 1), lambda r: F.struct(col.alias("col"), r.alias("row"), F.lit(True).alias("at_home")))
    places = F.when(F.col("home"), F.concat(as_visit, as_home)).otherwise(as_visit)
    rows = sizes.agg(F.sum("visits")).first()[0] or 0
    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART))
    cells = dealt.withColumn("to", F.explode(places)).select(F.xxhash64("anchor", "to.col", "to.row").alias("place"), "h", "first", "second", F.col("to.at_home").alias("home"))

    def compare(table):
        import pyarrow as pa

        place, home = (table.column(c).to_numpy() for c in ("place", "home"))
        # In the order of h, so that anchors with the same texts give the same forests.
        order = np.lexsort((table.column("h").to_numpy(), home, place))
        columns = [table.column(c).to_numpy()[order] for c in ("h", "first", "second")]
        columns[1:] = [c.view(np.uint64) for c in columns[1:]]
        place, home = place[order], home[order]
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        ends = np.append(starts[1:], len(place))
        middles = ends - np.add.reduceat(home.astype(np.int64), starts)
        found = []
        for i, m, e in zip(starts.tolist(), middles.tolist(), ends.tolist(), strict=True):
            if m < e and m - i > 1:
                found.append(proposals(tuple(c[m:e] for c in columns), tuple(c[i:m] for c in columns), most))
        a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.withColumn("part", F.pmod("place", F.lit(parts))).groupBy("part").applyInArrow(compare, "a long, b long")


def similar_links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links that span the groups of similar ``sets``: those of side 1 are compared with those of side 2, of side 0 with all of side 0."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    # An empty set is similar to no other one.
    left, right = np.flatnonzero((side != 2) & (size > 0)), np.flatnonzero((side != 1) & (size > 0))
    forest = Forest(len(sets))
    if len(left) and len(right):
        ends = np.cumsum(size)
        _, number = np.unique(np.concatenate(sets), return_inverse=True)
        own = [number[e - n : e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
        theirs, starts = np.concatenate([own[i] for i in right]), np.cumsum(size[right]) - size[right]
        mark = np.zeros(len(number), np.int32)
        for i in left.tolist():
            if (forest.label[right] != forest.label[i]).any():
                mark[own[i]] = 1
                both = np.add.reduceat(mark[theirs], starts)
                mark[own[i]] = 0
                forest.add(i, right[100 * both.astype(np.int64) >= percent * (size[i] + size[right] - both)])
    return forest.links()


def verified(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that span the groups of similar ``texts`` (h, text, crowd): all texts of a crowd are compared.

    A crowd is cut into at most ``GRID`` blocks (more where it holds over ``GRID`` times ``BYTES``), and each two
    blocks are compared at once. So a text is sent once for each block, not for each other text.
    """
    n = F.octet_length("text").cast("long")
    sizes = staged(texts.groupBy("crowd").agg(F.count("*").alias("rows"), F.sum(n).alias("bytes")), "near-crowds")
    blocks = F.greatest(F.least(F.ceil(F.col("rows") / SHARE), F.lit(GRID).cast("long")), F.ceil(F.col("bytes") / BYTES))
    sizes = sizes.withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.least("rows", blocks)))
    crowds, rows, total = sizes.agg(F.count("*"), F.sum(F.col("rows") * F.col("blocks")), F.sum(F.col("bytes") * F.col("blocks"))).first()
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // PART), -(-(total or 0) // TASK_BYTES))
    block = F.pmod(F.xxhash64("h", F.lit(3)), F.col("blocks"))
    dealt = with_small(texts, sizes.select("crowd", "blocks"), "crowd", crowds, most=SENT_ROWS).withColumn("block", block)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    cells = dealt.select(F.xxhash64("crowd", F.least("block", "other"), F.greatest("block", "other")).alias("place"), "h", side.alias("side"), "text")

    def compare(table):
        import pyarrow as pa

        place, side, h = (table.column(c).to_numpy() for c in ("place", "side", "h"))
        text = table.column("text")
        order = np.argsort(place, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(place[order]) != 0]))
        found = [(h[:0], h[:0])]
        for at in np.split(order, starts[1:]):
            if len(at) > 1:
                a, b = similar_links([shingles(text[i].as_buffer().to_pybytes(), words) for i in at.tolist()], side[at], percent)
                found.append((h[at][a], h[at][b]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return shipped(cells).withColumn("part", F.pmod("place", F.lit(parts))).groupBy("part").applyInArrow(compare, "a long, b long")


def roots(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """h and root of every distinct text of ``docs``: equal for texts that a chain of similar ones links."""
    every = docs.select(text_key().alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    placed = staged(fingerprints(every, words).dropDuplicates(["h"]), "near-fingerprints")
    # Texts of equal sets are similar for sure, so one of them stands for all.
    sets = staged(placed.groupBy("name").agg(F.min("h").alias("h"), F.first("fp").alias("fp")), "near-sets")
    joined = components(met(sets, MOST))
    crowds = staged(joined.toDF("h", "crowd").unionByName(joined.select(F.col("root").alias("h"), F.col("root").alias("crowd"))).distinct(), "near-names")
    texts = with_small(every, crowds, "h", crowds.count(), most=SENT_ROWS)
    texts = staged(texts.dropDuplicates(["h"]), "near-texts")
    root = staged(components(verified(texts, words, percent)), "near-roots")
    named = sets.select("name", F.col("h").alias("node")).join(root, "node", "left").select("name", F.coalesce("root", "node").alias("root"))
    return placed.select("h", "name").join(named, "name").select("h", "root")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each group of near copies stays, by :func:`simhash.survivors`.

    Texts are split and lower-cased as in op9. Two are linked if the sets of their ``words``-word shingles
    have a Jaccard similarity of ``percent`` or more; texts without words are linked with each other.
    """
    return survivors(docs, roots(docs, words, percent))
