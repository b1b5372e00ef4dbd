"""SimHash near-duplicates: anchor-point covering with the binary Golay code.

Two 64-bit fingerprints that differ in at most ``bits`` places differ in at most bits // 3 places
in one of three blocks (21, 21 and 22 bits). Each block, padded to 23 bits, is covered by the
4096 words of the perfect Golay code, whose covering radius is 3: every block value has exactly
one anchor within 3. A fingerprint is at home at that anchor and visits every anchor within
3 + bits // 3; two linked fingerprints therefore meet where one of them is at home.

Three times 4096 anchors make comparisons grow with the square of the fingerprints. Where that would
cost more than moving more rows, anchors are pairs of code words of two blocks, three times 4096
squared: the two blocks that differ least differ in at most 2 * bits // 3 places together, which is
how far beyond the radius a visit may reach in both blocks together. Both covers find every link.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import clear_name, shipped, slices, staged, trimmed, with_small

BLOCKS = ((0, 21), (21, 21), (42, 22))
RADIUS = 3
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the binary Golay code of length 23.
GENERATOR = 0b101011100011
#: Rows of one anchor that one task compares at once; larger anchors are split into a grid.
CELL = 20_000
#: Comparisons that cost as much as one more row that a cover moves, and the bits up to which pairs of blocks are used.
ROW_COST, PAIR_BITS = 500, 4
#: Rows that one task compares, anchor after anchor.
PART = 200_000
#: Names of rows (two numbers each) that are sent to all executors at once; more are joined by shuffle.
SENT_ROWS = 1_000_000


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    out = words.astype(np.int64)
    for i in range(22, 10, -1):
        out = np.where((out >> i) & 1, out ^ (GENERATOR << (i - 11)), out)
    return out


@lru_cache(maxsize=4)
def patterns(weight: int) -> tuple[np.ndarray, np.ndarray]:
    """All 23-bit patterns of at most ``weight`` bits in order of their syndromes, and where each syndrome starts."""
    masks = np.array([sum(1 << b for b in c) for w in range(weight + 1) for c in combinations(range(23), w)], np.int64)
    s = syndromes(masks)
    order = np.argsort(s, kind="stable")
    return masks[order], np.searchsorted(s[order], np.arange(2049))


def anchors_within(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every code word within ``radius`` of each 23-bit value."""
    masks, starts = patterns(radius)
    s = syndromes(values)
    n = starts[s + 1] - starts[s]
    row = np.repeat(np.arange(len(values)), n)
    at = np.repeat(starts[s], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, values[row] ^ masks[at]


def fingerprint_text(text: bytes, words: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the XXH64 hashes of the word shingles; no words: 0."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), seed)
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    begin, end = np.concatenate([[0], ends[:-1] + 1])[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist()
    digest, n = xxhash.xxh64_intdigest, len(begin)
    total = np.zeros(64, np.int64)
    for i in range(0, n, 100_000):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(begin[i : i + 100_000], end[i : i + 100_000], strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, batch.column(2).to_pylist(), 4_000_000):
                got = np.array([fingerprint_text(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in part.column(1)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])
        trimmed()

    text = F.coalesce(F.col("text"), F.lit(""))
    return shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).alias("n")).mapInArrow(run, "doc_id long, fp long")


def local_forest(home: np.ndarray, visitors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between ``home`` and ``visitors``, not all of the links."""
    nodes = np.unique(np.concatenate([home, visitors]))
    label = np.arange(len(nodes))
    at_home, at_visit = np.searchsorted(nodes, home), np.searchsorted(nodes, visitors)
    step = max(1, 2_000_000 // max(1, len(visitors)))
    left, right = [], []
    for i in range(0, len(home), step):
        near = np.bitwise_count(home[i : i + step, None] ^ visitors[None, :]) <= bits
        near &= at_home[i : i + step, None] != at_visit[None, :]
        for r in np.flatnonzero(near.any(axis=1)):
            me, others = at_home[i + r], at_visit[near[r]]
            far = others[label[others] != label[me]]
            if len(far):
                _, pick = np.unique(label[far], return_index=True)
                far = far[pick]
                left.append(np.full(len(far), nodes[me]))
                right.append(nodes[far])
                label[np.isin(label, label[far])] = label[me]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def ragged_cross(n_left: np.ndarray, n_right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, left and right number within the group of every pair of n_left[g] x n_right[g]."""
    n = n_left * n_right
    group = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    return group, i // n_right[group], i % n_right[group]


def cover_blocks(fp: np.ndarray, bits: int):
    """(anchor, row, home) for each block: at home within the radius, visits to bits // 3 beyond."""
    for b, (shift, width) in enumerate(BLOCKS):
        value = ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        row, anchor = anchors_within(value, RADIUS + bits // 3)
        # The systematic part names the word among 4096; three blocks follow one another.
        yield b << 12 | anchor >> 11, row, np.bitwise_count(value[row] ^ anchor) <= RADIUS


def cover_pairs(fp: np.ndarray, bits: int):
    """(anchor, row, home) for each pair of blocks: both excesses over the radius add up to at most 2 * bits // 3."""
    most = 2 * bits // 3
    near = []  # of each block, by excess: anchors in the order of their rows, their number and start for each row
    for shift, width in BLOCKS:
        value = ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        row, anchor = anchors_within(value, RADIUS + most)
        excess = np.maximum(np.bitwise_count(value[row] ^ anchor).astype(np.int64) - RADIUS, 0)
        by = []
        for e in range(most + 1):
            n = np.bincount(row[excess == e], minlength=len(fp))
            by.append((anchor[excess == e] >> 11, n, np.cumsum(n) - n))
        near.append(by)
    for p, (b, c) in enumerate(combinations(range(3), 2)):
        for e in range(most + 1):
            for f in range(most + 1 - e):
                (left, n_left, from_left), (right, n_right, from_right) = near[b][e], near[c][f]
                row, i, j = ragged_cross(n_left, n_right)
                anchor = p << 24 | left[from_left[row] + i] << 12 | right[from_right[row] + j]
                yield anchor, row, np.full(len(row), e + f == 0)


def anchor_links(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the linked groups of every anchor: few small ones side by side, others as forests."""
    order = np.lexsort((home, anchor))
    anchor, fp, home = anchor[order], fp[order], home[order]
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
    rows = np.diff(np.append(starts, len(anchor)))
    homes = np.add.reduceat(home.astype(np.int64), starts) if len(starts) else rows
    visits = rows - homes  # which stand before the homes
    left, right = [], []

    def forest(g: int) -> None:
        at, mid, end = starts[g], starts[g] + visits[g], starts[g] + rows[g]
        a, b = local_forest(fp[mid:end], fp[at:mid], bits)
        left.append(a)
        right.append(b)

    pairs = homes * visits
    for g in np.flatnonzero(pairs > 100_000):
        forest(g)
    small = np.flatnonzero((pairs > 0) & (pairs <= 100_000))
    cuts = np.searchsorted(np.cumsum(pairs[small]), np.arange(0, pairs[small].sum() + 1, 1_000_000)).tolist()
    for i, j in pairwise([*cuts, len(small)]):
        some = small[i:j]
        group, h, v = ragged_cross(homes[some], visits[some])
        a, b = fp[(starts + visits)[some][group] + h], fp[starts[some][group] + v]
        near = (np.bitwise_count(a ^ b) <= bits) & (a != b)
        dense = np.bincount(group[near], minlength=len(some)) > rows[some]
        keep = near & ~dense[group]
        left.append(a[keep])
        right.append(b[keep])
        for g in some[dense]:
            forest(g)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def links(distinct: DataFrame, bits: int = 4, cell: int = CELL, pairs: bool | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that span every group of linked ones.

    Every two fingerprints with at most ``bits`` differing bits are compared; each group of rows
    that is compared at once gives a spanning forest of its links, or its links if they are no more
    than its rows, so no group gives all its pairs. ``pairs`` takes anchors of pairs of blocks; by
    default the cover whose rows and comparisons cost less is taken (of random fingerprints one meets
    5.3 anchors in a block, 61 in a pair of blocks). Both give the same groups.
    """
    if bits > 11 or (pairs and bits > PAIR_BITS):
        raise ValueError("at most 11 bits, 4 with pairs of blocks")
    if pairs is None:
        n = distinct.count()
        pairs = bits <= PAIR_BITS and 3 * 5.3 * (ROW_COST + n / 4096) > 3 * 61 * (ROW_COST + n / 4096**2)
    covering, at_once = (cover_pairs, 5_000) if pairs else (cover_blocks, 50_000)

    def cover(batches):
        import pyarrow as pa

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), at_once):
                part = fp[i : i + at_once]
                for anchor, row, home in covering(part, bits):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(part[row].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    covered = staged(shipped(distinct).mapInArrow(cover, "anchor int, fp long, home boolean"), "simhash-anchors")
    sizes = covered.groupBy("anchor").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("visits"))
    wide = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("homes") / cell))
    tall = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("visits") / (4 * cell)))
    grid = staged(sizes.select("anchor", wide.alias("wide"), tall.alias("tall")).filter("wide > 1 or tall > 1"), "simhash-grid")
    one = F.lit(1).cast("long")
    dealt = with_small(covered, grid, "anchor", grid.count(), how="left", most=100_000).withColumns({"wide": F.coalesce("wide", one), "tall": F.coalesce("tall", one)})
    own_row = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tall"))
    own_col = F.pmod(F.xxhash64("fp", F.lit(2)), F.col("wide"))
    visits = dealt.select("anchor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1)).alias("col"), own_row.alias("row"), "fp", F.lit(False).alias("home"))
    homes = dealt.filter("home").select("anchor", own_col.alias("col"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tall") - 1)).alias("row"), "fp", F.lit(True).alias("home"))
    # Cells of the grids are many and mostly small, so a task compares a hashed part of them, cell by cell.
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-covered.count() // PART))
    cells = homes.unionByName(visits).select(F.xxhash64("anchor", "col", "row").alias("place"), "fp", "home")

    def compare(table):
        import pyarrow as pa

        place, fp = table.column("place").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        a, b = anchor_links(place, fp, table.column("home").to_numpy(zero_copy_only=False), bits)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return cells.withColumn("part", F.pmod("place", F.lit(parts))).groupBy("part").applyInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node of ``edges`` (a, b).

    Alternates large-star and small-star steps until the edges stay the same; each round is
    written to the shared folder.
    """
    current = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "star")
    mark = None
    while True:
        seen = current.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen[0] == 0 or seen == mark:
            return current.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = seen
        both = current.union(current.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        large = staged(large, "star")
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        small = small.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m"), F.col("u"))).filter("a <> b").distinct()
        current = staged(small, "star")


def linked(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fp, root (the smallest fingerprint reachable) and component_id of every row."""
    marked = staged(fingerprints(docs, words), "simhash-fp")
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), bits)).withColumnRenamed("node", "fp")
    named = staged(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Texts are lower-cased A-Z and split at ``[\\x20\\x09-\\x0D]``; the shingles are ``words`` words
    joined by a space, the whole sequence if there are fewer. Texts without words, null ones among
    them, have the fingerprint zero and link like any other. Fingerprints link at ``bits`` or fewer
    differing bits; component_id is the smallest doc_id reachable, null if no document of the
    component has one. Null, tied and repeated doc_ids keep their rows; an empty table gives an
    empty result; only doc_id and text are read.
    """
    return linked(docs, words, bits).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_key(column: str = "text"):
    """The hash that names a text; a null text is an empty one."""
    return F.xxhash64(F.coalesce(column, F.lit("")))


def survivors(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """One row of ``docs`` for each root of ``roots`` (h, root), which names every text by its hash.

    It is the row of the smallest (doc_id, text hash), rows with a doc_id first; of rows equal in both,
    that of the smallest hash of all columns. All columns are returned.
    """
    h = clear_name(docs.columns, "text_hash")
    gone_id, gone_h = (clear_name([*docs.columns, h], n) for n in ("gone_id", "gone_hash"))
    hashed = docs.withColumn(h, text_key())
    per = staged(hashed.groupBy(F.col(h).alias("h"), F.col("doc_id").alias("id")).agg(F.count("*").alias("rows")), "survivor-rows")
    first = per.groupBy("h").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "h", "rows")).alias("first"))
    kept = first.join(roots, "h").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.h").alias("kept_h"), F.col("first.id").alias("kept_id"), F.col("first.rows").alias("kept_rows"))
    kept = staged(kept, "survivors")
    stays = (F.col("h") == F.col("kept_h")) & F.col("id").eqNullSafe(F.col("kept_id"))
    gone = per.join(kept.filter("kept_rows = 1"), stays, "left_anti").select(F.col("h").alias(gone_h), F.col("id").alias(gone_id))
    gone = staged(gone, "survivor-losers")

    def among(rows: DataFrame, named: DataFrame, how: str) -> DataFrame:
        # The names of rows are few beside the texts, which are not moved as long as the counted names can be sent out.
        match = (F.col(h) == F.col(gone_h)) & F.col("doc_id").eqNullSafe(F.col(gone_id))
        return rows.join(F.broadcast(named) if named.count() <= SENT_ROWS else named, match, how)

    out = among(hashed, gone, "left_anti").select(docs.columns)
    repeated = kept.filter("kept_rows > 1").select(F.col("kept_h").alias(gone_h), F.col("kept_id").alias(gone_id))
    if repeated.limit(1).count() == 0:
        return out
    twice = among(hashed, repeated, "left_semi")
    picked = twice.groupBy(h, "doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return out.unionByName(picked.select("row.*"))


def keep_one(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component stays, by :func:`survivors`.

    Components are those of texts, not of doc_ids, so a doc_id that stands on several texts stands for none of them.
    """
    named = linked(docs.select(text_key().alias("doc_id"), "text"), words, bits)
    return survivors(docs, named.select(F.col("doc_id").alias("h"), F.col("component_id").alias("root")).distinct())
