"""Minimax contiguous sharding of ordered atomic groups, with DataFrame operations only."""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import staged, with_small

CHUNK_BITS = 16
FETCH_ROWS = 200_000
#: Spans of keys that are sent to all executors; more are joined by shuffle.
SENT_SPANS = 100_000


class Ladder:
    """Ordered runs of groups: (first key, last key, bytes, groups). Runs of one group are atomic."""

    def __init__(self, runs: list[tuple[int, int, int, int]]):
        self.runs = sorted(runs)
        self.prefix = [0, *accumulate(r[2] for r in self.runs)]
        self.total = self.prefix[-1]

    def low(self, capacity: int, shards: int) -> list[int]:
        """Cut positions if runs are never cut inside: none is beyond the true greedy cut."""
        at, cuts = 0, []
        for _ in range(shards):
            at = self.prefix[bisect_right(self.prefix, at + capacity) - 1]
            cuts.append(at)
        return cuts

    def high(self, capacity: int, shards: int) -> list[int]:
        """Cut positions if runs of several groups can be cut anywhere: none is before the true greedy cut."""
        at, cuts = 0, []
        for _ in range(shards):
            at = min(at + capacity, self.total)
            i = bisect_right(self.prefix, at) - 1
            if i < len(self.runs) and self.runs[i][3] == 1:
                at = self.prefix[i]
            cuts.append(at)
        return cuts

    def bracket(self, shards: int) -> tuple[int, int]:
        """The largest capacity known to be too small and the smallest known to suffice."""

        def search(lo: int, hi: int, suffices) -> int:
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if suffices(mid) else (mid, hi)
            return hi

        least = -(-self.total // shards) - 1
        hi = search(least, self.total, lambda c: self.low(c, shards)[-1] == self.total) if self.total else 0
        lo = search(least, self.total, lambda c: self.high(c, shards)[-1] == self.total) - 1 if self.total else -1
        return lo, hi

    def unsure(self, lo: int, hi: int, shards: int) -> list[int]:
        """Runs of several groups in which a cut for a capacity in (lo, hi] may fall."""
        out: set[int] = set()
        for a, b in zip(self.low(lo + 1, shards), self.high(hi, shards), strict=True):
            i, j = bisect_right(self.prefix, a) - 1, bisect_right(self.prefix, b) - 1
            out.update(k for k in range(max(i, 0), min(j, len(self.runs) - 1) + 1) if self.runs[k][3] > 1)
        return sorted(out)


def within(groups: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
    """The ``groups`` whose key lies in one of the disjoint ``spans`` (first key, last key).

    The spans are a table made from one literal, cut at chunk borders, and joined by chunk: the plan is
    the same for any number of them.
    """
    shift, parts = 64 - CHUNK_BITS, []
    for a, b in spans:
        for chunk in range(a >> shift, (b >> shift) + 1):
            parts.append({"chunk": chunk, "a": max(a, chunk << shift), "b": min(b, (chunk + 1 << shift) - 1)})
    made = F.from_json(F.lit(json.dumps(parts)), "array<struct<chunk: bigint, a: bigint, b: bigint>>")
    wanted = groups.sparkSession.range(1).select(F.inline(made))
    keyed = groups.withColumn("chunk", F.shiftright("key", shift))
    match = (keyed["chunk"] == wanted["chunk"]) & keyed["key"].between(wanted["a"], wanted["b"])
    return keyed.join(F.broadcast(wanted) if len(parts) <= SENT_SPANS else wanted, match, "left_semi").drop("chunk")


def smallest_capacity(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible shard capacity over groups (key, bytes) in key order, and the first
    key of every shard after the first.

    The driver holds runs of groups, at most 2^16 and those that cuts may fall in; it splits only
    the latter, so it never holds all groups unless they are few.
    """

    def fetch(df: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
        shift = 64 - bits
        rows = df.groupBy(F.shiftright("key", shift).alias("c")).agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum("bytes").alias("s"), F.count("*").alias("n"))
        return [(r.a, r.b, r.s, r.n) for r in rows.collect()]

    ladder, bits = Ladder(fetch(groups, CHUNK_BITS)), CHUNK_BITS
    while True:
        lo, hi = ladder.bracket(shards)
        if hi - lo <= 1:
            break
        split = set(ladder.unsure(lo, hi, shards))
        bits = 64 if sum(ladder.runs[k][3] for k in split) <= FETCH_ROWS else min(64, bits + 8)
        parts = fetch(within(groups, [ladder.runs[k][:2] for k in sorted(split)]), bits)
        ladder = Ladder([r for k, r in enumerate(ladder.runs) if k not in split] + parts)
    cuts, firsts = ladder.low(hi, shards), []
    for at in cuts[:-1]:
        i = bisect_right(ladder.prefix, at) - 1
        if i < len(ladder.runs):
            firsts.append(ladder.runs[i][0])
    return hi, firsts


def place(key: Column, firsts: list[int], base: int = 0) -> Column:
    """``base`` and the number of the ascending ``firsts`` that are at most ``key``, by halving."""
    if not firsts:
        return F.lit(base)
    mid = len(firsts) // 2
    return F.when(key < firsts[mid], place(key, firsts[:mid], base)).otherwise(place(key, firsts[mid + 1 :], base + mid + 1))


def shard_rows(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text) into one of ``shards`` shards of near-equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text plus ``overhead``), text_crc32, law, shard, slot,
    grown_shard. Equal texts form an atomic group; groups stand in the order of a 64-bit hash of
    the text and are cut into contiguous runs under the smallest feasible capacity. A group above
    the mean load of the shards that remain gets a shard of its own first, so that the others
    stay near equal.

    Null texts have no bytes and count as equal to the empty text (crc32 0). Null doc_ids are
    kept. Repeated rows each get a slot. An empty table gives an empty result. Only doc_id and
    text are read, so extra columns of any name do no harm.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("key")), "shard-rows")
    groups = staged(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")

    total, alone, left = groups.agg(F.sum("bytes")).first()[0] or 0, [], shards
    for g in groups.orderBy(F.desc("bytes"), "key").limit(shards).collect():
        if left <= 1 or g.bytes * left <= total:
            break
        alone.append(g.key)
        total, left = total - g.bytes, left - 1
    rest = groups.filter(~F.col("key").isin(alone)) if alone else groups
    _, firsts = smallest_capacity(rest, left) if total else (0, [])

    shard = place(F.col("key"), firsts, len(alone))
    for i, k in enumerate(alone):
        shard = F.when(F.col("key") == k, i).otherwise(shard)

    count = rows.count()
    buckets = max(32, min(65_536, count // (shards * 20_000)))
    runs = (
        rows.withColumn("shard", shard.cast("int"))
        .groupBy("shard", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)).alias("bucket"), "doc_id", "key", "size", "text_crc32")
        .agg(F.count("*").alias("copies"))
    )
    runs = staged(runs, "shard-runs")
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offset = runs.groupBy("shard", "bucket").agg(F.sum("copies").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("shard", "bucket").orderBy("doc_id", "key", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = with_small(runs.withColumn("first", F.coalesce(F.sum("copies").over(within), F.lit(0))), offset, ["shard", "bucket"], shards * buckets)
    return placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("i")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("first") + F.col("i")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
