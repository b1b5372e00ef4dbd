"""Mixing sources to target weights, with DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import staged, uniform, with_small

SLOTS_PER_TASK = 250_000
#: Longest array that counts are grown through.
RUN = 4_096
WORD_START = r"[\x20\x09-\x0D][^\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0. Every word start is shortened by one character."""
    led = F.concat(F.lit(" "), F.coalesce(text, F.lit("")))
    return (F.length(led) - F.length(F.regexp_replace(led, WORD_START, "x"))).cast("long")


def permuted(x: Column, n: Column, *key: Column | str, rounds: int = 24) -> Column:
    """Image of ``x`` under a pseudorandom permutation of 0..n-1 (the swap-or-not shuffle)."""

    def swap(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r), n) - at, n)
        return F.when(F.xxhash64(*key, r, F.greatest(at, partner), F.lit(1)) % 2 == 0, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, swap)


def counted_out(counts: DataFrame, n: str, total: int, *key: str) -> DataFrame:
    """Each row of ``counts`` ``n`` times, numbered from 0 by ``i``.

    The few rows grow into runs of at most RUN numbers, which are dealt out to the tasks before
    they grow further, so no array and no task holds a row's whole count.
    """
    tasks = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SLOTS_PER_TASK))
    runs = counts.select("*", F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(RUN).cast("long")))).alias("run")).repartition(tasks, *key, "run")
    return runs.select("*", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN, F.col(n)) - 1)).alias("i")).drop("run")


def drawn_counts(todo: DataFrame, odds: DataFrame, total: int, *key: Column, cells: int | None = None) -> DataFrame:
    """Source counts (shard, rank, n) of every shard of ``todo`` (shard, first, n) by ``odds`` (rank, n).

    The counts are multinomial draws under the condition that over all shards each source comes up
    exactly its n times: the ``total`` slots of all shards, numbered from ``first``, are laid on a line
    by a pseudorandom permutation, on which each source owns a span of length n. The line is cut into
    equal cells, so slots spread evenly whatever the odds; in each cell a slot takes the last mark
    at or below it, marks being the starts of spans and, at a cell's edge, the span across it.
    """
    cells = cells or max(4 * int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // 1_000_000))
    width = F.lit(max(1, -(-total // cells))).cast("long")
    spans = odds.filter("n > 0").withColumn("hi", F.sum("n").over(W.orderBy("rank"))).select("rank", (F.col("hi") - F.col("n")).alias("lo"), "hi")
    edges = spans.select("rank", (F.floor(F.col("lo") / width) + 1).alias("first"), F.floor((F.col("hi") - 1) / width).alias("last")).filter("first <= last")
    edges = edges.select("rank", F.explode(F.sequence("first", "last")).alias("cell"))
    marks = spans.select("rank", F.floor(F.col("lo") / width).alias("cell"), F.col("lo").alias("at")).unionByName(edges.select("rank", "cell", (F.col("cell") * width).alias("at")))
    draws = counted_out(todo, "n", total, "shard").select("shard", permuted(F.col("first") + F.col("i"), F.lit(total), *key, F.lit(4)).alias("at"))
    both = marks.withColumn("shard", F.lit(None).cast("long")).unionByName(draws.withColumn("cell", F.floor(F.col("at") / width)), allowMissingColumns=True)
    below = W.partitionBy("cell").orderBy("at", F.col("shard").asc_nulls_first(), "rank").rowsBetween(W.unboundedPreceding, 0)
    named = both.withColumn("rank", F.last("rank", ignorenulls=True).over(below)).filter("shard is not null")
    return named.groupBy("shard", "rank").agg(F.count("*").alias("n"))


@dataclass
class Mix:
    """``sources``: rank, source, source_size, weight, target. ``slots``: shard, slot, rank, pass, block.
    ``spans``: rank, start, doc_id, size, block, words (of the document in the block). ``taken``: doc_id, size, rank, taken."""

    sources: DataFrame
    slots: DataFrame
    spans: DataFrame
    taken: DataFrame
    source_count: int


def source_targets(sized: DataFrame, weights=(5, 2, 1), cap: int = 3) -> DataFrame:
    """Share the total size by weight; no target is above ``cap`` times its source's size.

    Sources stand by code point, null last, and the weights repeat. A source at its cap leaves the
    rest to the others by weight. Capped sources are those of the smallest size per weight, so one
    pass in that order finds them: source i is capped if its cap is at most its share of what the
    sources before it leave. Products are of whole numbers, so nothing is rounded before the quotient.
    """
    common = lcm(*weights)
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("long"))
    ordered = W.orderBy(F.col("source_size") * (F.lit(common) / F.col("weight")).cast("long"), "rank")
    before, all_rows = ordered.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    total = F.sum("source_size").over(all_rows)
    left = total - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    fits = ranked.withColumn("capped", (cap * F.col("source_size") * weight_left <= F.col("weight") * left).cast("int"))
    fits = fits.withColumn("capped", F.min("capped").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    rest = F.sum("source_size").over(all_rows) - F.sum(F.when(F.col("capped") == 1, cap * F.col("source_size")).otherwise(0)).over(all_rows)
    rest_weight = F.sum(F.when(F.col("capped") == 1, 0).otherwise(F.col("weight"))).over(all_rows)
    share = (F.col("weight") * rest).cast("double") / rest_weight.cast("double")
    return fits.select("rank", "source", "source_size", "weight", F.when(F.col("capped") == 1, (cap * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights=(5, 2, 1), cap: int = 3, block_words: int = 64, shard_slots: int = 4096, most_shards: int = 10_000, seed: int = 17) -> Mix:
    """Mix the words of ``docs`` (doc_id, source, text) so that each source supplies its target.

    The words of a source, document after document, are packed into blocks of ``block_words``
    (the last may be shorter). Every output shard draws how many of its slots each source fills:
    multinomial counts under the condition that over all shards each source fills the slots that
    its target asks for, at most ``cap`` passes over its blocks, so no document is taken more than
    ``cap`` times and nothing is drawn that must be dropped. A source's j-th slot in the mix takes
    block j mod n of its n blocks, mapped through a permutation that depends on the source and on
    the pass j div n; blocks join the slots by index.

    Null texts, empty texts and texts of white space have size 0 and are never taken. A null
    source is a source of its own. Null and repeated doc_ids and repeated rows are kept row by
    row. An empty table gives empty results. Only doc_id, source and text are read.
    """
    sized = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sized")
    sources = staged(source_targets(sized, weights, cap), "mix-sources")
    n_sources = sources.count()
    n_docs = sized.count()
    keyed = sources.select(F.col("rank").alias("rank"), F.coalesce("source", F.lit("")).alias("k"), F.col("source").isNull().alias("k_null"))
    ranked = with_small(sized.select("doc_id", "size", F.coalesce("source", F.lit("")).alias("k"), F.col("source").isNull().alias("k_null")), keyed, ["k", "k_null"], n_sources).drop("k", "k_null")

    # Where the words of each document start in its source: sums of buckets, then sums within a bucket.
    buckets = max(64, min(65_536, n_docs // 5_000))
    runs = ranked.filter("size > 0").groupBy("rank", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).alias("bucket"), "doc_id", "size").agg(F.count("*").alias("copies"))
    runs = staged(runs, "mix-runs")
    before = W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offset = runs.groupBy("rank", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).select("rank", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("rank", "bucket").orderBy("doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    starts = runs.withColumn("first", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(within), F.lit(0))).join(offset, ["rank", "bucket"])
    starts = starts.select("rank", "doc_id", "size", F.col("offset") + F.col("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("i")).toDF("rank", "doc_id", "size", "start", "i")
    starts = starts.select("rank", "doc_id", "size", (F.col("start") + F.col("i") * F.col("size")).alias("start"))
    block = lambda x: F.floor(x / F.lit(block_words))
    spans = starts.select("*", F.explode(F.sequence(block(F.col("start")), block(F.col("start") + F.col("size") - 1))).alias("block"))
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    spans = spans.withColumn("words", end - F.greatest(F.col("start"), F.col("block") * block_words))

    # Slots that the targets ask for, in whole numbers that add up, and those that each shard draws from each source.
    odds = sources.filter("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block_words)))
    odds = odds.withColumn("upto", F.round(F.sum(F.col("target") * F.col("blocks") / F.col("source_size")).over(W.orderBy("rank"))).cast("long"))
    wanted = F.col("upto") - F.coalesce(F.lag("upto").over(W.orderBy("rank")), F.lit(0))
    odds = staged(odds.select("rank", "blocks", F.least(wanted, cap * F.col("blocks")).alias("n")), "mix-odds")
    n_slots = odds.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-n_slots // max(shard_slots, 64 * n_sources, -(-n_slots // most_shards))))
    first = lambda s: F.floor(s * F.lit(n_slots) / F.lit(shards))
    todo = docs.sparkSession.range(shards).select(F.col("id").alias("shard"), first(F.col("id")).alias("first"), (first(F.col("id") + 1) - first(F.col("id"))).alias("n"))
    counts = staged(drawn_counts(todo, odds, n_slots, F.lit(seed)), "mix-drawn")
    counts = with_small(counts, odds.select("rank", "blocks"), "rank", n_sources)
    counts = counts.withColumn("from_j", F.coalesce(F.sum("n").over(W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.withColumn("from_slot", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.withColumn("slots", F.sum("n").over(W.partitionBy("shard")))
    slots = counted_out(counts, "n", n_slots, "shard", "rank").withColumn("j", F.col("from_j") + F.col("i"))
    turn = F.floor(F.col("j") / F.col("blocks"))
    slots = slots.select(
        "shard",
        permuted(F.col("from_slot") + F.col("i"), F.col("slots"), F.lit(seed), F.lit(2), "shard").alias("slot"),
        "rank",
        turn.alias("pass"),
        permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.lit(3), "rank", turn).alias("block"),
    )
    uses = slots.groupBy("rank", "block").agg(F.count("*").alias("uses"))
    taken = spans.join(uses.hint("merge"), ["rank", "block"], "left").groupBy("rank", "start").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).alias("taken"))
    none = ranked.filter("size = 0").select("rank", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return Mix(sources, slots, spans, taken.select("rank", "doc_id", "size", "taken").unionByName(none), n_sources)


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's) and taken (words in the mix, repeats counted)."""
    m = mix(docs, **options)
    per = m.sources.select("rank", "source_size", "target")
    return with_small(m.taken, per, "rank", m.source_count).select("doc_id", "size", "source_size", "target", "taken")
