"""Benchmark decontamination by a distributed positional inverted index.

The index holds the postings of every token of the training texts and knows nothing of any benchmark:
one index answers all of them. It is a table of segments, each over the documents of some part of a
partition. A segment's documents stand one after another with a free position between them, so no
phrase crosses two documents, and its row holds

``docs``: the documents' ids, ``n_words``: their numbers of words (uint32);
``terms``: the distinct words as two 64-bit hashes each, ascending; ``ends``: where each term's
postings end (uint32); ``places``: the positions of each term's tokens, ascending (uint32).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import lower_ascii, shipped, slices, span_hashes, staged, text_bytes, trimmed, word_spans

#: Words are runs of these bytes: digits, letters A-Z and a-z, and every byte of a character beyond ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Benchmark items, and bytes of their texts, that are asked for at once; a larger benchmark is asked for in parts.
PART_ITEMS, PART_BYTES = 50_000, 2_000_000
SEGMENT_WORDS = 1_000_000
#: Candidate places that are followed at once.
FOLLOWED = 500_000
INDEX_SCHEMA = "segment long, docs array<long>, n_words binary, terms binary, ends binary, places binary"
FOUND_SCHEMA = "segment long, nth int, doc_id long, n_words long, runs array<long>, items array<string>"
PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])
_AWAY = np.iinfo(np.int64).max


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every word of the texts, in order: its 128-bit identity as two hashes; and its row."""
    low = lower_ascii(data)
    begin, end, row = word_spans(low, off, INSIDE)
    pair = np.empty(len(begin), PAIR)
    pair["a"], pair["b"] = span_hashes(low, begin, end, 0), span_hashes(low, begin, end, 1)
    return pair, row


class Phrases:
    """Part of a benchmark as term numbers: vocabulary in hash order, distinct windows (-1 ends shorter ones), and their items."""

    def __init__(self, item_ids: list, texts: list, window: int):
        data = [("" if t is None else t).encode() for t in texts]
        off = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        pair, row = words_of(np.frombuffer(b"".join(data), np.uint8), off)
        self.item_ids = [None if x is None else str(x) for x in item_ids]
        self.vocabulary, number = np.unique(pair, return_inverse=True)
        size = np.bincount(row, minlength=len(data))
        n = np.where(size > 0, np.maximum(size - window + 1, 1), 0)
        item = np.repeat(np.arange(len(data)), n)
        first = np.repeat(np.cumsum(size) - size, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = first[:, None] + np.arange(window)
        inside = np.arange(window) < np.minimum(size[item], window)[:, None]
        words = np.where(inside, np.append(number, -1)[np.minimum(at, len(number))], -1).astype(np.int32)
        self.windows, which = np.unique(words, axis=0, return_inverse=True)
        which = which.reshape(-1)
        by = np.argsort(which, kind="stable")
        self.item, self.item_ends = item[by], np.cumsum(np.bincount(which, minlength=len(self.windows)))

    @property
    def lengths(self) -> np.ndarray:
        return (self.windows >= 0).sum(axis=1)

    def items_of(self, window: int) -> np.ndarray:
        return self.item[self.item_ends[window - 1] if window else 0 : self.item_ends[window]]


class Postings:
    """One segment's postings of the terms of ``asked``."""

    def __init__(self, n_words: np.ndarray, terms: np.ndarray, ends: np.ndarray, places: np.ndarray, asked: Phrases):
        self.base = np.append(0, np.cumsum(n_words.astype(np.int64) + 1))
        known = np.append(terms, np.zeros(2, PAIR))
        at = np.searchsorted(terms["a"], asked.vocabulary["a"])
        at += (known[at] != asked.vocabulary) & (known[at + 1] == asked.vocabulary)
        there = (at < len(terms)) & (known[at] == asked.vocabulary)
        begin, end = np.append(np.append(0, ends), 0)[at].astype(np.int64), np.append(ends, 0)[np.minimum(at, len(ends))].astype(np.int64)
        self.count = np.where(there, end - begin, 0)
        self.first = np.cumsum(self.count) - self.count
        # The tokens of all terms asked for, as term number and position in one number, ascending.
        pick = np.repeat(begin - self.first, self.count) + np.arange(int(self.count.sum()))
        self.tokens = np.repeat(np.arange(len(self.count)) << 32, self.count) | places[pick].astype(np.int64)

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, place, side="right") - 1

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(term), bool)
        want = term << 32 | place
        return self.tokens[np.minimum(np.searchsorted(self.tokens, want), len(self.tokens) - 1)] == want

    def rarest(self, windows: np.ndarray):
        """Batches (window, place, order): each window whose terms all occur, with the places of its rarest
        term; ``order`` has the columns of all windows from the rarest term on, the columns without one last."""
        count = np.where(windows < 0, _AWAY, self.count[windows]) if len(windows) else np.zeros((0, 1), np.int64)
        order = np.argsort(count, axis=1, kind="stable")
        least = count.min(axis=1, initial=_AWAY)
        live = np.flatnonzero((least > 0) & (least < _AWAY))
        upto = np.cumsum(least[live])
        done = 0
        while done < len(live):
            stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + FOLLOWED, side="right")))
            own = live[done:stop]
            n = least[own]
            window = np.repeat(own, n)
            at = np.repeat(self.first[windows[own, order[own, 0]]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            yield window, self.tokens[at] & 0xFFFFFFFF, order
            done = stop

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and start of every exact occurrence: offset-adjusted lists are intersected from the rarest term on."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for window, place, order in self.rarest(windows):
            start = place - order[window, 0]
            for j in range(1, windows.shape[1]):
                k = order[window, j]
                term = windows[window, k].astype(np.int64)
                keep = (start >= 0) & ((term < 0) | self.has(term, start + k))
                window, start = window[keep], start[keep]
            keep = start >= 0
            found.append((window[keep], start[keep]))
        return np.concatenate([w for w, _ in found]), np.concatenate([s for _, s in found])

    def near(self, windows: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """Window and start of stretches of words, ``slack`` longer than the window, that hold all its terms in any order."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        span = (windows >= 0).sum(axis=1) + slack
        for window, place, order in self.rarest(windows):
            # First tokens of the rarest term with all other terms around; then the stretches around each.
            low, high = place - span[window] + 1, place + span[window]
            for fine in (False, True):
                if fine:
                    n = span[window]
                    low = np.repeat(place - n + 1, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    window, place = np.repeat(window, n), np.repeat(place, n)
                    high = low + span[window]
                doc = self.doc(place)
                low, high = np.maximum(low, self.base[doc]), np.minimum(high, self.base[doc + 1])
                for j in range(1, windows.shape[1]):
                    term = windows[window, order[window, j]].astype(np.int64)
                    keep = (term < 0) | (np.searchsorted(self.tokens, term << 32 | high) > np.searchsorted(self.tokens, term << 32 | low))
                    window, place, low, high = window[keep], place[keep], low[keep], high[keep]
            found.append((window, low))
        return np.concatenate([w for w, _ in found]), np.concatenate([p for _, p in found])


def benchmark_parts(benchmark: DataFrame):
    """The benchmark in parts of bounded size, one after another; the driver holds one."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        n = len((r.text or "").encode())
        if ids and (len(ids) >= PART_ITEMS or size + n > PART_BYTES):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += n
    yield ids, texts


def build_index(docs: DataFrame, slice_bytes: int = 1_000_000) -> DataFrame:
    """Store the postings of all tokens of ``docs`` (doc_id, text) as a table of segments and read it back."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        ids, sizes, words, held = [], [], [], 0

        def flushed():
            pair, n_words = np.concatenate(words), np.concatenate(sizes)
            place = np.arange(len(pair), dtype=np.int64) + np.repeat(np.arange(len(n_words)), n_words)
            order = np.argsort(pair["a"], kind="stable")
            pair = pair[order]
            same = pair["a"][1:] == pair["a"][:-1]
            if (same & (pair["b"][1:] != pair["b"][:-1])).any():  # two words share a hash
                again = np.lexsort((order, pair["b"], pair["a"]))
                order, pair = order[again], pair[again]
            last = np.append(pair[1:] != pair[:-1], True) if len(pair) else np.zeros(0, bool)
            columns = [n_words.astype("<u4"), pair[last], np.flatnonzero(last).astype("<u4") + np.uint32(1), place[order].astype("<u4")]
            docs = pa.concat_arrays(ids)
            docs = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
            return pa.RecordBatch.from_arrays([pa.array([segment]), docs, *(pa.array([c.tobytes()], pa.binary()) for c in columns)], ["segment", "docs", "n_words", "terms", "ends", "places"])

        for batch in batches:
            for part in slices(batch, batch.column(2).to_pylist(), slice_bytes):
                pair, row = words_of(*text_bytes(part.column(1)))
                ids.append(part.column(0))
                sizes.append(np.bincount(row, minlength=len(part)))
                words.append(pair)
                held += len(pair) + len(part)
                if held >= SEGMENT_WORDS:
                    yield flushed()
                    ids, sizes, words, held, segment = [], [], [], 0, segment + 1
        if held:
            yield flushed()
        trimmed()

    text = F.coalesce(F.col("text"), F.lit(""))
    read = shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).alias("n"))
    return staged(read.mapInArrow(run, INDEX_SCHEMA), "decontam-index")


def segments_of(batches, asked: Phrases):
    """segment, document ids (Arrow), numbers of words and :class:`Postings` of each row of the index."""
    for batch in batches:
        for i in range(len(batch)):
            n_words, terms, ends, places = (np.frombuffer(batch.column(2 + j)[i].as_buffer(), kind) for j, kind in enumerate(("<u4", PAIR, "<u4", "<u4")))
            yield batch.column(0)[i].as_py(), batch.column(1)[i].values, n_words, Postings(n_words, terms, ends, places, asked)
    trimmed()


def matches(index: DataFrame, phrases, window: int, all_docs: bool = True) -> DataFrame:
    """Per document of the index: its place, doc_id, n_words, runs (start, end of covered words, in pairs) and items
    that occur. ``phrases`` is a broadcast; without ``all_docs`` only documents with an occurrence are returned."""

    def run(batches):
        import pyarrow as pa

        asked = phrases.value
        lengths = asked.lengths
        for segment, docs, n_words, post in segments_of(batches, asked):
            which, start = post.phrases(asked.windows)
            edges = np.zeros(post.base[-1] + 1, np.int32)
            np.add.at(edges, start, 1)
            np.add.at(edges, start + lengths[which], -1)
            step = np.diff((np.cumsum(edges) > 0).astype(np.int8), prepend=0)
            begin, end = np.flatnonzero(step > 0), np.flatnonzero(step < 0)
            owner = post.doc(begin)
            flat = np.column_stack([begin, end]) - post.base[owner][:, None]
            runs = pa.ListArray.from_arrays(pa.array(2 * np.searchsorted(owner, np.arange(len(n_words) + 1)), pa.int32()), pa.array(flat.reshape(-1), pa.int64()))
            found: dict[int, set] = {}
            for d, w in np.unique(np.column_stack([post.doc(start), which]), axis=0).tolist():
                found.setdefault(d, set()).update(asked.item_ids[i] for i in asked.items_of(w))
            items = pa.array([sorted(found[d] - {None}) if d in found else [] for d in range(len(n_words))], pa.list_(pa.string()))
            out = pa.RecordBatch.from_arrays([pa.array(np.full(len(n_words), segment)), pa.array(np.arange(len(n_words)), pa.int32()), docs, pa.array(n_words, pa.int64()), runs, items], ["segment", "nth", "doc_id", "n_words", "runs", "items"])
            yield out if all_docs else out.take(pa.array(np.unique(owner), pa.int64()))

    return shipped(index).mapInArrow(run, FOUND_SCHEMA)


def merged_runs(runs: Column) -> Column:
    """Lists of (start, end, start, end, ...), put together: ascending, without overlap."""
    every = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.size(r).cast("int"), F.lit(2)), lambda i: F.struct(F.element_at(r, i).alias("a"), F.element_at(r, i + 1).alias("b")))))

    def joined(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        touch = (F.size(done) > 0) & (x["a"] <= last)
        return F.when(touch, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.greatest(last, x["b"])))).otherwise(F.concat(done, F.array(x["a"], x["b"])))

    return F.aggregate(F.array_sort(every), F.array().cast("array<bigint>"), joined)


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, runs (start, end of covered words, in pairs) and items.

    A window is ``window`` consecutive words of a ``benchmark`` item (item_id, text), or all words
    of an item that has fewer; items without words have none. The index is written once; a benchmark
    of more than ``PART_ITEMS`` items or ``PART_BYTES`` bytes is asked for part by part, and what the
    parts find is joined by the documents' places in the index.

    Null texts have no words. Null, tied and repeated doc_ids keep their rows. Null item_ids mark
    words as hit but are not named; repeated item_ids count once. Empty tables give empty results,
    an empty benchmark no hits. Only the named columns are read.
    """
    context = docs.sparkSession.sparkContext
    index = build_index(docs)
    parts = benchmark_parts(benchmark)
    first, second = next(parts), next(parts, None)
    if second is None:
        return matches(index, context.broadcast(Phrases(*first, window)), window).select("doc_id", "n_words", "runs", "items")
    found = None
    for part in _chain(first, second, parts):
        phrases = context.broadcast(Phrases(*part, window))
        own = staged(matches(index, phrases, window, all_docs=False), "decontam-found")
        phrases.unpersist()
        found = own if found is None else found.unionByName(own)
    hits = found.groupBy("segment", "nth").agg(F.collect_list("runs").alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = hits.withColumn("runs", merged_runs(F.col("runs")))
    every = matches(index, context.broadcast(Phrases([], [], window)), window).drop("runs", "items")
    none = F.array()
    return every.join(hits, ["segment", "nth"], "left").select("doc_id", "n_words", F.coalesce("runs", none.cast("array<bigint>")).alias("runs"), F.coalesce("items", none.cast("array<string>")).alias("items"))


def _chain(first, second, rest):
    yield first
    yield second
    yield from rest


def find_near(docs: DataFrame, benchmark: DataFrame, window: int = 13, slack: int = 3) -> DataFrame:
    """doc_id, item_id of documents that hold all words of one of an item's windows within window + slack words, in any order."""
    index, out = build_index(docs), None
    for part in benchmark_parts(benchmark):
        phrases = docs.sparkSession.sparkContext.broadcast(Phrases(*part, window))

        def run(batches, phrases=phrases):
            import pyarrow as pa

            asked = phrases.value
            for _, ids, _, post in segments_of(batches, asked):
                which, place = post.near(asked.windows, slack)
                pairs = sorted({(d, int(i)) for d, w in zip(post.doc(place).tolist(), which.tolist(), strict=True) for i in asked.items_of(w)})
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([d for d, _ in pairs], pa.int64())), pa.array([asked.item_ids[i] for _, i in pairs], pa.string())], ["doc_id", "item_id"])

        found = staged(shipped(index).mapInArrow(run, "doc_id long, item_id string"), "decontam-near")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; see :func:`find_passages`."""
    hit = F.aggregate(F.transform("runs", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda s, x: s + x)
    found = find_passages(docs, benchmark, window).select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
