"""Binary token-id shards with a minimal perfect hash index.

A store is a table of segments, in ascending key order. Each segment is one row: ``part`` and
``seq`` (its place), ``n_docs``, ``n_ids``, ``first_key``, ``last_key``, ``keys`` (the keys of its
documents in order: the manifest that a whole scan asks for) and two byte strings.

``payload``: the ids of the segment's documents one after another, unsigned 32-bit little-endian.

``head``, all little-endian: magic ``TFS2``; uint32 n_keys, n_entries (one more than n_keys if
documents without a key follow), n_inner, n_levels; uint32 bits of each level; the levels' bit
arrays, packed, each a whole number of bytes; uint32 fingerprints, one for each key; and for each
entry uint64 start and end in the payload, in ids, and uint32 number of documents; uint64 ends of
all documents but the last of each entry, entry by entry.

The index is a minimal perfect hash of levels: a key sits in the first level in which its bit is
set, and its slot, which is its entry, is the number of set bits before that bit. The head holds no
keys: a stored fingerprint tells keys that are not there, and the entry is the only way to a
document's offset. Segments are rows of Parquet files, so any store that Spark writes to holds them
and its commit protocol covers lost executors.
"""

from __future__ import annotations

import struct
import zlib
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import kept, shipped, slices, staged, trimmed
from .token_counts import plain_pieces, plain_tokens, splitter

MAGIC = b"TFS2"
LEVEL_ROOM = 2.0
SEGMENT_IDS = 1_000_000
#: Tokens, and pre-tokens, that a Python worker keeps.
REMEMBERED = 400_000


def key_hash(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (key_hash(keys, 1000) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class PerfectHash:
    """Slots 0..n-1 for n distinct integer keys; lookups in constant expected time."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before, total = [], 0
        for bits in levels:
            self.before.append(total + np.concatenate([[0], np.cumsum(bits)]))
            total += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            m = max(8, int(len(left) * LEVEL_ROOM))
            at = (key_hash(left, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has its bit."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            at = (key_hash(keys[todo], i) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = self.before[i][at[hit]]
            todo = todo[~hit]
        return out


class Segment:
    """The index of one segment and its payload, read from their bytes."""

    def __init__(self, head: bytes, payload: bytes):
        if bytes(memoryview(head)[:4]) != MAGIC:
            raise ValueError("not a token segment")
        n, entries, inner, levels = struct.unpack_from("<4I", head, 4)
        at = 20
        widths = np.frombuffer(head, "<u4", levels, at)
        at += 4 * levels
        bits = []
        for m in widths.tolist():
            size = -(-m // 8)
            bits.append(np.unpackbits(np.frombuffer(head, np.uint8, size, at), count=m, bitorder="little").astype(bool))
            at += size
        self.hash, self.nameless = PerfectHash(bits), n if entries > n else -1
        self.fingerprints = np.frombuffer(head, "<u4", n, at)
        at += 4 * n
        self.start = np.frombuffer(head, "<u8", entries, at).astype(np.int64)
        self.end = np.frombuffer(head, "<u8", entries, at + 8 * entries).astype(np.int64)
        self.docs = np.frombuffer(head, "<u4", entries, at + 16 * entries).astype(np.int64)
        self.inner = np.frombuffer(head, "<u8", inner, at + 20 * entries).astype(np.int64)
        self.inner_from = np.cumsum(self.docs - 1) - self.docs + 1
        self.payload = payload

    @staticmethod
    def pack(keys: np.ndarray, nameless: int, ends: np.ndarray) -> bytes:
        """The head over ascending ``keys`` and then ``nameless`` documents without one; ``ends`` of all in the payload."""
        distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
        mph = PerfectHash.build(distinct)
        slots = mph.slots(distinct)
        by_slot = np.argsort(slots)
        first, count = first[by_slot], count[by_slot]
        if nameless:
            first, count = np.append(first, len(keys)), np.append(count, nameless)
        starts = np.append(0, ends)[:-1]
        spots = np.repeat(first - np.cumsum(count - 1) + count - 1, count - 1) + np.arange(int((count - 1).sum()))
        head = MAGIC + struct.pack("<4I", len(distinct), len(first), len(spots), len(mph.levels)) + np.array([len(b) for b in mph.levels], "<u4").tobytes()
        head += b"".join(np.packbits(b, bitorder="little").tobytes() for b in mph.levels) + fingerprint(distinct[by_slot]).astype("<u4").tobytes()
        return head + starts[first].astype("<u8").tobytes() + ends[first + count - 1].astype("<u8").tobytes() + count.astype("<u4").tobytes() + ends[spots].astype("<u8").tobytes()

    def entries(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key: its slot, if the fingerprint there is the key's; -1 if not."""
        slot = self.hash.slots(keys)
        ok = slot >= 0
        ok[ok] = self.fingerprints[slot[ok]] == fingerprint(keys[ok])
        return np.where(ok, slot, -1)

    def spans(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the documents of the entries stand in the payload, in ids, all those of an entry one after another."""
        n = self.docs[entry]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        entry = np.repeat(entry, n)
        inner = np.append(self.inner, 0)
        at = self.inner_from[entry] + nth
        start = np.where(nth == 0, self.start[entry], inner[np.minimum(at - 1, len(self.inner))])
        return start, np.where(nth == self.docs[entry] - 1, self.end[entry], inner[np.minimum(at, len(self.inner))])

    def raw(self, start: int, end: int) -> memoryview:
        return memoryview(self.payload)[4 * start : 4 * end]

    def ids(self, key: int) -> np.ndarray | None:
        """The token ids of the first document of a key, by the index."""
        entry = self.entries(np.array([key], np.int64))
        if entry[0] < 0:
            return None
        start, end = self.spans(entry)
        return np.frombuffer(self.raw(start[0], end[0]), "<u4")


class Encoder:
    """Ids of whole texts by the tokenizer's own model, which is asked once for each distinct token.

    Texts are split and their tokens numbered column by column. The ids of the tokens seen stand in
    one pool; texts are gathered from it by token number.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.split = splitter(path)
        self.model = Tokenizer(self.split.tokenizer.model)
        self.shown = str.maketrans({chr(b): c for b, c in self.split.characters.items()})
        self.space = self.split.characters[0x20]
        specials = self.split.specials
        self.number = {t: i for i, t in enumerate([*specials, ""])}
        self.tokens = Pool([*([i] for i in specials.values()), []])
        self.piece_number = {"": 0}
        self.pieces = Pool([[]])

    def learn(self, new: list[str]) -> None:
        """Put the ids of new tokens into the pool: their pre-tokens are looked up, unseen ones encoded by the model."""
        plain = [t for t in new if t[0] != "\0"]
        ready = [t for t in new if t[0] == "\0"]
        codes, names, counts = numbered(plain_pieces(plain))
        if ready:
            codes = np.append(codes, len(names) + np.arange(len(ready)))
            names, counts = [*names, *(t[1:] for t in ready)], np.append(counts, np.ones(len(ready), np.int64))
        unseen = list(dict.fromkeys(p for p in names if p not in self.piece_number))
        if unseen:
            # No piece holds a space, so one translation serves them all.
            shown = " ".join(unseen).encode().decode("latin-1").translate(self.shown).split(self.space)
            self.piece_number.update(zip(unseen, range(len(self.piece_number), len(self.piece_number) + len(unseen)), strict=True))
            self.pieces.add([e.ids for e in self.model.encode_batch_fast(shown, add_special_tokens=False)])
        which = np.fromiter(map(self.piece_number.__getitem__, names), np.int64, len(names))[codes]
        self.number.update(zip(chain(plain, ready), range(len(self.number), len(self.number) + len(new)), strict=True))
        ids, ends = self.pieces.gather(which)
        self.tokens.add_flat(ids, np.diff(np.append(0, ends)[np.append(0, np.cumsum(counts))]))
        if len(self.piece_number) > REMEMBERED:
            for p in unseen:
                del self.piece_number[p]
            self.pieces.cut(len(self.piece_number))

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow column of texts one after another, and where each text's ids end."""
        codes, names, counts = numbered(plain_tokens(texts, self.split))
        known = np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))
        new = [names[i] for i in np.flatnonzero(known < 0)]
        if new:
            self.learn(new)
            known[known < 0] = np.fromiter(map(self.number.__getitem__, new), np.int64, len(new))
        ids, ends = self.tokens.gather(known[codes])
        if len(self.number) > REMEMBERED:  # the first tokens stay; these were for this call
            for t in new:
                del self.number[t]
            self.tokens.cut(len(self.number))
        return ids, np.append(0, ends)[np.cumsum(counts)]


def numbered(lists) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Of an Arrow column of lists of strings: the number of each string, the distinct strings, the length of each list."""
    import pyarrow.compute as pc

    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), pc.list_value_length(lists).to_numpy().astype(np.int64)


class Pool:
    """Id sequences one after another, found by their numbers."""

    def __init__(self, ids: list[list[int]]):
        self.ids, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.add(ids)

    def add(self, ids: list[list[int]]) -> None:
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.add_flat(np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size)

    def add_flat(self, ids: np.ndarray, size: np.ndarray) -> None:
        self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
        self.size, self.ids = np.append(self.size, size), np.append(self.ids, ids)

    def cut(self, n: int) -> None:
        self.ids = self.ids[: self.start[n]] if n < len(self.start) else self.ids
        self.start, self.size = self.start[:n], self.size[:n]

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the sequences numbered ``which``, and where each ends."""
        size = self.size[which]
        ends = np.cumsum(size)
        at = np.repeat(self.start[which] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return self.ids[at], ends


def write_tokens(docs: DataFrame, path: str, end_id: int = 1, segment_ids: int = SEGMENT_IDS, slice_bytes: int = 4_000_000) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text), append ``end_id`` and write the segments.

    Documents stand in ascending doc_id order, null last; equal doc_ids by a hash of the text.
    Returns the table of segments as read back from the files.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encode = kept(("encoder", path), lambda: Encoder(path))
        keys, ids, ends, held = [], [], [], 0

        def segment():
            own, sizes = pa.concat_arrays(keys), np.concatenate(ends)
            named = own.drop_null().to_numpy()
            head = Segment.pack(named, own.null_count, np.cumsum(sizes))
            payload = np.concatenate(ids).astype("<u4", copy=False).tobytes()
            columns = [part, seq, len(own), held, int(named[0]) if len(named) else None, int(named[-1]) if len(named) else None]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            own = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(columns, kinds, strict=True)] + [own, pa.array([head], pa.binary()), pa.array([payload], pa.binary())], NAMES)

        for batch in batches:
            for piece in slices(batch, batch.column(2).to_pylist(), slice_bytes):
                flat, at = encode(piece.column(1))
                flat = np.insert(flat, at, np.uint32(end_id))
                at = at + np.arange(1, len(at) + 1)
                done = begun = 0  # documents and ids of this slice that are in segments
                while done < len(at):
                    upto = min(int(np.searchsorted(at, begun + segment_ids - held)) + 1, len(at))
                    keys.append(piece.column(0).slice(done, upto - done))
                    ids.append(flat[begun : at[upto - 1]])
                    ends.append(np.diff(at[done:upto], prepend=begun))
                    held += int(at[upto - 1]) - begun
                    done, begun = upto, int(at[upto - 1])
                    if held >= segment_ids:
                        yield segment()
                        keys, ids, ends, held, seq = [], [], [], 0, seq + 1
        if held:
            yield segment()
        trimmed()

    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.col("doc_id").cast("long")
    read = shipped(docs).select(key.alias("doc_id"), text.alias("text"), F.octet_length(text).alias("n"), F.xxhash64(text).alias("tie"), (F.monotonically_increasing_id() % 1024).alias("salt"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc(), F.col("salt").asc()]
    dealt = read.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", "n")
    return staged(dealt.mapInArrow(run, SCHEMA), "token-segments")


NAMES = ["part", "seq", "n_docs", "n_ids", "first_key", "last_key", "keys", "head", "payload"]
SCHEMA = "part int, seq int, n_docs long, n_ids long, first_key long, last_key long, keys array<long>, head binary, payload binary"


def segment_starts(segments: DataFrame) -> DataFrame:
    """part, seq and the number of ids in all segments before each."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = segments.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("ahead"))
    return rows.join(parts, "part").select("part", "seq", (F.col("from") + F.col("ahead")).alias("base"))


def read_tokens(segments: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    Each key of a segment's manifest goes through the index: slot, fingerprint, then its documents' places.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(len(batch)):
                part, seq, manifest, head, payload = (batch.column(j)[i] for j in range(5))
                s = Segment(head.as_buffer(), payload.as_buffer())
                own = manifest.values
                keys = np.unique(own.drop_null().to_numpy())
                entry = s.entries(keys)
                if (entry < 0).any():
                    raise ValueError(f"segment {part}.{seq}: a key is not in its index")
                if own.null_count:
                    entry = np.append(entry, s.nameless)
                start, end = s.spans(entry)
                n, owner = len(start), np.repeat(np.arange(len(entry)), s.docs[entry])
                if n != len(own):
                    raise ValueError(f"segment {part}.{seq}: {len(own)} documents in the manifest, {n} in the index")
                nameless = owner >= len(keys)
                ids = pa.array(np.append(keys, 0)[owner], pa.int64(), mask=nameless)
                crc = [zlib.crc32(s.raw(a, b)) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, seq.as_py(), np.int32)), ids, pa.array(start), pa.array(end - start), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = shipped(segments).select("part", "seq", "keys", "head", "payload").mapInArrow(run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    starts = staged(segment_starts(segments.select("part", "seq", "n_ids")), "token-starts")
    starts = F.broadcast(starts) if starts.count() <= 100_000 else starts
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(segments: DataFrame, key: int) -> np.ndarray | None:
    """The ids of the first document of a key.

    The key range, which the file statistics answer, names the segment (segments share a key only if its
    documents fill more than one, and then the first is taken); one hash and one fingerprint name the place.
    """
    row = segments.filter((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("part", "seq").select("head", "payload").first()
    return None if row is None else Segment(bytes(row.head), bytes(row.payload)).ids(key)


def token_digest(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Write the token files of ``docs`` and read them back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts hold the end id alone. Null doc_ids come last and are not indexed;
    repeated rows each keep their place. An empty table gives an empty result.
    """
    return read_tokens(write_tokens(docs, path, end_id))
