"""Helpers shared by the operators of this subpackage: staging, hashing, batch slicing."""

from __future__ import annotations

import contextlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import shipped, written

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    return written(df, name)


def clear_name(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def uniform(*cols: Column | str) -> Column:
    """A reproducible number in [0, 1) from the values of ``cols``."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) * F.lit(2.0**-53)


def with_small(df: DataFrame, small: DataFrame, on, rows: int, how: str = "inner", most: int = 10_000) -> DataFrame:
    """Join a per-key table: broadcast while its counted rows are at most ``most``, else by shuffle."""
    return df.join(F.broadcast(small) if rows <= most else small, on, how)


_KEPT: dict = {}


def kept(key, make):
    """The one cache that this Python worker keeps from task to task; asking for another lets it go."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def trimmed() -> None:
    """Give memory that this Python worker no longer needs back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch, sizes, most: int):
    """Cut an Arrow batch into runs of rows of about ``most`` in total size (a larger row stands alone)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start, len(sizes) - start)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the row offsets (nulls are empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    if filled.offset:
        filled = pa.concat_arrays([filled, pa.array([], pa.large_string())])
    off = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = np.frombuffer(filled.buffers()[2], np.uint8) if filled.buffers()[2] is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]] if len(off) else data, (off - off[0]) if len(off) else np.zeros(1, np.int64)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes that ``inside`` marks, cut at row ends."""
    flag = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    prev = np.concatenate([[False], flag[:-1]])
    begin = np.flatnonzero(flag & (~prev | edge[:-1]))
    after = np.concatenate([flag[1:], [False]])
    end = np.flatnonzero(flag & (~after | edge[1:])) + 1
    return begin, end, np.searchsorted(off, begin, side="right") - 1


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int = 0, part: int = 32_768) -> np.ndarray:
    """A 64-bit hash of each byte span: eight bytes at a time, ``part`` spans side by side."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    # The eight bytes from every offset on, as one little-endian number.
    window = np.lib.stride_tricks.as_strided(padded[: max(len(padded) - 7, 0)].view(), (max(len(padded) - 7, 0), 8), (1, 1))
    out = np.empty(len(begin), np.uint64)
    for i in range(0, len(begin), part):
        at, left = begin[i : i + part].astype(np.int64), (end[i : i + part] - begin[i : i + part]).astype(np.int64)
        h = left.astype(np.uint64) * _MIX[which] + np.uint64(0x27D4EB2F165667C5 + which)
        todo = np.arange(len(at))
        while len(todo):
            word = window[at].view("<u8").reshape(-1)
            x = (h[todo] ^ (word & _LOW_BYTES[np.minimum(left, 8)])) * _MIX[which]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            h[todo] = x
            more = left > 8
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
        out[i : i + part] = h
    return out
