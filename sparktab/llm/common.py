"""Shared pieces: the shared folder, Arrow slices and word arrays."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.shared import discard, materialize, shared_dir

__all__ = ["discard", "materialize", "shared_dir"]

SLICE_BYTES = 1 << 20
#: Rows and bytes that may be broadcast as ids; a larger side is joined by shuffle.
BROADCAST_IDS = 1_000_000
BROADCAST_BYTES = 32 << 20
#: Bytes of rows that go to Python together.
ARROW_BYTES = 8 << 20
#: What a Python worker keeps from task to task; dropped by the first task that does not use it.
WORKER_CACHE: dict = {}


def few(ids: DataFrame, key: str) -> bool:
    """Whether ids are so few, and so short as text, that they may be broadcast."""
    rows, size = ids.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(key).cast("string"))), F.lit(0))).first()
    return rows <= BROADCAST_IDS and size <= BROADCAST_BYTES


def semi_or_anti(docs: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) ids, a written table; ids are broadcast only if they are few."""
    return docs.join(F.broadcast(ids) if few(ids, key) else ids, key, how)


def without_clashes(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the columns an operator reads; any further column is left out before the plan starts.

    From here on the session hands rows to Python in batches of ARROW_BYTES, however long texts are.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def hidden(df: DataFrame) -> DataFrame:
    """The same columns under names that cannot clash with those of an operator: c0, c1 and so on."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def give_back(cache: bool = True) -> None:
    """Returns memory to the system that earlier tasks of this worker freed, and what they cached.

    Spark reuses workers, so without it every stage of a long job adds to what they hold.
    """
    if cache:
        WORKER_CACHE.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def forget(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles that nothing refers to any more; it does so when the driver's memory is cleared."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES, cached: bool = False) -> Iterator[pa.RecordBatch]:
    """Row ranges of about `size` bytes of text, so that memory depends on the longest text only.

    `cached`: the task uses WORKER_CACHE, which is dropped otherwise.
    """
    give_back(not cached)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = text_buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    give_back(not cached)


def _byte_class(separators: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words are runs without space, tab, newline, vertical tab, form feed and return.
SPACED = _byte_class(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words are runs of 0-9, a-z and whatever is not ASCII, after lower-casing.
ALNUM = _byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
_CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for a piece of ordinary length are kept."""
    if n <= _CHUNK + 1 and "up" in _POWERS:
        return _POWERS["up"], _POWERS["down"]
    one = np.ones(1, np.uint64)
    up, down = (np.concatenate([one, np.cumprod(np.full(max(n, _CHUNK + 1) - 1, x, np.uint64))]) for x in (_BASE, _INV))
    if n <= _CHUNK + 1:
        _POWERS["up"], _POWERS["down"] = up, down
    return up, down


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that do not overlap, by one prefix sum per piece of text."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _CHUNK, "right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        up, down = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


class Words:
    """Word arrays of a slice: byte starts and ends, and for each text its range of words."""

    def __init__(self, column: pa.Array, kind: np.ndarray = SPACED, lower: bool = True):
        raw, off = text_buffers(column)
        self.data = LOWER[raw] if lower else raw
        self.off, n = off, len(raw)
        inside = kind[self.data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = off[(off > 0) & (off < n)]
        before[edges], after[edges - 1] = False, False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.ptr = np.searchsorted(self.starts, off)
        self.counts = np.diff(self.ptr)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


class HashTable:
    """Hashes (not 0) -> rows, as an open-addressed table that is probed by arrays."""

    def __init__(self, limit: int):
        size = 1 << max(10, (2 * limit).bit_length())
        self.keys, self.rows = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self.mask, self.used = np.uint64(size - 1), 0

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """Rows, -1 for an unknown hash."""
        out = np.full(len(hashes), -1, np.int64)
        open_, at = None, hashes & self.mask
        while len(at):
            key, wanted = self.keys[at], hashes if open_ is None else hashes[open_]
            hit = key == wanted
            if open_ is None:
                out[hit] = self.rows[at[hit]]
                more = np.flatnonzero(~hit & (key != 0))
                open_ = more
            else:
                out[open_[hit]] = self.rows[at[hit]]
                more = np.flatnonzero(~hit & (key != 0))
                open_ = open_[more]
            at = (at[more] + np.uint64(1)) & self.mask
        return out

    def put(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        """Adds distinct hashes that are not known yet; the table is at most half full, and grows with them."""
        self.used += len(hashes)
        if 2 * self.used > len(self.keys):
            taken = self.keys != 0
            hashes, rows = np.concatenate([hashes, self.keys[taken]]), np.concatenate([rows, self.rows[taken]])
            size = 1 << (4 * self.used - 1).bit_length()
            self.keys, self.rows, self.mask = np.zeros(size, np.uint64), np.zeros(size, np.int32), np.uint64(size - 1)
        at = hashes & self.mask
        while len(hashes):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[free]  # of several hashes for one place the last one stays
            won = free & (self.keys[at] == hashes)
            self.rows[at[won]] = rows[won]
            hashes, rows, at = hashes[~won], rows[~won], (at[~won] + np.uint64(1)) & self.mask


def segment_sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[ptr[1:]] - total[ptr[:-1]]


def remainder(n: int, doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))
