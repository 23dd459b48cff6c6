"""Helpers of the text operators: Arrow slices, word positions and 64-bit hashes of words and runs of words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are held as numpy arrays at once inside a task.
SLICE_BYTES = 4 << 20

#: Bytes that separate words in the contracts: x20 and x09 to x0D.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BASE = np.uint64(0x2545F4914F6CDD1D)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_S = np.uint64(32)

#: Stands for a null id where ids are ordered or joined: after all others.
LAST_ID = 2**63 - 1


def ranked(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """``(id, ord, tid, text)``: ``ord`` orders null ids last, ``(ord, tid)`` names a row by id and text.

    Columns other than ``more`` are dropped, so clashing names in ``docs`` do no harm.
    """
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)).alias("ord"),
        F.xxhash64(text).alias("tid"),
        text.alias("text"),
        *more,
    )


def release() -> None:
    """Hand freed memory of numpy and Arrow back to the system; a worker that waits for its next stage would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values, one to one."""
    x = x ^ (x >> _S)
    x = x * _A
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> _S
    return x


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, eight bytes at a time; ``data`` has 8 bytes to spare at its end."""
    eight = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    at, left = start, stop - start
    h = left.astype(np.uint64) * _B
    live = None
    while len(at):
        x = eight[at] & _MASKS[np.minimum(left, 8)]
        if live is None:
            h = mix(h ^ x)
        else:
            h[live] = mix(h[live] ^ x)
        keep = left > 8
        live = np.flatnonzero(keep) if live is None else live[keep]
        at, left = at[keep] + 8, left[keep] - 8
    return h


class Words:
    """The words of several texts: ``hash`` by word; text ``i`` has the words ``at[i]`` to ``at[i + 1]``.

    A word is a maximal run of bytes outside ``gaps``. ``lower`` lower-cases A-Z first. A null text has no words.
    """

    def __init__(self, texts: list[str | None], lower: bool = False, gaps: np.ndarray = SPACES):
        parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        data = b" ".join(parts)
        data = (data.lower() if lower else data) + b" " * 16
        self.bytes = np.frombuffer(data, np.uint8)
        cuts = np.cumsum([0] + [len(p) + 1 for p in parts])
        gap = gaps[self.bytes]
        flips = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            flips = np.concatenate(([0], flips))
        self.start, self.stop = flips[0::2], flips[1::2]
        self.at = np.searchsorted(self.start, cuts)
        self.hash = span_hashes(self.bytes, self.start, self.stop)

    def word(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.stop[i]].tobytes()


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


class RunHash:
    """64-bit hashes of any runs ``[a, b)`` of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(_BASE, n), out=self.sums[1:])
        self.back = powers(_INVERSE, n + 1)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(((self.sums[b] - self.sums[a]) * self.back[a]) ^ (b - a).astype(np.uint64))


def starts_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First positions of all runs of ``n`` words inside one text, and for each text the bounds of its own."""
    counts = np.maximum(np.diff(words.at) - n + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    return np.arange(bounds[-1]) + np.repeat(words.at[:-1] - bounds[:-1], counts), bounds


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def fold(key: Column, modulus: int) -> Column:
    """crc32 of a value's text, modulo; null counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)
