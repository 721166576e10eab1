"""What the operators share: shipping the package, Arrow maps, word hashes, n-grams.

Words are maximal runs outside ``\\x20 \\x09-\\x0D`` with A-Z lower-cased, taken from UTF-8 bytes,
so nothing depends on a locale. A word becomes a 64-bit polynomial hash with a final mix.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "boxwise_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package present on the executors.

    A task hands freed memory back when it ends, as its Python worker lives on beside the tasks of later stages.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return unused memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def batch(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a) for a in arrays], names=names)


def ints(column: pa.Array) -> pa.Array:
    return column.cast(pa.int64())


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32, count=n + 1 + column.offset)[column.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return buf, o - o[0]


def slices(offs: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row stands alone."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_WORD = np.ones(256, np.uint8)
for _b in (0x20, *range(0x09, 0x0E)):
    _WORD[_b] = 0
    _VALUE[_b] = 0
#: For words without punctuation: ASCII other than letters and digits stands between words.
_PLAIN = _WORD.copy()
_PLAIN_VALUE = _VALUE.copy()
for _b in range(128):
    if not chr(_b).isalnum():
        _PLAIN[_b] = 0
        _PLAIN_VALUE[_b] = 0
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BLOCK = 1 << 17


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, BLOCK), base, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Final mix of a 64-bit hash: a bijection that spreads every bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U(33))
        h = h * U(0xFF51AFD7ED558CCD)
        h ^= h >> U(33)
        h *= U(0xC4CEB9FE1A85EC53)
        h ^= h >> U(33)
    return h


def words(buf: np.ndarray, offs: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, and the word range of every text (n + 1).

    ``plain``: ASCII punctuation and control characters stand between words too.
    """
    none = np.zeros(0, np.int64)
    if not len(buf):
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offs), np.int64)
    inside, values = (_PLAIN[buf], _PLAIN_VALUE) if plain else (_WORD[buf], _VALUE)
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[0] = 0
    edge = offs[(offs > 0) & (offs < len(buf))]
    before[edge] = 0
    start = np.flatnonzero(inside > before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1] = 0
    after[edge - 1] = 0
    end = np.flatnonzero(inside > after) + 1
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        low = start[a]
        b = max(a + 1, int(np.searchsorted(end, low + BLOCK, side="right")))
        high = end[b - 1]
        power, inverse = _powers(int(high - low) + 1)
        with np.errstate(over="ignore"):
            s = np.zeros(high - low + 1, np.uint64)
            np.cumsum(values[buf[low:high]] * power[: high - low], out=s[1:])
            out[a:b] = (s[end[a:b] - low] - s[start[a:b] - low]) * inverse[start[a:b] - low]
        a = b
    return mix(out), start, end, np.searchsorted(start, offs).astype(np.int64)


_GRAM = [U(0xD6E8FEB86659FD93), U(0xA5A3564E27F8865B), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5)]


def grams(word: np.ndarray, bounds: np.ndarray, n: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first word of every n-gram inside a text, and the gram range of every text.

    ``whole``: a text of fewer words, but some, gives its whole sequence as its one gram.
    """
    lens = np.diff(bounds)
    counts = np.maximum(lens - n + 1, 0)
    out_bounds = np.zeros(len(bounds), np.int64)
    short = (lens > 0) & (lens < n) if whole else np.zeros(len(lens), bool)
    np.cumsum(counts + short, out=out_bounds[1:])
    first = np.arange(out_bounds[-1]) + np.repeat(bounds[:-1] - out_bounds[:-1], np.diff(out_bounds))
    with np.errstate(over="ignore"):
        h = np.zeros(len(first), np.uint64)
        last = len(word) - 1
        for k in range(n):
            h += mix(word[np.minimum(first + k, last)] + U(k + 1)) * _GRAM[k % 5] if len(first) else 0
        for i in np.flatnonzero(short):
            v = U(0x5851F42D4C957F2D)
            for w in word[bounds[i] : bounds[i + 1]]:
                v = v * U(6364136223846793005) + w
            h[out_bounds[i]] = v
    return mix(h), first, out_bounds
