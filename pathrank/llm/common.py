"""Small helpers that the operators of this subpackage share.

Reading a table, cutting lineage in the shared checkpoint folder, and numpy
routines that turn a batch of texts into arrays of words and rolling hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathrank.sources.shared import cut, shared_folder

#: Bytes of text that one numpy batch holds: temporary arrays take some 8 times as much.
CHUNK_BYTES = 1 << 18

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is in."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_temporary: list[list[str]] = []


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what operators have stored for themselves inside; their results must have been written by then."""
    _temporary.append([])
    try:
        yield
    finally:
        for path in _temporary.pop():
            delete(spark, path)


def temporary(path: str) -> str:
    """``path``, which the innermost ``temporaries`` deletes."""
    if _temporary:
        _temporary[-1].append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table in the shared folder, and read again."""
    path = temporary(f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text) -> F.Column:
    """A 256-bit key of a text: equal texts, and in effect only those, have equal keys."""
    return F.unhex(F.sha2(F.encode(text, "utf-8"), 256))


def chunks(rows: Iterable[tuple], size: int = CHUNK_BYTES) -> Iterator[list[tuple]]:
    """Groups rows, whose last item is a text in bytes, into lists of about ``size`` bytes."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += len(row[-1]) + 1
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def sliced(batches: Iterable[pa.RecordBatch], size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about ``size`` bytes of text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) + 1)
        low = 0
        while low < batch.num_rows:
            held = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, held + size, side="right")))
            yield batch.slice(low, high - low)
            low = high


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


class Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, as long as they are needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, CHUNK_BYTES + (1 << 16))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[_U64(1), np.full(n, self.base, _U64)], dtype=_U64)
                self.down = np.cumprod(np.r_[_U64(1), np.full(n, self.inverse, _U64)], dtype=_U64)
        return self.up, self.down


_BYTES = [mix(np.arange(256, dtype=_U64) * _U64(0x2545F4914F6CDD1D) + _U64(s)) for s in (1, 2)]
_POWERS = [Powers(_BASE), Powers(0xD6E8FEB86659FD93)]


def rolling(values: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of ``width`` successive 64-bit values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, _U64)
    up, down = _POWERS[which].upto(len(values) + 1)
    sums = np.empty(len(values) + 1, _U64)
    sums[0] = 0
    np.cumsum(values * up[: len(values)], dtype=_U64, out=sums[1:])
    return mix((sums[width:] - sums[:n]) * down[:n])


def stretches(values: np.ndarray, first: np.ndarray, last: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the runs from each ``first`` to before its ``last``, of any lengths."""
    up, down = _POWERS[which].upto(len(values) + 1)
    sums = np.concatenate(([_U64(0)], np.cumsum(values * up[: len(values)], dtype=_U64)))
    return mix((sums[last] - sums[first]) * down[first] + mix((last - first).astype(_U64)))


def byte_values(data: np.ndarray, which: int = 0) -> np.ndarray:
    return _BYTES[which][data]


class Words:
    """The words of some texts as arrays: hash, text's index, first byte and end of each word."""

    def __init__(self, texts: list[bytes], separators: np.ndarray, seeds: int = 1) -> None:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.bases = np.cumsum(self.lengths + 1) - self.lengths - 1
        gap = separators[data]
        gap[self.bases + self.lengths] = True
        if not texts:
            gap[:] = True
        edge = np.flatnonzero(np.diff(gap, prepend=True))
        self.begin, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.bases, self.begin, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.hashes = [self._hash(data, gap, which) for which in range(seeds)]
        self.data = data

    def _hash(self, data: np.ndarray, gap: np.ndarray, which: int) -> np.ndarray:
        if not len(self.begin):
            return np.empty(0, _U64)
        up, down = _POWERS[which].upto(len(data) + 1)
        values = _BYTES[which][data] * up[: len(data)]
        values[gap] = 0
        return mix(np.add.reduceat(values, self.begin) * down[self.begin])


def separators(inside) -> np.ndarray:
    """Which bytes lie outside words; ``inside(byte)`` tells those in words."""
    return np.array([not inside(b) for b in range(256)])


#: Words ``[^\x20\x09-\x0D]+``.
SPACES = separators(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
PUNCTUATION = separators(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` successive values, the index of the leftmost smallest one (by 32 of its bits)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    # the upper half of a value before its place: the smallest of these is the leftmost of the smallest
    best = (values & _U64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=_U64)
    span = 1
    while span < width:
        step = min(span, width - span)
        best = np.minimum(best[: len(best) - step], best[step:])
        span += step
    return (best[:n] & _U64(0xFFFFFFFF)).astype(np.int64)
