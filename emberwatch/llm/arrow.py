"""Helpers for functions that run over Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text looked at in one go; a longer single text is looked at alone.
CHUNK_BYTES = 1 << 20
#: Bytes of text whose places are worked out in one go: eight or more bytes a byte of text, several times over.
PIECE_BYTES = 1 << 18
#: Bytes of an Arrow batch between Spark and its workers; the buffers of both sides grow with it.
BATCH_BYTES = 4 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null counts as empty.

    Row ``i`` is ``bytes[offsets[i]:offsets[i + 1]]``.
    """
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offs, dtype=wide)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        lengths = np.diff(offsets)
        null = np.asarray(column.is_null())
        if lengths[null].any():
            return utf8(column.fill_null(""))
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session sends no batches above BATCH_BYTES to workers: 10,000 whole texts may be any size."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key)) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece have at most ``limit`` bytes, or it is one row.

    At the end what Arrow keeps for later is handed back: a worker that waits for its next task has no use for it.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
    pa.default_memory_pool().release_unused()


def ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (in place on its own copy)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Powers of an odd number and of its inverse modulo 2**64, grown on demand.
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    key = str(base)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        out = np.empty(max(n, 1 << 16), np.uint64)
        out[0] = 1
        done = 1
        while done < len(out):
            step = min(done, len(out) - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        if len(out) > 1 << 22:  # a very long text: not worth keeping
            return out
        have = _POWERS[key] = out
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """64-bit hashes of many byte spans of one buffer, from prefix sums of a polynomial."""
    n = len(data)
    up = _powers(n + 1, base)
    down = _powers(n + 1, pow(base, -1, 1 << 64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of bytes other than ASCII white space."""
    ink = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)  # where a text begins
    first[offsets[:-1]] = True
    begins = ink.copy()
    if len(data):
        begins[1:] &= ~ink[:-1] | first[1:-1]
    starts = np.flatnonzero(begins)
    stops = ink.copy()
    if len(data):
        stops[:-1] &= ~ink[1:] | first[1:-1]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, other bytes as they are."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of the texts, A-Z lower-cased."""
    starts, ends, row = words(data, offsets)
    return span_hashes(lower(data), starts, ends), row


def grams(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, index of its first word) of every run of ``k`` words inside one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return hashes[:0], row[:0], row[:0]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(_BASE) + hashes[at + j])
    return out, row[at], at


def minima(values: np.ndarray, w: int) -> np.ndarray:
    """For every window of ``w`` values the index of its leftmost smallest one."""
    n = len(values) - w + 1
    best, index, span = values, np.arange(len(values), dtype=np.int64), 1
    while span * 2 <= w:  # doubling: the best of 2 * span values from the best of two halves
        left, right = best[:-span], best[span:]
        take = right < left
        best, index = np.where(take, right, left), np.where(take, index[span:], index[:-span])
        span *= 2
    rest = w - span
    if rest:
        take = best[rest : rest + n] < best[:n]
        return np.where(take, index[rest : rest + n], index[:n])
    return index[:n]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
