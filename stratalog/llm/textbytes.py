"""Vectorised work on the UTF-8 bytes of a batch of texts.

A batch is one uint8 array plus document offsets, taken from Arrow's own buffers. Everything here
is plain numpy inside a task; Spark deals out the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch given to Python; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
#: Bytes worked on at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 19

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GAMMA = np.random.default_rng(20240229).integers(1, 1 << 63, size=256, dtype=np.uint64) | U64(1)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow over batches of bounded bytes, so that long texts don't fill a worker. Sets the session's limit where it is larger."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name).rstrip("b")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary Arrow column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if large else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes each."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def spaced(data: np.ndarray, offs: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents i..j with one blank after each, and where each starts; so that words end with their document."""
    cut = offs[i : j + 1] - offs[i]
    starts = cut + np.arange(j - i + 1)
    out = np.full(int(cut[-1]) + (j - i), 32, dtype=np.uint8)
    keep = np.ones(len(out), dtype=bool)
    keep[starts[1:] - 1] = False
    out[keep] = data[offs[i] : offs[j]]
    return out, starts


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and inverse powers up to n, kept between calls."""
    if len(_powers[0]) < n + 1:
        size = max(n + 1, 2 * len(_powers[0]), CHUNK_BYTES + 65536)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which span_hash takes the hash of any span; values are 64-bit symbols."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def byte_sums(data: np.ndarray) -> np.ndarray:
    return prefix_sums(_GAMMA[data])


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, equal for equal bytes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space."""
    blank = SPACE[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    return edge[0::2], edge[1::2]


def int_column(values: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.array(values, type=kind or pa.int64())


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_column(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list<int64> column from flat values and row lengths."""
    offs = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values.astype(np.int64, copy=False)))
