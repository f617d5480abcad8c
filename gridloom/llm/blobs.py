"""Numeric columns moved as one row of packed arrays for each bucket.

A task sorts what it has by bucket and sends each bucket one row of binary
columns; a bucket's task reads them back as numpy arrays. Spark partitions,
shuffles and retries as with any rows; only their number is small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 4 << 20  # bytes of text at a time
BUCKET = 4 << 20  # bytes of text for each bucket


def bucket_count(texts: DataFrame) -> int:
    """Buckets for the column ``text``, in proportion to its bytes, so that a bucket's size does not depend on the input."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // BUCKET))


def chunks(batches: Iterator[pa.RecordBatch], column: int, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Batches of about ``limit`` bytes of text, and their texts."""
    for b in batches:
        size = pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1 if b.num_rows else []
        edges = [0, *[int(x) for x in cut], b.num_rows]
        for a, z in zip(edges, edges[1:], strict=False):
            if z > a:
                part = b.slice(a, z - a)
                yield part, part.column(column).to_pylist()


def sent(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per bucket with the bytes of its part of each array; ``bucket`` is sorted."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1 if len(bucket) else []
    for part in np.split(np.arange(len(bucket)), cuts):
        if len(part):
            a, z = part[0], part[-1] + 1
            cols = [pa.array([int(bucket[a])], pa.int32()), *[pa.array([x[a:z].tobytes()], pa.binary()) for x in arrays]]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", *[f"a{i}" for i in range(len(arrays))]])


def gathered(batches: Iterator[pa.RecordBatch], dtypes: list) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows sorted by bucket -> each bucket and its arrays."""
    now, held = None, []
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for row in zip(*cols, strict=True):
            if row[0] != now:
                if held:
                    yield now, [np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held, strict=True), dtypes, strict=True)]
                now, held = row[0], []
            held.append(row[1:])
    if held:
        yield now, [np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held, strict=True), dtypes, strict=True)]


def per_bucket(df: DataFrame, run, schema: str) -> DataFrame:
    return df.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def packed(x: np.ndarray, ascending: bool = False) -> bytes:
    """An array in few bytes: differences if it is sorted, byte planes, zstd."""
    x = np.ascontiguousarray(x)
    if ascending and len(x):
        x = np.concatenate([x[:1], x[1:] - x[:-1]])
    raw = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(b: bytes, dtype, ascending: bool = False) -> np.ndarray:
    raw = pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)
    kind = np.dtype(dtype)
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if ascending else x


def sent_packed(bucket: np.ndarray, *arrays: np.ndarray, extra: dict | None = None) -> Iterator[pa.RecordBatch]:
    """As ``sent``, packed; the first array is sorted within each bucket. ``extra``: further columns, one value each."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1 if len(bucket) else []
    for part in np.split(np.arange(len(bucket)), cuts):
        if len(part):
            a, z = part[0], part[-1] + 1
            cols = [pa.array([packed(x[a:z], i == 0)], pa.binary()) for i, x in enumerate(arrays)]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])], pa.int32()), *cols, *(extra or {}).values()], names=["bucket", *[f"a{i}" for i in range(len(arrays))], *(extra or {})])


def joined(parts: Iterator[pa.RecordBatch], rows: int = 256, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches, as each one costs more than a small row."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part.nbytes
        if len(held) == rows or size > limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
