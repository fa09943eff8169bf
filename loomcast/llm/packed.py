"""Moving many small records through a shuffle as few large ones.

Python stages that would shuffle hundreds of millions of rows put the records of one batch that go to one partition
into a single compressed row instead; the receiving task opens a bounded number of them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "bucket int, payload binary"


def narrow(a: np.ndarray) -> tuple[np.ndarray, int]:
    """64-bit whole numbers as offsets from their least one, in as few bytes as hold them."""
    if a.ndim != 1 or a.dtype.kind not in "iu" or a.itemsize < 8 or not len(a):
        return a, 0
    low = int(a.min())
    span = int(a.max()) - low
    kind = next((k for k in ("<u1", "<u2", "<u4") if span <= np.iinfo(k).max), None)
    return (a, 0) if kind is None else ((a - a.dtype.type(low)).astype(kind), low)


def dump(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed string; a 2-dimensional array keeps its width."""
    parts = []
    for a in arrays:
        small, low = narrow(a)
        width = a.shape[1] if a.ndim == 2 else 0
        kinds = (x.dtype.str[1:].encode().ljust(4) for x in (a, small))
        parts += [struct.pack("<4s4sqqQ", *kinds, len(a), width, low % (1 << 64)), np.ascontiguousarray(small).tobytes()]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def load(payload: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(payload), 0, []
    while at < len(raw):
        kind, held, n, width, low = struct.unpack_from("<4s4sqqQ", raw, at)
        at += 32
        dtype, small = (np.dtype(k.decode().strip()) for k in (kind, held))
        a = np.frombuffer(raw, small, n * (width or 1), at)
        at += a.nbytes
        if small != dtype:
            a = (a.astype(np.uint64) + np.uint64(low)).view(np.uint64).astype(dtype)
        out.append(a.reshape(n, width) if width else a)
    return out


def batch_of(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([b for b, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], names=["bucket", "payload"])


def dealt(buckets: np.ndarray, arrays: list[np.ndarray], level: int = 1) -> pa.RecordBatch:
    """One row per bucket that occurs, with the records of each array that go there."""
    order = np.argsort(buckets, kind="stable")
    buckets, arrays = buckets[order], [a[order] for a in arrays]
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    starts, ends = np.r_[0, cuts], np.r_[cuts, len(buckets)]
    if not len(buckets):
        return batch_of([])
    return batch_of([(int(buckets[s]), dump(*(a[s:e] for a in arrays), level=level)) for s, e in zip(starts, ends, strict=True)])


def exchange(rows: DataFrame, buckets: int) -> DataFrame:
    """Row with bucket i to partition i, in small Arrow batches as each row is large."""
    return rows.repartitionById(buckets, F.col("bucket"))


def opened(batches: Iterator[pa.RecordBatch], column: int = 1) -> list[np.ndarray]:
    """All records of a partition, joined array by array; empty if there are none."""
    got = [load(p) for batch in batches for p in batch.column(column).to_pylist()]
    return [np.concatenate(parts) for parts in zip(*got, strict=True)] if got else []


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal values in the first `keys` columns of a sorted partition; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_pylist() for i in range(keys)]
        rows = list(zip(*columns, strict=True))
        start = 0
        for i, row in enumerate(rows):
            if row != key:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield key, pa.Table.from_batches(held)
                held, key, start = [], row, i
        held.append(batch.slice(start))
    if held:
        yield key, pa.Table.from_batches(held)
