"""What the corpus operators share: reading tables, shared storage, word splitting and 64-bit hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python; bounds a worker's memory for texts of ordinary length.
BATCH_ROWS = 1000

#: ASCII bytes that do not belong to words become blanks, A-Z become a-z, other bytes stay.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

_FALLBACK: list[str] = []
_STARTED: list[SparkSession] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, through Spark's reader only (the store may be one that only Spark can open)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """What the Python stages rely on: small Arrow batches bound a worker's memory, and workers find this package.

    On a cluster the package is installed or shipped with --py-files; the path only helps workers on this machine.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that driver and executors share (spark.checkpoint.dir).

    Only a session of one machine may leave that unset; on a cluster, a folder of our own would be another on each machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _FALLBACK:
            _FALLBACK.append(tempfile.mkdtemp(prefix="loomcast-"))
        found = f"file://{_FALLBACK[0]}"
    return f"{found.rstrip('/')}/loomcast-{spark.sparkContext.applicationId}"


#: What a worker holds from one task to the next, by the operator that holds it, and how it is let go.
_HELD: dict[str, Callable[[], None]] = {}


def hold(operator: str, let_go: Callable[[], None]) -> None:
    _HELD[operator] = let_go


def release(operator: str | None = None) -> None:
    """Let go what this process holds for other operators, and give memory that nothing uses back to the system.

    Spark hands a worker from one stage to the next, so what a stage leaves there would add to the next one's memory.
    """
    global _POWERS, _INVERSES
    for held in [x for x in _HELD if x != operator]:
        _HELD.pop(held)()
    _POWERS = _INVERSES = np.ones(1, np.uint64)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def lean(run: Callable, operator: str | None = None) -> Callable:
    """A Python stage that starts without what other operators hold in its worker and leaves only what `operator` holds."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(operator)
        try:
            yield from run(batches)
        finally:
            release(operator)

    return stage


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query are deleted when it ends; a lost executor's are made again while it runs."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write a result to the shared folder and read it back: lineage is cut, shuffle files go, lost executors cost nothing."""
    spark = df.sparkSession
    if not _STARTED:
        _STARTED.append(spark)
        atexit.register(clear, spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(*frames: DataFrame) -> None:
    """Delete the files behind stored() frames once nothing reads them any more."""
    for df in frames:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, parent)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has stored; results that read it are void then.  Called when Python ends."""
    if spark.sparkContext._jsc is not None:
        _delete(spark, shared_dir(spark))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8: runs of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS))
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE)]), dtype=np.uint64)
    return _POWERS


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes of a text and the start and end of each word in them."""
    data = np.frombuffer(raw.translate(WORD_TABLE), np.uint8)
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.not_equal(data, 32, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return data, edges[::2], edges[1::2]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text, in order, without a Python object per word."""
    return word_hashes_at(raw)[0]


def word_hashes_at(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a UTF-8 text, in order, and where they start; a word's hash does not depend on its place.

    A polynomial over the bytes, taken from prefix sums: with S[i] = sum of (b+1)*B^i, a word's
    S[end]-S[start] is divided by B^start through the inverse power.
    """
    data, starts, ends = word_spans(raw)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    with np.errstate(over="ignore"):
        power = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        # multiplying by B^(n-start) instead of dividing keeps everything in wrapping arithmetic per text,
        # so the inverse powers are needed to make a word's hash independent of its place
        value = (sums[ends] - sums[starts]) * _inverse(len(data) + 1)[starts]
        return mix64(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


_INVERSES = np.ones(1, np.uint64)


def _inverse(n: int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) < n:
        size = max(n, 2 * len(_INVERSES))
        inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _INVERSES = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, inv)]), dtype=np.uint64)
    return _INVERSES


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of `size` words; a text of fewer words, but not none, is one shingle."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
        return mix64(out)
