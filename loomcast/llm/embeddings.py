"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, reranking with the original vectors.

Rotations for balanced binary codes are learned on a bounded sample (`FIT_ROWS` vectors of least hash); every vector is
indexed.  A code's bits are cut into substrings, one table each; substrings grow with the logarithm of the number of
vectors, so buckets keep their size, and there are as many tables (hence rotations) as it takes to find a pair at the
threshold with the target probability.  Vectors of a length that one block holds need no tables and are compared all.

Tables are sent sketches, a byte for each component with the length of the rounding error, instead of vectors.  In a
bucket, sketches whose cosine can reach the threshold, given both errors, are tied; ties give candidate groups.  Each
group's vectors are sent once and all pairs of the group compared in double precision inside workers.  Large buckets and
groups are cut into blocks, and block pairs go to different tasks.

Equal vectors are one class with a count, so copies are never compared.  Only ties, counts and a spanning forest leave a
worker, and components are joined from the latter.

Defined results: a vector that is null, empty, zero or holds null or non-finite components links with nothing and is
its own component; vectors of different lengths never link; rows that share a vec_id are one node in components; a
null vec_id links with nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, read_table, stored
from .components import connected_components
from .packed import groups

THRESHOLD = 0.9
RECALL = 0.97
FIT_ROWS = 10_000
FIT_STEPS = 30
#: Vectors in a bucket that are compared in one task.
BLOCK = 1500


def learn_rotation(sample: np.ndarray, seed: int) -> np.ndarray:
    """Iterative quantisation: alternate signs and the orthogonal rotation that brings vectors nearest to them."""
    d = sample.shape[1]
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    for _ in range(FIT_STEPS if len(sample) else 0):
        signs = np.where(sample @ turn >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(sample.T @ signs)
        turn = u @ vt
    return turn


def plan(n: int, d: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a substring and number of tables: about eight of n vectors to a bucket, found with this recall."""
    bits = max(4, min(d, math.ceil(math.log2(max(2, n / 8)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def substrings(unit: np.ndarray, rotations: list[np.ndarray], bits: int, tables: int) -> np.ndarray:
    """The tables' keys of each vector, from the codes of all rotations side by side."""
    code = np.concatenate([np.zeros((len(unit), 0), bool), *(unit @ r >= 0 for r in rotations)], axis=1)
    out = np.zeros((len(unit), tables), np.uint64)
    for t in range(tables):
        for b in code[:, t * bits : (t + 1) * bits].T:
            out[:, t] = (out[:, t] << np.uint64(1)) | b.astype(np.uint64)
    return out


def usable(column: str = "embedding"):
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def sketch(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of one byte in proportion to each vector, after its scale, and the length of the rounding error."""
    scale = np.abs(unit).max(1) / 127
    small = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - small * scale[:, None], axis=1)
    head = np.column_stack([scale, error * (1 + 1e-5)]).astype("<f4").view(np.uint8)
    return np.concatenate([head, small.astype(np.int8).view(np.uint8)], axis=1), error


INDEXED = "table int, key long, dim int, rep long, sketch binary"
KEYS = ["dim", "table", "key"]
CELL = ["low", "high", "block"]
LINKS = "rep long, links long, hub long"


def cells(rows: DataFrame, keys: list[str], large: DataFrame) -> DataFrame:
    """Rows of each key in the pairs of its blocks, one if `large` (keys, blocks) does not have it; a key's pair in one task."""
    cut = rows.join(large, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    names = [*keys, *CELL, *(c for c in rows.columns if c not in keys)]
    return cut.select(*names).repartition(*keys, "low", "high").sortWithinPartitions(*keys, "low", "high")


def blocks_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    return sizes.select(*keys, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))


def flushed(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    made = [np.concatenate(x) for x in zip(*found, strict=True)]
    found.clear()
    return pa.record_batch([pa.array(x) for x in made], names=names)


def tie(threshold: float):
    """Ties (a, b) between the vectors of a bucket whose sketches let their cosine reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .jaccard import roots

        found: list[tuple] = []
        for (*_, low, high), rows in groups(batches, 5):
            if len(rows) < 2:
                continue
            block, rep = rows.column(5).to_numpy(), rows.column(6).to_numpy()
            raw = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint8).reshape(len(rows), -1)
            scale, error = raw[:, :8].copy().view("<f4").T
            near = raw[:, 8:].view(np.int8).astype(np.float32) * scale[:, None]
            # both vectors are of length 1, so the cosine is off by no more than both errors and their product
            slack = error[:, None] + error[None, :] + error[:, None] * error[None, :] + np.float32(1e-5)
            linked = near @ near.T >= np.float32(threshold) - slack
            np.fill_diagonal(linked, False)
            if low != high:
                linked &= block[:, None] != block[None, :]
            hub = rep[roots(linked)]
            some = hub != rep
            if some.any():
                found.append((rep[some], hub[some]))
            if len(found) >= 256:
                yield flushed(found, ["a", "b"])
        if found:
            yield flushed(found, ["a", "b"])

    return run


def compare(threshold: float):
    """Links of the vectors of a candidate group, and each one's hub in a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .jaccard import roots

        found: list[tuple] = []
        for (_, low, high), rows in groups(batches, 3):
            block, rep, copies = rows.column(3).to_numpy(), rows.column(4).to_numpy(), rows.column(5).to_numpy()
            column = rows.column(6).combine_chunks()
            x = matrix(column, len(column[0]))
            x /= np.linalg.norm(x, axis=1)[:, None]
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            if low != high:
                linked &= block[:, None] != block[None, :]
            hub, some = rep[roots(linked)], linked.any(1)
            if some.any():
                found.append((rep[some], (linked[some] @ copies.astype(float)).astype(np.int64), hub[some]))
            if len(found) >= 256:
                yield flushed(found, ["rep", "links", "hub"])
        if found:
            yield flushed(found, ["rep", "links", "hub"])

    return run


def models_of(classes: DataFrame, threshold: float, recall: float) -> dict[int, tuple]:
    """Bits, tables and rotations for each vector length of which there are more than a block; no model: one bucket."""
    sizes = classes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).collect()
    models = {}
    for d, n in ((r.dim, r.n) for r in sizes):
        sample = classes.where(F.size("embedding") == d).orderBy(F.xxhash64("rep"), "rep").limit(FIT_ROWS).select("embedding").toPandas()
        x = np.array(sample["embedding"].tolist(), np.float64).reshape(-1, d)
        x /= np.linalg.norm(x, axis=1)[:, None]
        bits, tables = plan(n, d, threshold, recall)
        models[d] = (bits, tables, [learn_rotation(x, seed) for seed in range(math.ceil(bits * tables / d))])
    return models


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.where(usable()).where("vec_id is not null")
    classes = stored(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    shared = spark.sparkContext.broadcast(models_of(classes, threshold, recall))

    def index(with_sketch: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = np.array([len(x) for x in batch.column(0).to_pylist()])
                for d in np.unique(dims).tolist():
                    part = batch.take(pa.array(np.flatnonzero(dims == d)))
                    x = matrix(part.column(0), d)
                    x /= np.linalg.norm(x, axis=1)[:, None]
                    n = len(x)
                    bits, tables, rotations = shared.value.get(d, (0, 1, []))
                    keys = substrings(x, rotations, bits, tables)
                    sketches = pa.array([s.tobytes() for s in sketch(x)[0]] if with_sketch else [b""] * n, pa.binary())
                    for t in range(tables):
                        columns = [pa.array(np.full(n, t, np.int32)), pa.array(keys[:, t].view(np.int64)), pa.array(np.full(n, d, np.int32)), part.column(1), sketches]
                        yield pa.record_batch(columns, names=["table", "key", "dim", "rep", "sketch"])

        return run

    source = classes.select("embedding", "rep")
    large = stored(blocks_of(source.mapInArrow(index(False), INDEXED), KEYS), "buckets")
    met = cells(source.mapInArrow(index(True), INDEXED), KEYS, large).mapInArrow(tie(threshold), "a long, b long")
    grouped = connected_components(met)
    members = grouped.select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    joined = classes.join(members, "rep").select("grp", "rep", "copies", "embedding")
    links = stored(cells(joined, ["grp"], blocks_of(members, ["grp"])).mapInArrow(compare(threshold), LINKS), "vector-links")
    tied = connected_components(links.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    summed = links.groupBy("rep").agg(F.sum("links").alias("links"))
    classed = classes.join(summed, "rep", "left").join(tied.select(F.col("node").alias("rep"), "component"), "rep", "left")
    keyed = rows.withColumn("usable", usable() & F.col("vec_id").isNotNull())
    out = keyed.where("usable").join(classed, "embedding").select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    rest = keyed.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT x, y FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x
), c AS (SELECT x, min(y) AS least FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, coalesce(n.n_links, 0) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id,
  vec_id <= coalesce(c.least, vec_id) AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.x LEFT JOIN n ON vec_id = n.x
"""
