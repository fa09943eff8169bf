"""N-gram Jaccard join: MinHash LSH forest over word shingles, then exact verification.

A document is the set of its runs of five words (of fewer, but not none: one run of all).  Documents with equal sets
are one class.  A signature is a one-permutation MinHash with optimal densification in 256 bins; 32 trees take eight
bins each, 16 bits of a bin, as a label of 128 bits.  Labels of a tree are sorted, so a node of its prefix trie is a run
of labels with a common prefix, and classes that share a node become candidates.  Matches are sought at the full depth
first.  Each verified match of similarity s was found with the chance 1 - (1 - s^depth)^32, so the matches seen tell how
many there are in all; as long as they are a smaller share than the target recall, all prefixes are shortened by one bin
and the larger nodes are matched.  A depth at which even pairs at the threshold are found often enough needs no such
estimate: at the similarity of 0.8 that is the full depth already (0.997).

Candidates are not expanded into pairs.  Nodes tie their classes to one of them (pre-aggregated in each batch, so a hot
node sends a row per task), ties give candidate groups, and each group is verified exactly from the full shingle sets:
all its pairs are counted inside a worker, in blocks of bounded size that go to different tasks when a group is large.
Only counts and a spanning forest of the verified links leave the worker.

Defined results: null texts and texts without words link with nothing; rows that share a doc_id are one document
(linked to all that any of its texts is); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, lean, mix64, prepare, read_table, shingle_hashes, stored, word_hashes
from .components import connected_components
from .packed import SCHEMA, dealt, exchange, groups, load

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH, BINS = 32, 8, 256
RECALL = 0.99
#: Documents whose sets meet in one worker are at most about twice this many.
BLOCK = 750

SIGNATURES = "doc_id long, n int, fp1 long, fp2 long, labels binary"


def found(similarity, depth: int):
    """The chance that a pair of this similarity shares a node of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted sets of 54-bit shingle hashes, one per text."""
    out = []
    for text in texts:
        words = word_hashes(text.encode("utf-8", "surrogatepass")) if text else np.zeros(0, np.uint64)
        x = np.sort(shingle_hashes(words, SHINGLE) >> np.uint64(10))
        out.append(x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x)
    return out


_ATTEMPTS = 48


def _detours() -> np.ndarray:
    """For each attempt and bin, the bin to borrow from."""
    seed = np.arange(_ATTEMPTS * BINS, dtype=np.uint64).reshape(_ATTEMPTS, BINS) + np.uint64(77)
    with np.errstate(over="ignore"):
        return (mix64(seed) & np.uint64(BINS - 1)).astype(np.int64)


DETOURS = _detours()


def signature(x: np.ndarray) -> np.ndarray:
    """Least value of each bin (the top bits of a hash say which); empty bins borrow along fixed detours."""
    bins = (x >> np.uint64(46)).astype(np.int64)
    first = np.r_[True, bins[1:] != bins[:-1]]
    full = np.zeros(BINS, bool)
    full[bins[first]] = True
    sig = np.zeros(BINS, np.uint64)
    sig[bins[first]] = x[first]
    empty = np.flatnonzero(~full)
    for k in range(_ATTEMPTS):
        if not len(empty):
            return sig
        source = DETOURS[k, empty]
        good = full[source]
        sig[empty[good]] = sig[source[good]]
        empty = empty[~good]
    if len(empty):  # few bins are full: take the next full one
        have = np.flatnonzero(full)
        sig[empty] = sig[have[np.searchsorted(have, empty) % len(have)]]
    return sig


def tree_labels(sig: np.ndarray) -> np.ndarray:
    """Each tree's label as two numbers in the order of its bins; signatures in rows."""
    with np.errstate(over="ignore"):
        parts = (mix64(sig) >> np.uint64(48)).reshape(-1, TREES, 2, DEPTH // 2)
        shift = np.uint64(16) * np.arange(DEPTH // 2 - 1, -1, -1, dtype=np.uint64)
        return (parts << shift).sum(3, dtype=np.uint64)


def signatures(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = batch.column(0), shingle_sets(batch.column(1).to_pylist())
            fp = np.zeros((len(sets), 2), np.uint64)
            sig = np.zeros((len(sets), BINS), np.uint64)
            with np.errstate(over="ignore"):
                for i, x in enumerate(sets):
                    if len(x):
                        fp[i] = mix64(x).sum(dtype=np.uint64), mix64(x + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                        sig[i] = signature(x)
            labels = tree_labels(sig)
            yield pa.record_batch(
                [
                    ids, pa.array([len(x) for x in sets], pa.int32()), pa.array(fp[:, 0].view(np.int64)), pa.array(fp[:, 1].view(np.int64)),
                    pa.array([k.tobytes() if len(x) else None for k, x in zip(labels, sets, strict=True)], pa.binary()),
                ],
                names=["doc_id", "n", "fp1", "fp2", "labels"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), SIGNATURES)


def prefix(labels: np.ndarray, depth: int) -> np.ndarray:
    """The first bins of labels (rows of two numbers), the others as zeros."""
    bits = [min(64, max(0, 16 * depth - 64 * i)) for i in range(2)]
    return labels & np.array([(1 << 64) - (1 << (64 - b)) for b in bits], np.uint64)


def tied(tree: np.ndarray, labels: np.ndarray, ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts the labels of each tree; the row of least id of each node of this depth, and ties (id, least id) of the others."""
    part = prefix(labels, depth)
    order = np.lexsort((ids, part[:, 1], part[:, 0], tree))
    tree, part, sorted_ids = tree[order], part[order], ids[order]
    first = np.r_[True, (tree[1:] != tree[:-1]) | (part[1:] != part[:-1]).any(1)] if len(order) else np.zeros(0, bool)
    head = sorted_ids[first][np.cumsum(first) - 1]
    loose = sorted_ids != head
    return order[first], sorted_ids[loose], head[loose]


def edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.column_stack([a, b]), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def candidate_edges(classes: DataFrame, depth: int, buckets: int) -> DataFrame:
    """Ties (a, b) between classes that share a trie node of this depth, from (rep, labels)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, 2)
            ids = np.repeat(batch.column(0).to_numpy(), TREES)
            tree = np.tile(np.arange(TREES, dtype=np.uint64), batch.num_rows)
            first, a, b = tied(tree, labels, ids, depth)
            part = prefix(labels[first], depth)
            with np.errstate(over="ignore"):  # a node, hence a whole trie below it, goes to one bucket
                node = mix64(part[:, 0] + mix64(part[:, 1] + tree[first] * np.uint64(0x9E3779B97F4A7C15)))
            where = ((node >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            yield dealt(where, [tree[first], labels[first], ids[first]])
            if len(a):  # ties found here travel as they are
                yield dealt((a % buckets).astype(np.int32), [a, b])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ties = [], []
        for batch in batches:
            for payload in batch.column(1).to_pylist():
                got = load(payload)
                (rows if len(got) == 3 else ties).append(got)
        if rows:
            ties.append(tied(*(np.concatenate(x) for x in zip(*rows, strict=True)), depth)[1:])
        if ties:
            yield edge_batch(*(np.concatenate(x) for x in zip(*ties, strict=True)))

    sent = classes.select("rep", "labels").mapInArrow(lean(send), SCHEMA)
    return exchange(sent, buckets).mapInArrow(lean(meet), "a long, b long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, at most 4,096 of them.

    Shingles of many sets count by one matrix product, those of few by their pairs.
    """
    g = len(sets)
    owner = np.repeat(np.arange(g, dtype=np.uint64), [len(x) for x in sets])
    code = np.sort(((np.concatenate(sets) >> np.uint64(2)) << np.uint64(12)) | owner)
    value, owner = code >> np.uint64(12), (code & np.uint64(4095)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    size = np.diff(np.r_[starts, len(value)])
    out = np.zeros((g, g), np.float32)
    limit = 0 if g <= 64 else max(8, g // 16)
    dense = np.flatnonzero((size > max(1, limit)) if limit else (size > 1))
    for at in range(0, len(dense), 2048):
        part = dense[at : at + 2048]
        x = np.zeros((g, len(part)), np.float32)
        rows = np.concatenate([owner[s : s + n] for s, n in zip(starts[part], size[part], strict=True)])
        x[rows, np.repeat(np.arange(len(part)), size[part])] = 1
        out += x @ x.T
    if limit:
        for n in range(2, limit + 1):
            run = starts[size == n]
            for at in range(0, len(run), max(1, 4_000_000 // (n * n))):
                who = owner[run[at : at + max(1, 4_000_000 // (n * n)), None] + np.arange(n)]
                pair = (who[:, :, None] * g + who[:, None, :]).ravel()
                hit, count = np.unique(pair, return_counts=True) if len(pair) < g * g else (None, np.bincount(pair, minlength=g * g))
                if hit is None:
                    out += count.reshape(g, g)
                else:
                    out.ravel()[hit] += count
        np.fill_diagonal(out, [len(x) for x in sets])
    return out


def roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the least index it is connected to."""
    g = len(linked)
    root = np.full(g, -1)
    for i in np.flatnonzero(linked.any(1)):
        if root[i] < 0:
            seen = np.zeros(g, bool)
            seen[i] = True
            front = np.array([i])
            while len(front):
                reach = linked[front].any(0) & ~seen
                seen |= reach
                front = np.flatnonzero(reach)
            root[seen] = i
    return np.where(root < 0, np.arange(g), root)


LINKS = "rep long, links long, hub long, pairs long, expected double"


def verify(threshold: float, depth: int):
    """Exact links of each block pair: a count of linked documents per class, and its hub in a spanning forest.

    pairs and expected: linked classes, and how many such there should be in all by the chances of finding them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), table in groups(batches, 3):
            rep = table.column(4).to_numpy()
            block = table.column(3).to_numpy()
            copies = table.column(5).to_numpy().astype(float)
            sets = [np.frombuffer(x, np.uint64) for x in table.column(6).to_pylist()]
            both = overlaps(sets)
            n = np.array([len(x) for x in sets], np.float64)
            likeness = both / (n[:, None] + n[None, :] - both)  # of whole numbers, so at the threshold it is exact
            linked = likeness >= threshold
            linked &= rep[:, None] != rep[None, :]
            if low != high:
                linked &= block[:, None] != block[None, :]
            some = linked.any(1)
            if not some.any():
                continue
            hub = rep[roots(linked)]
            links = (linked @ copies).astype(np.int64)
            expected = np.where(linked, 1 / found(np.maximum(likeness, threshold), depth), 0).sum(1)
            columns = [rep, links, hub, linked.sum(1), expected]
            yield pa.record_batch([pa.array(c[some]) for c in columns], names=["rep", "links", "hub", "pairs", "expected"])

    return run


def verified_links(rows: DataFrame, classes: DataFrame, threshold: float, depth: int) -> DataFrame:
    """LINKS of all classes that share nodes of this depth."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups_ = connected_components(candidate_edges(classes, depth, parts))
    members = groups_.join(classes.select("rep", "copies"), groups_.node == F.col("rep")).select("rep", "copies", F.col("component").alias("grp"))
    sizes = members.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    members = members.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(5).to_pylist())
            payload = pa.array([x.tobytes() for x in sets], pa.binary())
            yield pa.record_batch([*(batch.column(i) for i in range(5)), payload], names=["grp", "blocks", "block", "rep", "copies", "shingles"])

    mine = rows.join(members, rows.doc_id == members.rep).select("grp", "blocks", "block", "rep", "copies", "text")
    sets = mine.mapInArrow(lean(shingled), "grp long, blocks int, block int, rep long, copies long, shingles binary")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("other")
    spread = sets.select("*", other).select(
        "grp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "copies", "shingles"
    )
    spread = spread.repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high")
    return stored(spread.mapInArrow(lean(verify(threshold, depth)), LINKS), "links")


def forest_links(rows: DataFrame, classes: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, int]:
    """LINKS at the first depth, from the full one upwards, whose matches are the target share of all; and that depth."""
    for depth in range(DEPTH, 0, -1):
        links = verified_links(rows, classes, threshold, depth)
        if depth == 1 or found(threshold, depth) >= recall:
            break
        seen = links.agg(F.sum("pairs").alias("pairs"), F.sum("expected").alias("expected")).collect()[0]
        if seen.pairs and seen.pairs >= recall * seen.expected:
            break
        drop_stored(links)
    return links, depth


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (least doc_id of its connected group), text_id (of its equal sets), n_links for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(signatures(rows), "signatures")
    alike = signed.where("n > 0 and doc_id is not null").groupBy("fp1", "fp2", "n")
    classes = stored(alike.agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("labels").alias("labels")), "classes")
    links = forest_links(rows, classes, threshold, recall)[0]
    tied_ = connected_components(links.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    classed = classes.select("fp1", "fp2", "n", "rep", "copies").join(counts, "rep", "left")
    classed = classed.join(tied_.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = signed.select("doc_id", "fp1", "fp2", "n").join(classed, ["fp1", "fp2", "n"], "left")
    alone = F.col("rep").isNull() | (F.col("n") == 0)
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "rep")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("rep")).alias("text_id"),
        F.when(alone, F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
    )


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (
  SELECT a, b, k = n1.n AND k = n2.n AS same FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY 1, 2)
  JOIN n n1 ON n1.doc_id = a JOIN n n2 ON n2.doc_id = b WHERE k >= 0.8 * (n1.n + n2.n - k)
), reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY 1), k AS (SELECT a, count(*) AS n_links, min(b) FILTER (same) AS twin FROM l GROUP BY 1)
SELECT doc_id, least(doc_id, coalesce(c.least, doc_id)) AS class_id, least(doc_id, coalesce(twin, doc_id)) AS text_id, coalesce(n_links, 0) AS n_links
FROM documents LEFT JOIN c ON doc_id = c.a LEFT JOIN k ON doc_id = k.a
"""
