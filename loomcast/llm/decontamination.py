"""Benchmark decontamination: an exact containment join of item windows against documents by rare prefix words.

A window is `size` consecutive words of an item (all words of a shorter one).  Containment is whole, so the overlap
that a match needs is the window's size and the necessary prefix, once words are ordered by rarity over all documents,
is its rarest word alone.  That word and its position are joined with the documents' words; a candidate must leave
room for the window before and after (length and positional bounds) and is verified word by word.

The benchmark is a stated query set: its windows go to every task in blocks of bounded size (`block_bytes`), one pass
over the documents for each block, so nothing of unproven size is broadcast.

Defined results: null or empty texts have no words and no hits; items without words have no windows; repeated item or
document rows count as they are (an item_id once for each document); null item_ids are left out of the list of items;
an empty benchmark hits nothing, empty documents give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, prepare, read_table, stored, words_of

WINDOW = 10
#: Bytes of item text whose windows one pass holds in a task's memory.
BLOCK_BYTES = 8 << 20

HITS = [
    T.StructField("n_words", T.LongType()),
    *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("starts", "ends", "items")),
]
RESULT = [
    *(T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "n_items")),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
]


def windows_of(items: list[tuple], size: int) -> dict[tuple, set]:
    """Word windows of items and the ids of the items that have them."""
    found: dict[tuple, set] = {}
    for item, text in items:
        words = words_of(text)
        for at in range(max(1, len(words) - size + 1) if words else 0):
            found.setdefault(tuple(words[at : at + size]), set()).add(item)
    return found


def rarity(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each word of the vocabulary occurs over all documents: partial counts by task, then sums."""
    if not vocabulary:
        return {}
    wanted = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = wanted.value, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(filter(words.__contains__, words_of(text)))
        yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(lean(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in rows.collect()}  # no more rows than the block's vocabulary


def prefix_index(windows: dict[tuple, set], counts: dict[bytes, int]) -> dict[bytes, list]:
    """By its rarest word (ties: the first in byte order, then in place): a window, that word's place, its items."""
    index: dict[bytes, list] = {}
    for window, items in windows.items():
        place = min(range(len(window)), key=lambda i: (counts.get(window[i], 0), window[i], i))
        index.setdefault(window[place], []).append((list(window), place, sorted(x for x in items if x is not None)))
    return index


def hits(words: list[bytes], index: dict[bytes, list]) -> tuple[list[tuple[int, int]], set]:
    """Spans of words that equal a window, and the items they belong to."""
    spans, items = set(), set()
    for at in [i for i, w in enumerate(words) if w in index]:
        for window, place, owners in index[words[at]]:
            start = at - place
            if start >= 0 and start + len(window) <= len(words) and words[start : start + len(window)] == window:
                spans.add((start, start + len(window)))
                items.update(owners)
    return sorted(spans), items


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as disjoint spans in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[tuple], bool]]:
    """Items in blocks of bounded size, and whether the block is the last; only one block is on the driver at a time.

    An item's block is a hash of its id and text; a single text longer than a block is a block of its own, as
    its windows overlap and cannot be parted.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0].n or 0
    n = -(-2 * total // block_bytes) if total > block_bytes else 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in part.collect()], k == n - 1


def find_hits(docs: DataFrame, windows: dict[tuple, set], keep: tuple[str, ...] | None = None) -> DataFrame:
    """The rows with their hits of this block added to those of blocks before: HITS behind the other columns.

    With `keep` (after the last block) only these columns and RESULT, made in the same pass, as a second one in the
    same tasks would take a second worker for each.
    """
    counts = rarity(docs, {w for window in windows for w in window})
    shared = docs.sparkSession.sparkContext.broadcast(prefix_index(windows, counts))
    names = [f.name for f in HITS]
    own = [c for c in docs.columns if c not in names]
    at, earlier = own.index("text"), names[1] in docs.columns
    put, fields = (own, HITS) if keep is None else (list(keep), RESULT)
    kinds = [pa.int64()] + [pa.list_(pa.int64())] * 3 if keep is None else [pa.int64()] * 3 + [pa.string(), pa.bool_()]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            before = zip(*(batch.column(len(own) + i).to_pylist() for i in (1, 2, 3)), strict=True) if earlier else None
            rows = []
            for text in batch.column(at).to_pylist():
                words = words_of(text)
                spans, items = hits(words, index)
                if before is not None:
                    starts, ends, found = next(before)
                    spans, items = spans + list(zip(starts, ends, strict=True)), items | set(found)
                spans = joined(spans)
                if keep is None:
                    rows.append((len(words), [a for a, _ in spans], [b for _, b in spans], sorted(items)))
                else:
                    ids, hit = sorted(map(str, items)), sum(b - a for a, b in spans)
                    rows.append((len(words), hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
            made = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * len(kinds), kinds, strict=True)]
            yield pa.record_batch([*(batch.column(own.index(c)) for c in put), *made], names=[*put, *(f.name for f in fields)])

    return docs.mapInArrow(lean(match), T.StructType([*(docs.schema[c] for c in put), *fields]))


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns `keep` of each document row, and RESULT: its words, those inside any window's occurrence, the items."""
    prepare(docs.sparkSession)
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    for k, (block, last) in enumerate(blocks_of(benchmark, block_bytes)):
        rows = find_hits(stored(rows, "hits") if k else rows, windows_of(block, size), keep if last else None)
    return rows


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw USING (n, s)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN owners USING (doc_id)
"""
