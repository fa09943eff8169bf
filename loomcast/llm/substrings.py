"""Exact substring dedup over a sampled suffix array.

A byte is removed if a 50-byte string that covers it also starts in a document with a smaller doc_id.  Sorting every
suffix would move each byte fifty times, so suffixes are sampled by content: of every 50-byte window the suffix at its
least 16-byte token (by hash, leftmost) is kept, which equal windows agree on.  A kept suffix travels with the stretch
of text whose windows chose it (at most 84 bytes).

  1. splitters from a bounded sample of suffixes range-partition all suffixes by their leading 16 bytes;
  2. buckets sort locally by multikey quicksort over 8-byte tokens (deeper tokens only where earlier ones tie);
  3. equal stretches give way to the least doc_id; where one token heads different stretches, their windows are
     compared one by one, exactly.

Equal stretches of one batch are reduced to that of least doc_id before the shuffle, so a passage that a third of all
documents share sends one record per batch, not per document; the batch settles the others itself.  All suffixes with
one leading token lie in one bucket, so nothing is left to compare across boundaries; tokens that the sample shows to
be frequent are chosen last, so that edges of common passages, which differ from document to document, hang on other
tokens.

Defined results: null text: no bytes; a null doc_id neither loses bytes nor causes a loss; rows that share a doc_id
do not affect each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, prepare, read_table, stored
from .packed import SCHEMA, batch_of, dealt, dump, exchange, load

WINDOW, TOKEN = 50, 16
SPAN = WINDOW - TOKEN + 1  # tokens in a window
LEFT = SPAN - 1  # bytes that a stretch can have before its token
WIDTH = LEFT + WINDOW
#: Text whose suffixes the splitters are taken from.
SAMPLE_BYTES = 8 << 20
#: Text for each bucket of suffixes and for each bucket of documents.
SUFFIX_TEXT, DOC_TEXT = 6 << 20, 16 << 20
CHUNK = 1 << 20

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def token_hash(data: np.ndarray, n: int) -> np.ndarray:
    """A 32-bit hash of the token at each of n positions of a padded byte array."""
    word = np.ndarray((n + 8,), "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        h = word[:n] * np.uint64(0x9E3779B97F4A7C15) ^ word[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def stretches(texts: list[bytes], frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each kept suffix: its text's index, start of its first window, bytes left of its token, windows, stretch."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(size) - size
    n = int(size.sum())
    data = np.zeros(LEFT + n + WIDTH + 16, np.uint8)
    data[LEFT : LEFT + n] = np.frombuffer(b"".join(texts), np.uint8)
    windows = np.maximum(size - WINDOW + 1, 0)
    total = int(windows.sum())
    empty = np.zeros(0, np.int64)
    if not total:
        return empty, empty, empty.astype(np.uint8), empty.astype(np.uint8), np.zeros((0, WIDTH), np.uint8)
    h = token_hash(data[LEFT:], n)
    rank = h >> np.uint64(33)
    if len(frequent):
        at = np.searchsorted(frequent, h)
        rank |= (frequent[np.minimum(at, len(frequent) - 1)] == h).astype(np.uint64) << np.uint64(31)
    least = (rank << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: -(SPAN - width)], least[SPAN - width :])
    owner = np.repeat(np.arange(len(texts)), windows)
    first = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(start, windows)
    token = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    count = np.diff(np.r_[head, total])
    token, low, owner = token[head], first[head], owner[head]
    left = token - low
    rows = np.lib.stride_tricks.sliding_window_view(data, WIDTH)[token]  # data starts LEFT bytes before the texts
    place = np.arange(WIDTH)
    outside = (place < (LEFT - left)[:, None]) | (place >= (LEFT - left + count - 1 + WINDOW)[:, None])
    rows = np.where(outside, np.uint8(0), rows)
    return owner, low - start[owner], left.astype(np.uint8), count.astype(np.uint8), rows


def words(rows: np.ndarray, at: int, n: int = 8) -> np.ndarray:
    """Eight bytes of each row as one number in the order of the bytes."""
    part = np.zeros((len(rows), 8), np.uint8)
    got = rows[:, at : min(at + n, rows.shape[1])]
    part[:, : got.shape[1]] = got
    return part.view(">u8").ravel().astype(np.uint64)


def multikey(rows: np.ndarray, left: np.ndarray, count: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the suffixes, and in that order whether a leading token and whether a stretch begins.

    Tokens are compared level by level, and a level touches only rows that all earlier levels left tied.
    """
    n = len(rows)
    order = np.lexsort((doc,))
    new = np.zeros(n, bool)
    new[:1] = True
    lead = None
    for level, at in enumerate([*range(LEFT, WIDTH, 8), *range(0, LEFT, 8), -1]):
        begin = np.flatnonzero(new)
        size = np.diff(np.r_[begin, n])
        run = np.repeat(np.arange(len(begin)), size)
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if len(tied):
            who = order[tied]
            if at < 0:
                key = left[who].astype(np.uint64) << np.uint64(8) | count[who]
            else:
                key = words(rows[who], at, 8 if at >= LEFT else min(8, LEFT - at))
            sub = np.lexsort((key, run[tied]))  # stable: rows of one key stay by doc_id
            order[tied] = who[sub]
            key = key[sub]
            new[tied[1:]] |= key[1:] != key[:-1]
        if level == 1:
            lead = new.copy()
    return order, lead if lead is not None else new, new


def window_hashes(rows: np.ndarray, left: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of every stretch: the row, the window's number in it, and a hash of its 50 bytes."""
    base = np.uint64(0x9E3779B97F4A7C15 | 1)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(WIDTH, base)], dtype=np.uint64)
        back = np.cumprod(np.r_[np.uint64(1), np.full(WIDTH, inverse)], dtype=np.uint64)
        sums = np.zeros((len(rows), WIDTH + 1), np.uint64)
        np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * power[:WIDTH], axis=1, out=sums[:, 1:])
        who = np.repeat(np.arange(len(rows)), count)
        number = np.arange(len(who)) - np.repeat(np.cumsum(count.astype(np.int64)) - count, count)
        at = LEFT - left.astype(np.int64)[who] + number
        return who, number, mix64((sums[who, at + WINDOW] - sums[who, at]) * back[at])


def settle(doc: np.ndarray, pos: np.ndarray, left: np.ndarray, count: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Removed stretches as (record, start, end) from all suffixes of a bucket."""
    order, lead, new = multikey(rows, left, count, doc)
    run = np.cumsum(new) - 1
    least = doc[order][np.flatnonzero(new)][run]
    later = doc[order] > least
    gone = order[later]
    out = [(gone, pos[gone], pos[gone] + count[gone] - 1 + WINDOW)]
    # where a token heads several stretches, the first of each is compared window by window
    token = np.cumsum(lead) - 1
    several = (np.bincount(token, weights=new)[token] > 1) if len(token) else np.zeros(0, bool)
    keep = several & ~later
    heads, token = order[keep], token[keep]
    cuts = [0]
    while cuts[-1] < len(heads):  # whole tokens at a time, so that memory stays bounded
        end = min(cuts[-1] + 60_000, len(heads))
        end = len(heads) if end == len(heads) else int(np.searchsorted(token, token[end], "left"))
        cuts.append(end if end > cuts[-1] else int(np.searchsorted(token, token[cuts[-1]], "right")))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = heads[a:b]
        mine, l, c, d = rows[part], left[part], count[part], doc[part]
        who, number, h = window_hashes(mine, l, c)
        offset = LEFT - l.astype(np.int64)[who] + number
        with np.errstate(over="ignore"):
            key = mix64(h + token[a:b].astype(np.uint64)[who] * np.uint64(0xD6E8FEB86659FD93) + offset.astype(np.uint64))
        by = np.lexsort((d[who], key))
        key, w = key[by], who[by]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        source = first[np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1]
        hit = np.flatnonzero(d[w] > d[w[source]])
        if not len(hit):
            continue
        view = np.lib.stride_tricks.sliding_window_view(mine, WINDOW, axis=1)
        same = np.concatenate([
            (view[w[x], offset[by[x]]] == view[w[source[x]], offset[by[source[x]]]]).all(1)
            for x in np.array_split(hit, len(hit) // 100_000 + 1)
        ])
        hit = hit[same]
        rec, num = part[w[hit]], number[by[hit]]
        out.append((rec, pos[rec] + num, pos[rec] + num + WINDOW))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def joined(who: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each owner as maximal runs, in order."""
    if not len(who):
        return who, start, end
    order = np.lexsort((start, who))
    who, start, end = who[order], start[order], end[order]
    own = np.r_[True, who[1:] != who[:-1]]
    shift = (np.cumsum(own) - 1) * (int(end.max()) + 2)  # owners apart, so that one running maximum serves all
    reach = np.maximum.accumulate(end + shift)
    first = np.r_[True, (start + shift)[1:] > reach[:-1]]
    at = np.flatnonzero(first)
    last = np.r_[at[1:], len(who)] - 1
    return who[at], start[at], reach[last] - shift[at]


def bucket_of(lead: tuple[np.ndarray, np.ndarray], splitters: np.ndarray) -> np.ndarray:
    """The range that the two leading words fall in; splitters are rows of two words in order."""
    low = np.searchsorted(splitters[:, 0], lead[0], "left")
    high = np.searchsorted(splitters[:, 0], lead[0], "right")
    for i in np.flatnonzero(low < high):
        low[i] += np.searchsorted(splitters[low[i] : high[i], 1], lead[1][i], "right")
    return low.astype(np.int32)


def mark_of(text: bytes) -> int:
    """A hash that tells the texts of rows with one doc_id apart."""
    return xxhash.xxh32_intdigest(text)


def encoded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHUNK:
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


def splitters_of(docs: DataFrame, total: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Splitters of equal shares of the sampled suffixes, and hashes of the tokens that fill a share by themselves."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in batches:
            texts = encoded(batch.column(1))
            for a, b in chunks(texts):
                rows = stretches(texts[a:b], none)[4]
                yield pa.record_batch([pa.array(words(rows, LEFT).view(np.int64)), pa.array(words(rows, LEFT + 8).view(np.int64))], names=["a", "b"])

    part = docs.sample(fraction=min(1.0, SAMPLE_BYTES / max(1, total)), seed=7)
    got = part.mapInArrow(sample, "a long, b long").toPandas().to_numpy(np.int64).view(np.uint64)
    got = got[np.lexsort((got[:, 1], got[:, 0]))] if len(got) else got.reshape(0, 2)
    picks = (np.arange(1, buckets) * len(got)) // buckets
    first = np.flatnonzero(np.r_[True, (got[1:] != got[:-1]).any(1)]) if len(got) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(got)])
    often = got[first[size > max(8, len(got) // (4 * buckets))]]
    raw = np.ascontiguousarray(often).astype(">u8").view(np.uint8).reshape(-1, TOKEN)
    hashes = np.array([token_hash(np.r_[r, np.zeros(16, np.uint8)], 1)[0] for r in raw], np.uint64)
    return got[picks] if len(got) else got, np.sort(hashes)


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """Documents and what remains of them, as RESULT says."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0].n or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    suffix_buckets, doc_buckets = max(parts, total // SUFFIX_TEXT), max(parts, total // DOC_TEXT)
    splitters, frequent = splitters_of(docs, total, suffix_buckets)
    shared = spark.sparkContext.broadcast((splitters, frequent))  # at most a row for each bucket

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits, often = shared.value
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids, texts = batch.column(0).to_numpy(), encoded(batch.column(1))
            if not len(texts):
                continue
            marks = np.fromiter(map(mark_of, texts), np.int64, len(texts))
            got = [(a + s[0], *s[1:]) for a, b in chunks(texts) for s in [stretches(texts[a:b], often)]]
            owner, pos, left, count, rows = (np.concatenate(x) for x in zip(*got, strict=True))
            if not len(owner):
                continue
            doc = ids[owner]
            padded = np.zeros((len(rows), 96), np.uint8)
            padded[:, :WIDTH] = rows
            padded[:, WIDTH], padded[:, WIDTH + 1] = left, count
            h = np.zeros(len(rows), np.uint64)
            with np.errstate(over="ignore"):
                for w in padded.view("<u8").T:
                    h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(32)
            order = np.lexsort((doc, h))
            new = np.r_[True, h[order][1:] != h[order][:-1]]
            head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            done = (doc[order] > doc[head]) & (padded[order] == padded[head]).all(1)
            gone, sent = order[done], np.sort(order[~done])
            if len(gone):
                who, s, e = joined(owner[gone], pos[gone], pos[gone] + count[gone] - 1 + WINDOW)
                yield batch_of([(int(who[0]) % suffix_buckets, dump(ids[who], marks[who], s, e))])
            where = bucket_of((words(rows[sent], LEFT), words(rows[sent], LEFT + 8)), splits)
            yield dealt(where, [doc[sent], marks[owner[sent]], pos[sent], left[sent], count[sent], rows[sent]], level=3)

    def address(ids, marks, start, end) -> pa.RecordBatch:
        return dealt((mix64(ids.view(np.uint64)) % np.uint64(doc_buckets)).astype(np.int32), [ids, marks, start, end])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ready = [], []
        for batch in batches:
            for payload in batch.column(1).to_pylist():
                got = load(payload)
                (ready if len(got) == 4 else found).append(got)
        if found:
            doc, mark, pos, left, count, rows = (np.concatenate(x) for x in zip(*found, strict=True))
            del found
            rec, start, end = settle(doc, pos, left, count, rows)
            ready.append([doc[rec], mark[rec], start, end])
        if ready:
            yield address(*(np.concatenate(x) for x in zip(*ready, strict=True)))

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array([-(2**63) if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            known = np.array(batch.column(0).is_valid().to_pylist(), bool)
            texts = encoded(batch.column(1))
            where = (mix64(ids.view(np.uint64)) % np.uint64(doc_buckets)).astype(np.int64)
            rows = []
            for b in np.unique(where):
                mine = np.flatnonzero(where == b)
                data = np.frombuffer(b"".join(texts[i] for i in mine), np.uint8)
                rows.append((int(b), dump(ids[mine], known[mine], np.array([len(texts[i]) for i in mine]), data, np.zeros(1), level=3)))
            yield batch_of(rows)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, held = [], []
        for batch in batches:
            for payload in batch.column(1).to_pylist():
                got = load(payload)
                if len(got) == 4:
                    cuts.append(got)
                else:
                    held.append(payload)
        spans: dict[tuple, tuple] = {}
        if cuts:
            ids, marks, start, end = (np.concatenate(x) for x in zip(*cuts, strict=True))
            order = np.lexsort((marks, ids))
            new = np.r_[True, (ids[order][1:] != ids[order][:-1]) | (marks[order][1:] != marks[order][:-1])]
            who, s, e = joined(np.cumsum(new) - 1, start[order], end[order])
            heads = order[np.flatnonzero(new)]
            at = np.searchsorted(who, np.arange(len(heads) + 1))
            spans = {(int(ids[h]), int(marks[h])): (s[at[i] : at[i + 1]], e[at[i] : at[i + 1]]) for i, h in enumerate(heads)}
        for payload in held:
            ids, known, size, data, _ = load(payload)
            rows, at, raw = [], 0, data.tobytes()
            for doc, good, n in zip(ids.tolist(), known.tolist(), size.tolist(), strict=True):
                text = raw[at : at + n]
                at += n
                s, e = spans.get((doc, mark_of(text)), ((), ())) if good else ((), ())
                digest, last = hashlib.sha256(), 0
                for a, b in zip(s, e, strict=True):
                    digest.update(text[last:a])
                    last = b
                digest.update(text[last:])
                rows.append((doc if good else None, n, int(sum(e) - sum(s)), len(s), digest.hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    removed = exchange(docs.mapInArrow(send, SCHEMA), suffix_buckets).mapInArrow(meet, SCHEMA)
    removed = stored(removed, "removed")  # the suffixes leave the disk here, before the texts move
    both = docs.mapInArrow(texts_of, SCHEMA).unionByName(removed)
    return exchange(both, doc_buckets).mapInArrow(remove, RESULT)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY 1), r AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id > least),
g AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM r),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
spans AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM k GROUP BY doc_id, run),
cuts AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM spans),
parts AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(e - s) AS BIGINT) AS n_removed, max(e) AS last, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS kept
  FROM cuts JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN parts USING (doc_id)
"""
