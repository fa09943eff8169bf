"""Hierarchical multi-length packing of tokenised documents.

Documents are routed to context-size tiers, each tier is packed into sequences of its own length, gaps in long
windows are filled from shorter tiers, and finished sequences are dealt to step groups of equal token counts.
Each task packs its own rows in one pass, so nothing is shuffled and memory is bounded by one packing window.

Defined results: a null or empty text is the single end id; repeated doc_ids are separate documents; an empty
table gives no pieces; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, lean, prepare, read_table, text_or_empty

LENGTH = 2048
#: Sequence lengths below the full one; each is a power of two, so such a sequence needs no padding.
TIERS = (64, 128, 256, 512, 1024, 2048)
END_ID = 1
#: Tokens gathered before a round of packing; what does not fill a sequence is carried to the next round.
WINDOW_TOKENS = 1 << 20
#: Tokens in one step group.
STEP_TOKENS = 8 * LENGTH
#: Distinct blank-separated chunks whose ids a worker remembers before it starts anew.
CACHE_CHUNKS = 700_000

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, tier int, step_group long"
)
IDS_SCHEMA = SCHEMA + ", ids binary"

_ENCODERS: dict[str, "ChunkEncoder"] = {}


class ChunkEncoder:
    """Ids of whole texts from a vocabulary whose pieces never cross white space.

    The text is cut at blanks and newlines, which the vocabulary's own normaliser treats as separators, and every
    distinct chunk is encoded once; ids of a text are the chunks' ids joined.  A chunk of Latin letters, with or
    without a final stop or comma, goes straight to the tokenizer's model: its normaliser only lower-cases such
    letters and its splitter keeps them together.  Everything else takes the tokenizer's whole way.  A vocabulary that
    encodes PROBES otherwise is not of that kind, and then whole texts take that way.
    """

    PROBES = ("Two Words. And, more\nÉtés  of them", " ", "x Y", "don't ÀÖ 12,3 \n\n q", "Ab.Cd eF, gh.")
    PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]?)")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism here
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.marks = {m: as_bytes(self.tokenizer.encode(m, add_special_tokens=False).ids) for m in ("", ".", ",")}
        # byte-level vocabularies write a byte as itself if printable, and else as a code point from 256 on
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in seen]
        self.written = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.whole = False
        self.clear()
        try:
            same = [x.tolist() for x in self.encode(list(self.PROBES))] == [x.tolist() for x in self.plainly(list(self.PROBES))]
        except (KeyError, ValueError):  # pieces that the model alone cannot read
            same = False
        self.whole = not same
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.cores: dict[str, bytes] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def learn(self, chunks: list[str]) -> None:
        ids: list = [None] * len(chunks)
        other = []
        for i, chunk in enumerate(chunks):
            plain = self.PLAIN.fullmatch(chunk)
            if plain is None:
                other.append(i)
                continue
            core = plain[1].lower()
            found = self.cores.get(core)
            if found is None:
                text = core if core.isascii() else "".join(map(self.written.__getitem__, core.encode()))
                found = self.cores[core] = as_bytes([x.id for x in self.model.tokenize(text)])
            ids[i] = found + self.marks[plain[2]]
        made = self.tokenizer.encode_batch_fast([chunks[i] for i in other], add_special_tokens=False)
        for i, one in zip(other, made, strict=True):
            ids[i] = as_bytes(one.ids)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at, total = len(self.known), int(sizes.sum())
        self.flat = grown(self.flat, self.used + total)
        self.begin, self.size = grown(self.begin, at + len(ids)), grown(self.size, at + len(ids))
        self.flat[self.used : self.used + total] = np.frombuffer(b"".join(ids), np.uint32)
        self.size[at : at + len(ids)] = sizes
        self.begin[at : at + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.known.update(zip(chunks, range(at, at + len(ids)), strict=True))
        self.used += total

    def plainly(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.whole:
            return self.plainly(texts)
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > CACHE_CHUNKS:
            self.clear()
        new = {c for chunks in split for c in chunks if c not in self.known}
        if new:
            self.learn(list(new))
        known, out = self.known.__getitem__, []
        for chunks in split:
            at = np.fromiter(map(known, chunks), np.int64, len(chunks))
            size = self.size[at]
            ends = np.cumsum(size)
            steps = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[at] - (ends - size), size)
            out.append(self.flat[steps])
        return out


def as_bytes(ids: list[int]) -> bytes:
    """Ids as unsigned 32-bit numbers; a third of the memory of a list."""
    return array("I", ids).tobytes()


def grown(held: np.ndarray, size: int) -> np.ndarray:
    """The array with room for `size` entries, doubled so that growth stays cheap."""
    return held if len(held) >= size else np.concatenate([held, np.zeros(max(size - len(held), len(held)), held.dtype)])


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
        hold("packing", _ENCODERS.clear)
    return _ENCODERS[path]


class Packer:
    """Packs the pieces of one task; `emit` gets (sequence number, tier, step group, pieces) for each sequence."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers = tuple(sorted(tiers))
        self.full = self.tiers[-1]
        self.pools: dict[int, deque] = {t: deque() for t in self.tiers}
        self.held = 0
        self.made = 0
        self.step_tokens = step_tokens
        self.groups: dict[int, list[int]] = {}
        self.next_group = 0

    def add(self, doc, tokens: int) -> Iterator[tuple]:
        """Full windows of a long document leave at once; the rest waits in the tier that just holds it."""
        start = 0
        while tokens - start >= self.full:
            yield self._sequence(self.full, [(doc, start, self.full)])
            start += self.full
        if tokens > start:
            self._put((doc, start, tokens - start))
            self.held += tokens - start

    def _put(self, piece) -> None:
        self.pools[next(t for t in self.tiers if t >= piece[2])].append(piece)

    def _fill(self, pieces: list, gap: int, below: int) -> int:
        """Fill a gap from the tiers under `below`, longest first, then from `below` itself; the last is cut."""
        for tier in [t for t in reversed(self.tiers) if t < below] + [below]:
            pool = self.pools[tier]
            while gap and pool:
                doc, start, n = pool.popleft()
                take = min(n, gap)
                pieces.append((doc, start, take))
                gap -= take
                if take < n:
                    self._put((doc, start + take, n - take))
            if not gap:
                break
        return gap

    def drain(self, last: bool = False) -> Iterator[tuple]:
        """Pack what is held, longest tier first; what cannot fill a sequence of its tier stays for later."""
        for tier in reversed(self.tiers):
            while (pool := self.pools[tier]) and sum_at_least(self.pools, self.tiers, tier):
                pieces = [pool.popleft()]
                gap = self._fill(pieces, tier - pieces[0][2], tier)
                assert gap == 0
                yield self._sequence(tier, pieces)
        if last:
            rest = [p for t in reversed(self.tiers) for p in self.pools[t]]
            for t in self.tiers:
                self.pools[t].clear()
            total = sum(p[2] for p in rest)
            queue = deque(rest)
            for tier in reversed(self.tiers):
                while total >= tier:
                    yield self._sequence(tier, cut(queue, tier))
                    total -= tier
            if total:
                yield self._sequence(self.full, cut(queue, total))
        self.held = sum(p[2] for t in self.tiers for p in self.pools[t])

    def _sequence(self, tier: int, pieces: list) -> tuple:
        number, self.made = self.made, self.made + 1
        # sizes are powers of two, so a group that has room for a tier is filled exactly by further ones
        group = next((g for g, left in self.groups.items() if left >= tier), None)
        if group is None:
            group, self.next_group = self.next_group, self.next_group + 1
            self.groups[group] = self.step_tokens
        self.groups[group] -= tier
        if not self.groups[group]:
            del self.groups[group]
        return number, tier, group, pieces


def sum_at_least(pools: dict, tiers: tuple, tier: int) -> bool:
    """Whether this tier and the shorter ones hold enough tokens to fill one sequence of the tier."""
    total = 0
    for t in tiers:
        if t > tier:
            break
        for piece in pools[t]:
            total += piece[2]
            if total >= tier:
                return True
    return False


def cut(queue: deque, size: int) -> list:
    pieces = []
    while size:
        doc, start, n = queue.popleft()
        take = min(n, size)
        pieces.append((doc, start, take))
        if take < n:
            queue.appendleft((doc, start + take, n - take))
        size -= take
    return pieces


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    step_tokens: int = STEP_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: where its ids lie in their document and in their sequence (`with_ids`: the ids too)."""
    prepare(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 32
        packer, coder = Packer(tiers, step_tokens), encoder(tokenizer_path)
        rows: list[tuple] = []

        def note(made) -> None:
            for number, tier, group, pieces in made:
                offset = 0
                for (doc_id, ids), start, n in pieces:
                    part = ids[start : start + n].astype("<u4").tobytes()
                    row = (doc_id, start, n, zlib.crc32(part), len(ids), base + number, offset, tier, base + group)
                    rows.append(row + (part,) if with_ids else row)
                    offset += n

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + [pa.binary()] * with_ids
            batch = pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=[x.split()[0] for x in (IDS_SCHEMA if with_ids else SCHEMA).split(", ")],
            )
            rows.clear()
            return batch

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(keys), 64):
                for key, ids in zip(keys[at : at + 64], coder.encode(texts[at : at + 64]), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    note(packer.add((key, ids), len(ids)))
                    if packer.held >= WINDOW_TOKENS:
                        note(packer.drain())
            if len(rows) >= 4096:
                yield flush()
        note(packer.drain(last=True))
        if rows:
            yield flush()

    return docs.select("doc_id", text_or_empty()).mapInArrow(lean(pack, "packing"), IDS_SCHEMA if with_ids else SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), default_tokenizer()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"
    )


def padding(pieces: DataFrame) -> DataFrame:
    """Tokens and padding over all sequences, for reports."""
    sizes = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    full = F.when(F.pmod(F.log2("n"), F.lit(1.0)) == 0, F.col("n")).otherwise(F.lit(LENGTH))
    return sizes.agg(F.sum("n").alias("tokens"), F.sum(full - F.col("n")).alias("padding"), F.count("*").alias("sequences"))
