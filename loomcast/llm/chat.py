"""Chat formatting by token-level assembly.

Every segment (role, text) is encoded by itself, so no token spans a boundary; reserved ids, which no text can
produce, are spliced between segments.  Masks are prefix sums of marks at segment borders.  Control strings that occur
in content are broken up by an escape character, reversibly, so that the rendered template cannot be forged.

    BOS  (TURN role ROLE_END text TURN_END)*

Turns are formatted where they lie, one row each, so a conversation of any length never has to fit one task; the order
of a conversation is its rows by turn (ties: by role, then text).  Reading back streams sorted rows and keeps only
running digests.

Defined results: null role or text is the empty string; a null conv_id is a conversation of its own; repeated rows are
repeated turns; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, read_table

ESCAPE = "␛"
#: Strings that templates use for control, in content: the second character never is the escape itself.
CONTROL = re.compile(r"</?s>|\[/?INST\]|<</?SYS>>|<\|[^|<>]{1,40}\|>|</?(?:turn|role)>")
#: Reserved ids lie behind the vocabulary; their rendered forms are control strings.
BOS, TURN, ROLE_END, TURN_END = range(4)
RENDERED = ("<s>", "<turn>", "<role>", "</turn>")

TOKENS = "conv_id long, turn long, tie long, role_key string, ids binary, mask binary, formatted_chars long"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_LOADED: dict = {}


def escaped(text: str) -> str:
    """Double the escape character, then break every control string behind its first character."""
    text = text.replace(ESCAPE, ESCAPE * 2)
    return CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescaped(text: str) -> str:
    return re.sub(f"{ESCAPE}({ESCAPE}?)", r"\1", text)


def tokenizer(path: str):
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
        _LOADED[path].encode_special_tokens = True  # a special token's string in a text is text
    return _LOADED[path]


def assemble(role: np.ndarray, text: np.ndarray, first: int, learn: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of one turn and its loss mask: marks of +1 and -1 at the text's borders, summed along the turn."""
    ids = np.concatenate([[first + TURN], role, [first + ROLE_END], text, [first + TURN_END]]).astype("<u4")
    marks = np.zeros(len(ids) + 1, np.int8)
    if learn:
        marks[len(role) + 2] += 1
        marks[len(role) + 2 + len(text)] -= 1
    return ids, np.cumsum(marks[:-1]).astype(np.uint8)


def format_turns(turns: DataFrame, tokenizer_path: str, learned: str = "assistant") -> DataFrame:
    """One row per turn: token ids (uint32, little-endian) and loss mask; only `learned` texts are under the mask."""
    prepare(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(tokenizer_path)
        first = coder.get_vocab_size()
        for batch in batches:
            conv, turn, roles, texts = (batch.column(i).to_pylist() for i in range(4))
            safe = [escaped(t) for t in texts]
            names = [escaped(r) for r in roles]
            encoded = coder.encode_batch_fast(safe + names, add_special_tokens=False)
            ids, masks, chars = [], [], []
            for i, role in enumerate(roles):
                one, mask = assemble(encoded[len(safe) + i].ids, encoded[i].ids, first, role == learned)
                ids.append(one.tobytes())
                masks.append(np.packbits(mask).tobytes())
                chars.append(len(safe[i]) + len(names[i]) + sum(map(len, RENDERED[1:])))
            ties = [int.from_bytes(t.encode("utf-8", "surrogatepass")[:7].ljust(7, b"\0"), "big") for t in texts]
            yield pa.record_batch(
                [pa.array(conv, pa.int64()), pa.array(turn, pa.int64()), pa.array(ties, pa.int64()), pa.array(roles, pa.string()), pa.array(ids, pa.binary()), pa.array(masks, pa.binary()), pa.array(chars, pa.int64())],
                names=[x.split()[0] for x in TOKENS.split(", ")],
            )

    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    return rows.mapInArrow(run, TOKENS)


def parse_turn(ids: np.ndarray, mask: np.ndarray, first: int) -> tuple[list[int], list[int], list[int]]:
    """Role ids, text ids and ids under the mask of one formatted turn."""
    at = np.flatnonzero(ids >= first)
    if [int(ids[i]) - first for i in at] != [TURN, ROLE_END, TURN_END]:
        raise ValueError("not a formatted turn")
    return ids[at[0] + 1 : at[1]].tolist(), ids[at[1] + 1 : at[2]].tolist(), ids[mask.astype(bool)].tolist()


def read_back(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Decode formatted turns again: per conversation, digests of its turns and of all text under the mask."""
    prepare(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(tokenizer_path)
        first = coder.get_vocab_size()
        state = None
        rows: list[tuple] = []

        def close() -> None:
            conv, n, turns, chars, loss, rendered = state
            rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), rendered + len(RENDERED[BOS])))

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

        for batch in batches:
            conv, ids, masks, chars = (batch.column(i).to_pylist() for i in range(4))
            parts = []
            for one, mask in zip(ids, masks, strict=True):
                one = np.frombuffer(one, "<u4")
                parts += parse_turn(one, np.unpackbits(np.frombuffer(mask, np.uint8))[: len(one)], first)
            texts = [unescaped(t) for t in coder.decode_batch(parts, skip_special_tokens=False)]
            for i, key in enumerate(conv):
                if state is None or state[0] != key:
                    if state is not None:
                        close()
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, loss = texts[3 * i : 3 * i + 3]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[3] += len(loss)
                state[4].update(loss.encode("utf-8", "surrogatepass"))
                state[5] += chars[i]
            if len(rows) >= 4096:
                yield flush()
        if state is not None:
            close()
        if rows:
            yield flush()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role_key", "tie", "ids")
    return ordered.select("conv_id", "ids", "mask", "formatted_chars").mapInArrow(run, READ)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table and conversation -1, whose two texts are made of control strings."""
    probe = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id long, turn long, role string, text string",
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = with_probe(read_table(spark, sf_dir, "conversations"))
    return read_back(format_turns(turns, default_tokenizer()), default_tokenizer())


_CONTROL_SQL = r"</?s>|\[/?INST\]|<</?SYS>>|<\|[^|<>]{1,40}\|>|</?(?:turn|role)>"
_CHARS_SQL = (
    f"(2 * length(COL) - length(replace(COL, '{ESCAPE}', ''))"
    f" + len(regexp_extract_all(replace(COL, '{ESCAPE}', '{ESCAPE}{ESCAPE}'), '{_CONTROL_SQL}')))"
)
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_CHARS_SQL.replace("COL", "role")} + {_CHARS_SQL.replace("COL", "text")} + {sum(map(len, RENDERED[1:]))}) + {len(RENDERED[BOS])} AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
