"""Live capture as Structured Streaming: chunks, entity state, new pairs, and what a finished stream leaves."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

WINDOW = 30.0
WATERMARK = "60 seconds"
PAIRS = "video_id string, entity_a string, entity_b string, at double"


def chunk_counts(events: DataFrame, length: str = "30 seconds") -> DataFrame:
    """Tumbling chunks of event time: rows and words of each; chunks later than the watermark are closed."""
    return events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", length).alias("w"), "event_type").agg(
        F.count("*").alias("events"), F.sum("value").alias("total")
    ).select(F.col("w.start").alias("chunk_start"), "event_type", "events", "total")


def running_entities(mentions: DataFrame) -> DataFrame:
    """Entities so far: mentions, first and last time; for complete or update mode."""
    return mentions.groupBy("video_id", "entity_id").agg(F.count("*").alias("mention_count"), F.min("start").alias("first_seen"), F.max("start").alias("last_seen"))


def mentions_of(rows: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Times of all mentions in order, the number of each one's entity, and the entities."""
    number: dict[str, int] = {}
    times, entities = [np.zeros(0)], [np.zeros(0, np.int64)]
    for pdf in rows:
        own, names = pd.factorize(pdf["entity_id"])
        times.append(pdf["start"].to_numpy(float))
        entities.append(np.array([number.setdefault(n, len(number)) for n in names], np.int64)[own])
    time, entity = np.concatenate(times), np.concatenate(entities)
    order = np.argsort(time, kind="stable")
    return time[order], entity[order], list(number)


def met_within(time: np.ndarray, entity: np.ndarray) -> dict[tuple[int, int], float]:
    """Pairs of entities with mentions at most WINDOW apart, and the time of the first mention that completes each.

    Of one entity's mentions in a row the first meets what came before and the last what follows.  A mention looks back to
    the last one of its own entity, as what lies before that has met it then.
    """
    same = entity[1:] == entity[:-1]
    some = ~(np.r_[False, same] & np.r_[same, False]) if len(time) else np.zeros(0, bool)
    last: dict[int, float] = {}  # in order of time
    found: dict[tuple[int, int], float] = {}
    for at, e in zip(time[some].tolist(), entity[some].tolist(), strict=True):
        for other in reversed(last):
            if other == e or at - last[other] > WINDOW:
                break
            found.setdefault((e, other) if e < other else (other, e), at)
        last.pop(e, None)
        last[e] = at
    return found


def thinned(times: list[float], since: float) -> list[float]:
    """Of sorted times, few that are at most WINDOW from whatever those from `since` on are: none if there are none.

    Between two that are two windows apart or less, no other is needed.  One time before `since` stays, as it stands for later ones.
    """
    first = bisect_left(times, since)
    if first == len(times):
        return []
    at = max(0, first - 1)
    out = [times[at]]
    while at + 1 < len(times):
        at = max(at + 1, bisect_right(times, times[at] + 2 * WINDOW) - 1)
        out.append(times[at])
    return out


class NewPairs(StatefulProcessor):
    """Emits each pair of entities of an item once, when mentions of both come within WINDOW seconds.

    State: mentions of the last two windows, as far as thinned() needs them, and the pairs already emitted.  Rows of a batch
    are taken by time, so the result does not depend on their order within it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timeline = handle.getListState("timeline", "start double, entity_id string")
        pair = StructType([StructField("entity_a", StringType()), StructField("entity_b", StringType())])
        self.seen = handle.getMapState("seen", pair, "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        time, entity, names = mentions_of(rows)
        held: dict[str, list[float]] = {}
        for start, name in self.timeline.get():
            held.setdefault(name, []).append(start)
        found: dict[tuple[str, str], float] = {}

        def meet(a: str, b: str, at: float) -> None:
            pair = (min(a, b), max(a, b))
            found[pair] = min(at, found.get(pair, at))

        for (a, b), at in met_within(time, entity).items():
            meet(names[a], names[b], at)
        for name, starts in held.items():
            for s in starts:
                near = slice(np.searchsorted(time, s - WINDOW), np.searchsorted(time, s + WINDOW, "right"))
                for e, i in zip(*(x.tolist() for x in np.unique(entity[near], return_index=True)), strict=True):
                    if names[e] != name:
                        meet(names[e], name, float(time[near][i]))
        out = []
        for pair, at in sorted(found.items(), key=lambda x: (x[1], x[0])):
            if not self.seen.containsKey(pair):
                self.seen.updateValue(pair, (at,))
                out.append((key[0], *pair, at))
        since = float(time[-1]) - 2 * WINDOW
        tail = np.searchsorted(time, since)
        for e in np.unique(entity[tail:]).tolist():
            own = np.unique(time[tail:][entity[tail:] == e]).tolist()
            held[names[e]] = sorted({*held.get(names[e], []), *own})
        self.timeline.put([(s, name) for name, starts in held.items() for s in thinned(sorted(starts), since)])
        yield pd.DataFrame(out, columns=["video_id", "entity_a", "entity_b", "at"])

    def close(self) -> None:
        pass


def new_pairs(mentions: DataFrame) -> DataFrame:
    """Pairs as they first occur, from streaming (video_id, entity_id, start); needs the RocksDB state store.

    Mentions without an item, entity or finite time are near no other.
    """
    rows = mentions.select(F.col("video_id").cast("string").alias("video_id"), "entity_id", "start")
    rows = rows.where("video_id is not null and entity_id is not null and abs(start) < double('infinity')")
    return rows.groupBy("video_id").transformWithStateInPandas(NewPairs(), PAIRS, "append", "none")


def appended(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to a table once and only once; what is there at the start is worked off, then it ends."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def upserted(stream: DataFrame, path: str, checkpoint: str):
    """Write each batch to its own folder by batch number: a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def recent_events(history: DataFrame, event_type: str | None = None, most: int = 100) -> DataFrame:
    """The last `most` events, of one kind if asked; events of one time by their id."""
    last = history.orderBy(F.desc("ts"), F.desc("event_id")).limit(most)
    return last if event_type is None else last.where(F.col("event_type") == event_type)


def stream_id(url, started):
    """LIVE_, the time it started, and eight characters of its address's hash."""
    return F.concat(F.lit("LIVE_"), F.date_format(started, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(F.md5(url), 1, 8))


def chunk_number(name):
    """The number in a chunk's file name, as chunk_0012."""
    return F.regexp_extract(name, r"chunk_(\d+)", 1).cast("int")
