"""Trigger detection, its counts, and the content type they speak for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import CONTENT_TYPES, FAMILIES, Family
from . import timeline


def detect(segments: DataFrame, families: tuple[Family, ...]) -> DataFrame:
    """One row for each segment and family that matches; one pass over the segments for all families."""
    low = F.lower("text")
    hits = [
        F.when(
            low.rlike(f.pattern),
            F.struct(
                F.lit(i).alias("rank"), F.lit(f.trigger).alias("trigger_type"), F.lit(f.confidence).alias("confidence"),
                F.lit(f.content).alias("content"), F.substring(low if f.lower_context else F.col("text"), 1, f.context).alias("context"),
            ),
        )
        for i, f in enumerate(families)
    ]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return segments.select("video_id", "seg_idx", F.col("start").alias("timestamp"), F.explode(found).alias("t")).select("video_id", "seg_idx", "timestamp", "t.*")


def families_of(content: str) -> tuple[Family, ...]:
    return tuple(f for f in FAMILIES if f.content == content)


def trigger_counts(triggers: DataFrame) -> DataFrame:
    return triggers.groupBy("video_id", "trigger_type").agg(F.count("*").alias("triggers"))


def content_type(merged_segments: DataFrame, families: tuple[Family, ...] | None = None) -> DataFrame:
    """The content type with the most triggers of each item; ties and items without any by CONTENT_TYPES' order."""
    families = families or tuple(f for f in FAMILIES if f.content in CONTENT_TYPES)
    low = F.lower("text")
    total = lambda c: sum((F.sum(low.rlike(f.pattern).cast("long")) for f in families if f.content == c), F.lit(0))
    totals = merged_segments.groupBy("video_id").agg(*(total(c).cast("long").alias(c) for c in CONTENT_TYPES))
    most = F.greatest(*CONTENT_TYPES)
    pick = F.when(F.col(CONTENT_TYPES[0]) == most, CONTENT_TYPES[0]).when(F.col(CONTENT_TYPES[1]) == most, CONTENT_TYPES[1]).otherwise(CONTENT_TYPES[2])
    return totals.select("video_id", pick.alias("content_type"), most.alias("triggers"), *CONTENT_TYPES)


def analyzed(segments: DataFrame, content: str) -> DataFrame:
    """What each item's merged segments say as a podcast, lecture or tutorial: triggers in order of time, and how far merging went."""
    joined = timeline.merged(segments)
    found = detect(joined, families_of(content)).select("video_id", F.struct("timestamp", "rank", "seg_idx", "trigger_type", "confidence", "context").alias("t"))
    listed = found.groupBy("video_id").agg(F.array_sort(F.collect_list("t")).alias("triggers"))  # of one item
    sizes = joined.groupBy("video_id").agg(F.count("*").alias("merged_segments"), F.sum("n_originals").alias("raw_segments"))
    none = F.array().cast(listed.schema["triggers"].dataType)
    ratio = F.when(F.col("merged_segments") > 0, F.col("raw_segments") / F.col("merged_segments")).otherwise(F.lit(0.0))
    return sizes.join(listed, "video_id", "left").select(
        "video_id", F.lit(content).alias("content_type"), "merged_segments", "raw_segments", ratio.alias("compression_ratio"), F.coalesce("triggers", none).alias("triggers")
    )


def best_frames(segments: DataFrame, most: int) -> DataFrame:
    """The surest triggers of each item, of those that its best content type knows."""
    joined = timeline.merged(segments)
    families = tuple(f for f in FAMILIES if f.content in CONTENT_TYPES)
    best = content_type(joined, families).select("video_id", "content_type")
    found = detect(joined, families).join(best, "video_id").where("content = content_type")
    return timeline.top_frames(found, most)
