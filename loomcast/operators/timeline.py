"""Operators along one item's time axis: pauses, paragraphs, merged segments, density, keyframe plans, speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import BY_NAME
from ..functions.text import word_count


def by_item():
    return Window.partitionBy("video_id").orderBy("seg_idx")


def so_far():
    return by_item().rowsBetween(Window.unboundedPreceding, 0)


def pauses(segments: DataFrame, min_gap: float = 3.0) -> DataFrame:
    """Silences of min_gap seconds and more, at their middle; longer ones are surer."""
    before = F.lag("end").over(by_item())
    gap = F.col("start") - F.col("before")
    return segments.withColumn("before", before).where(gap >= min_gap).select(
        "video_id", (F.col("before") + gap / 2).alias("timestamp"), F.lit("significant_pause").alias("trigger_type"),
        F.least(0.5 + gap / 10, F.lit(0.9)).alias("confidence"), gap.alias("gap"),
    )


def merged(segments: DataFrame, max_gap: float = 1.0, max_length: int = 200) -> DataFrame:
    """Fragments as sentences: a new one begins after a gap, a sentence's end, or more than max_length characters.

    Gaps and sentence ends do not depend on what was merged before, so windows find them; only the length needs a
    fold, and that runs over the fragments of one sentence.
    """
    ended = F.lag("text").over(by_item()).rlike(r"[.!?]\s*\z")
    gap = F.col("start") - F.coalesce(F.lag("end").over(by_item()), F.col("start"))
    cut = F.when((gap > max_gap) | F.coalesce(ended, F.lit(False)), 1).otherwise(0)
    parts = segments.withColumn("cut", cut).withColumn("sentence", F.sum("cut").over(so_far()))
    part = F.struct("seg_idx", "start", "end", "text")
    parts = parts.groupBy("video_id", "sentence").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    zero = F.struct(F.lit(-1).alias("size"), F.lit(0).alias("piece"), F.array().cast("array<int>").alias("pieces"))

    def step(acc, x):
        more = acc["size"] > max_length
        piece = F.when(more, acc["piece"] + 1).otherwise(acc["piece"])
        size = F.when(more, F.length(x["text"])).otherwise(acc["size"] + 1 + F.length(x["text"]))
        return F.struct(size.alias("size"), piece.alias("piece"), F.concat(acc["pieces"], F.array(piece)).alias("pieces"))

    pieces = F.aggregate("parts", zero, step)["pieces"]
    rows = parts.select("video_id", "sentence", F.explode(F.arrays_zip("parts", pieces.alias("pieces"))).alias("x"))
    rows = rows.select("video_id", "sentence", F.col("x.pieces").alias("piece"), "x.parts.*")
    grouped = rows.groupBy("video_id", "sentence", "piece").agg(
        F.min("seg_idx").alias("first_idx"), F.min_by("start", "seg_idx").alias("start"), F.max_by("end", "seg_idx").alias("end"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda p: p["text"]), " ")).alias("text"),
        F.count("*").alias("n_originals"),
    )
    at = F.row_number().over(Window.partitionBy("video_id").orderBy("first_idx")) - 1
    return grouped.select("video_id", at.alias("seg_idx"), "start", "end", "text", "n_originals")


def paragraphs(segments: DataFrame, gap: float = 2.0) -> DataFrame:
    """Segments as paragraphs: a new one after a pause or when another known speaker takes over."""
    last = by_item().rowsBetween(Window.unboundedPreceding, -1)
    speaker = F.nullif(F.col("speaker"), F.lit(""))
    before = F.last(speaker, ignorenulls=True).over(last)
    change = speaker.isNotNull() & ~speaker.eqNullSafe(before)
    pause = F.col("start") - F.coalesce(F.lag("end").over(by_item()), F.lit(0.0)) > gap
    rows = segments.withColumn("flag", F.when(change | pause, 1).otherwise(0)).withColumn("who", F.last(speaker, ignorenulls=True).over(so_far()))
    rows = rows.withColumn("flag", F.when(F.row_number().over(by_item()) == 1, 0).otherwise(F.col("flag"))).withColumn("paragraph", F.sum("flag").over(so_far()))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda p: p["text"]), " ")
    return rows.groupBy("video_id", "paragraph").agg(
        F.min_by("start", "seg_idx").alias("start"), F.max_by("end", "seg_idx").alias("end"), F.max_by("who", "seg_idx").alias("speaker"),
        F.count("*").alias("segments"), text.alias("text"),
    )


def speaker_summary(segments: DataFrame) -> DataFrame:
    """Speaking time, share of it, segments and words of each known speaker of an item."""
    known = segments.where("speaker is not null and speaker <> ''")
    by = known.groupBy("video_id", "speaker").agg(
        F.sum(F.col("end") - F.col("start")).alias("duration"), F.count("*").alias("segments"), F.sum(word_count(F.col("text"))).alias("words")
    )
    total = F.sum("duration").over(Window.partitionBy("video_id"))
    return by.withColumn("share", F.when(total > 0, F.col("duration") / total).otherwise(F.lit(0.0)))


def density(segments: DataFrame, window: float = 60.0) -> DataFrame:
    """Words, visual references and topic changes of each window of an item, empty windows included."""
    low = F.lower("text")
    hit = lambda name: F.sum(low.rlike(BY_NAME[name].pattern).cast("long"))
    counted = segments.groupBy("video_id", F.floor(F.col("start") / window).alias("slot")).agg(
        F.sum(word_count(F.col("text"))).alias("word_count"), hit("visual").alias("visual_references"), hit("transition").alias("topic_transitions")
    )
    slots = segments.groupBy("video_id").agg(F.max("end").alias("until")).where("until > 0")
    slots = slots.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col("until") / window) - 1).cast("long"))).alias("slot"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = n("word_count") / window + n("visual_references") * 10 + n("topic_transitions") * 5
    return slots.join(counted, ["video_id", "slot"], "left").select(
        "video_id", (F.col("slot") * window).alias("start"), ((F.col("slot") + 1) * window).alias("end"), n("word_count").alias("word_count"),
        n("visual_references").alias("visual_references"), n("topic_transitions").alias("topic_transitions"), score.alias("density_score"),
    )


def spaced(triggers: DataFrame, min_interval: float = 10.0, most: int = 50) -> DataFrame:
    """Triggers taken greedily along time, each min_interval after the one before, at most `most` of an item.

    Which trigger is next depends on the last one taken, so this is a fold over an item's triggers.
    """
    row = F.struct("timestamp", "rank", "trigger_type", "confidence")
    every = triggers.groupBy("video_id").agg(F.array_sort(F.collect_list(row)).alias("all"))
    kind = "array<struct<timestamp:double,rank:int,trigger_type:string,confidence:double>>"
    zero = F.struct(F.lit(float("-inf")).alias("last"), F.array().cast(kind).alias("taken"))

    def step(acc, x):
        good = (x["timestamp"] - acc["last"] >= min_interval) & (F.size(acc["taken"]) < most)
        taken = F.when(good, F.concat(acc["taken"], F.array(x))).otherwise(acc["taken"])
        return F.struct(F.when(good, x["timestamp"]).otherwise(acc["last"]).alias("last"), taken.alias("taken"))

    return every.select("video_id", F.explode(F.aggregate("all", zero, step)["taken"]).alias("x")).select("video_id", "x.*")


def keyframe_plan(segments: DataFrame, triggers: DataFrame, duration: DataFrame, min_interval: float = 10.0, most: int = 50) -> DataFrame:
    """When to take frames: spaced triggers, with a start frame before a late first one and an end frame after an early last."""
    taken = spaced(triggers, min_interval, most).select("video_id", "timestamp", "trigger_type", "confidence")
    ends = taken.groupBy("video_id").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    items = duration.select("video_id", "duration").join(ends, "video_id", "left")
    extra = lambda at, kind: (at.cast("double").alias("timestamp"), F.lit(kind).alias("trigger_type"), F.lit(1.0).alias("confidence"))
    start = items.where("first > 5.0").select("video_id", *extra(F.lit(1.0), "start"))
    late = (F.col("duration") > 30) & (F.col("last").isNull() | (F.col("last") < F.col("duration") - 30))
    return taken.unionByName(start).unionByName(items.where(late).select("video_id", *extra(F.col("duration") - 5, "end")))


def top_frames(triggers: DataFrame, most: int) -> DataFrame:
    """Of each item's first 2*most triggers the `most` surest, in order of time."""
    arrived = Window.partitionBy("video_id").orderBy("timestamp", "rank")
    sure = Window.partitionBy("video_id").orderBy(F.desc("confidence"), "timestamp", "rank")
    first = triggers.withColumn("arrival", F.row_number().over(arrived)).where(F.col("arrival") <= 2 * most)
    return first.withColumn("place", F.row_number().over(sure)).where(F.col("place") <= most).drop("arrival", "place")
