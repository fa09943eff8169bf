"""Merging and aligning transcripts: last writer wins, overlap removal, speakers by overlap, recognised text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard


def merge_transcripts(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Segments of both by start and first 50 characters; the remote one wins."""
    both = local.withColumn("src", F.lit(0)).unionByName(remote.withColumn("src", F.lit(1)))
    key = ["video_id", "start", F.substring("text", 1, 50).alias("head")]
    won = both.groupBy(*key).agg(F.max_by(F.struct("end", "text", "speaker"), F.struct("src", "seg_idx")).alias("w"))
    return won.select("video_id", "start", "w.*")


def merge_entities(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Entities of both: aliases united, mentions by time with the remote one winning, other fields the local ones'."""
    l, r = local.alias("l"), remote.alias("r")  # noqa: E741
    both = l.join(r, ["video_id", "entity_id"], "full_outer")
    none = F.array().cast("array<struct<start:double,text:string>>")
    theirs, mine = F.coalesce("r.mentions", none), F.coalesce("l.mentions", none)
    own = F.filter(mine, lambda m: ~F.exists(theirs, lambda t: t["start"] == m["start"]))
    mentions = F.array_sort(F.concat(own, theirs))
    names = F.array().cast("array<string>")
    return both.select(
        "video_id", "entity_id", F.coalesce("l.canonical_name", "r.canonical_name").alias("canonical_name"),
        F.array_sort(F.array_union(F.coalesce("l.aliases", names), F.coalesce("r.aliases", names))).alias("aliases"),
        mentions.alias("mentions"), F.size(mentions).cast("long").alias("mention_count"),
    )


def drop_overlap(existing: DataFrame, new: DataFrame, overlap: float = 3.0, similar: float = 0.8, recent: int = 5) -> DataFrame:
    """Existing segments and the new ones that neither end before the overlap begins nor repeat a recent segment."""
    last = existing.groupBy("video_id").agg(F.max_by("end", "seg_idx").alias("last_end"))
    back = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("seg_idx")))
    tail = existing.withColumn("back", back).where(F.col("back") <= recent).select(F.col("video_id").alias("item"), F.col("text").alias("old"))
    fresh = new.join(last, "video_id", "left").where(F.col("last_end").isNull() | (F.col("end") > F.col("last_end") - overlap)).drop("last_end")
    twin = (F.col("video_id") == F.col("item")) & (jaccard(F.col("text"), F.col("old")) >= similar)
    return existing.unionByName(fresh.join(tail, twin, "left_anti"))


def speakers_by_overlap(segments: DataFrame, turns: DataFrame, slot: float = 30.0) -> DataFrame:
    """Segments with the speaker of the single turn that overlaps them longest (the first on ties), else their own.

    An interval join as an equi-join on time slots; of the slots that a pair shares only the first counts it.
    """
    slots = lambda s, e: F.explode(F.sequence(F.floor(s / slot), F.floor(F.greatest(s, e) / slot)))
    left = segments.select("video_id", "seg_idx", "start", "end", slots(F.col("start"), F.col("end")).alias("slot")).alias("s")
    right = turns.select("video_id", "turn_idx", F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.col("speaker").alias("who"), slots(F.col("start"), F.col("end")).alias("slot")).alias("t")
    both = left.join(right, ["video_id", "slot"]).where((F.col("start") < F.col("t_end")) & (F.col("t_start") < F.col("end")))
    both = both.where(F.col("slot") == F.greatest(F.floor(F.col("start") / slot), F.floor(F.col("t_start") / slot)))
    size = F.least("end", "t_end") - F.greatest("start", "t_start")
    best = both.groupBy("video_id", "seg_idx").agg(F.max_by("who", F.struct(size, -F.col("turn_idx"))).alias("who"))
    return segments.join(best, ["video_id", "seg_idx"], "left").withColumn("speaker", F.coalesce("who", "speaker")).drop("who")


def recognised_text(blocks: DataFrame, least: float = 0.3) -> DataFrame:
    """Text of each image from blocks sure enough and not blank, in order, with their mean confidence."""
    kept = blocks.where((F.col("confidence") >= least) & (F.trim("text") != ""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "text"))), lambda x: F.trim(x["text"])), " ")
    found = kept.groupBy("image").agg(text.alias("ocr_text"), F.avg("confidence").alias("confidence"), F.count("*").alias("blocks"))
    images = blocks.select("image").distinct()
    return images.join(found, "image", "left").select(
        "image", F.coalesce("ocr_text", F.lit("")).alias("ocr_text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("blocks", F.lit(0)).alias("blocks"),
    )


def readable_frames(recognised: DataFrame, least: float = 0.3) -> DataFrame:
    return recognised.where((F.col("ocr_text") != "") & (F.col("confidence") > least))
