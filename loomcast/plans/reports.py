"""Reports: aggregates of an item rendered as Markdown, its manifest, and the partial digest of a live stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clock, dashed_date, word_count
from ..operators.timeline import paragraphs, speaker_summary

#: Order of entity types in a digest (fixed values).
TYPES = ("PERSON", "ORG", "GPE", "LOC", "WORK_OF_ART", "EVENT", "PRODUCT", "LAW", "NORP")


def manifest(segments: DataFrame, entity_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Segments, words, entities, pairs and the last second of each item."""
    s = segments.groupBy("video_id").agg(
        F.count("*").alias("segments"), F.sum(word_count(F.col("text"))).alias("words"), F.max("end").alias("duration")
    )
    e = entity_rows.groupBy("video_id").agg(F.count("*").alias("entities"), F.sum("mention_count").alias("mentions"))
    p = pairs.groupBy("video_id").agg(F.count("*").alias("pairs"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return s.join(e, "video_id", "left").join(p, "video_id", "left").select("video_id", "segments", "words", "duration", zero("entities"), zero("mentions"), zero("pairs"))


def top_entities(entity_rows: DataFrame, most: int = 8, by: tuple[str, ...] = ("video_id", "entity_type")) -> DataFrame:
    """The most mentioned entities of each group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mention_count"), "entity_id"))
    return entity_rows.withColumn("rank", rank).where(F.col("rank") <= most)


def top_pairs(pairs: DataFrame, most: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("count"), "entity_a", "entity_b"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most)


def digest(media: DataFrame, segments: DataFrame, entity_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """One Markdown text per item: head, speakers, entities by type, pairs, transcript in paragraphs."""
    lines = lambda order, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "\n")
    who = speaker_summary(segments).groupBy("video_id").agg(
        lines([(-F.col("duration")).alias("o"), "speaker"], F.format_string("- **%s**: %s (%.0f%%) - %d words across %d segments", "speaker", clock(F.col("duration")), F.col("share") * 100, "words", "segments")).alias("who")
    )
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TYPES)), F.col("entity_type")), F.lit(0)), F.lit(99)).alias("o")
    what = top_entities(entity_rows).groupBy("video_id").agg(
        lines([order, "rank"], F.format_string("- %s (%s): %d mentions, first at %s", "canonical_name", "entity_type", "mention_count", clock(F.col("first_seen")))).alias("what")
    )
    both = top_pairs(pairs).groupBy("video_id").agg(lines(["rank"], F.format_string("- %s and %s: %d", "entity_a", "entity_b", "count")).alias("both"))
    name = F.when(F.col("speaker").isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), F.col("speaker"), F.lit(":")))
    said = paragraphs(segments).groupBy("video_id").agg(lines(["paragraph"], F.format_string("**[%s]%s** %s\n", clock(F.col("start")), name, "text")).alias("said"))
    about = F.when(F.length("description") > 1000, F.concat(F.substring("description", 1, 1000), F.lit("..."))).otherwise(F.col("description"))
    part = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"## {title}\n\n"), F.col(c)))
    rows = media
    for more in (who, what, both, said):
        rows = rows.join(more, "video_id", "left")
    head = F.concat(F.lit("# "), F.coalesce("title", F.col("video_id").cast("string")), F.lit("\n\n"), F.coalesce("channel", F.lit("Unknown")), F.lit(", "), clock(F.col("duration"), "00:00"), F.lit(", "), F.coalesce(dashed_date(F.col("upload_date")), F.lit("undated")))
    text = F.concat_ws("\n\n", head, about, part("Speakers", "who"), part("Entities", "what"), part("Together", "both"), F.coalesce(part("Transcript", "said"), F.lit("## Transcript\n\n*No transcript available*")))
    return rows.select("video_id", text.alias("markdown"))


def partial_digest(entity_rows: DataFrame, pairs: DataFrame, most: int = 5, edges: int = 10) -> DataFrame:
    """What a live stream shows: entities by type, types in order of name, then pairs, as (video_id, part, place, line)."""
    e = top_entities(entity_rows, most)
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("entity_type", "rank"))
    first = e.select("video_id", F.lit("entity").alias("part"), place.alias("place"), F.concat_ws(" ", "entity_type", "canonical_name").alias("line"), F.col("mention_count").alias("n"))
    p = top_pairs(pairs, edges)
    return first.unionByName(p.select("video_id", F.lit("pair").alias("part"), F.col("rank").alias("place"), F.concat_ws(" ", "entity_a", "entity_b").alias("line"), F.col("count").alias("n")))
