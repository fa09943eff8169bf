"""Entities from mentions, and how they occur together in time and across items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import ENTITY_LABELS
from ..functions.text import entity_id, match_score, name_rank

WINDOW = 30.0
TIMES = 50


def relevant_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions of the nine labels whose text has two characters and gives an id."""
    rows = mentions.where(F.col("label").isin(*ENTITY_LABELS)).where(F.length(F.trim("text")) >= 2)
    return rows.withColumn("entity_id", entity_id(F.trim("text"))).where("entity_id <> ''")


def with_context(segments: DataFrame, size: int = 200) -> DataFrame:
    """Segments with the text of the ones beside them, cut to `size` characters."""
    near = Window.partitionBy("video_id").orderBy("seg_idx").rowsBetween(-1, 1)
    return segments.withColumn("context", F.substring(F.array_join(F.collect_list("text").over(near), " "), 1, size))


def entities(mentions: DataFrame, label: str = "last") -> DataFrame:
    """Entities of each item with their aliases, best name, type (the first or last label seen) and count."""
    at = F.struct("start", "mention_idx")
    pick = F.max_by if label == "last" else F.min_by
    return mentions.groupBy("video_id", "entity_id").agg(
        pick("label", at).alias("entity_type"), F.max(name_rank(F.col("text")))["name"].alias("canonical_name"),
        F.array_sort(F.collect_set("text")).alias("aliases"), F.count("*").alias("mention_count"), F.min("start").alias("first_seen"),
    )


def near_pairs(mentions: DataFrame, window: float = WINDOW) -> DataFrame:
    """Pairs of mentions of different entities of an item at most `window` seconds apart, the earlier one first.

    A band join as an equi-join: time is cut into slots of the window's size, and a mention looks in its own slot and
    the next.  Every pair is met once, as the later mention has one slot.
    """
    m = mentions.select("video_id", "mention_idx", "entity_id", "start").withColumn("slot", F.floor(F.col("start") / window))
    left = m.withColumn("slot", F.explode(F.array(F.col("slot"), F.col("slot") + 1))).alias("l")
    right = m.alias("r")
    later = (F.col("r.start") > F.col("l.start")) | ((F.col("r.start") == F.col("l.start")) & (F.col("r.mention_idx") > F.col("l.mention_idx")))
    close = (F.col("r.start") - F.col("l.start") <= window) & (F.col("l.entity_id") != F.col("r.entity_id"))
    same = (F.col("l.video_id") == F.col("r.video_id")) & (F.col("l.slot") == F.col("r.slot"))
    return left.join(right, same & later & close).select(
        "l.video_id", F.least("l.entity_id", "r.entity_id").alias("entity_a"), F.greatest("l.entity_id", "r.entity_id").alias("entity_b"),
        F.col("l.start").alias("at"), F.col("l.entity_id").alias("early_id"), F.col("l.mention_idx").alias("early_idx"),
        F.col("r.mention_idx").alias("late_idx"),
    )


def cooccurrences(mentions: DataFrame, window: float = WINDOW) -> DataFrame:
    """Entity pairs with the number of mention pairs close in time, and the first distinct times."""
    return near_pairs(mentions, window).groupBy("video_id", "entity_a", "entity_b").agg(
        F.count("*").alias("count"), F.slice(F.array_sort(F.collect_set("at")), 1, TIMES).alias("timestamps")
    )


def sliding_cooccurrences(mentions: DataFrame, window: float = WINDOW) -> DataFrame:
    """For each mention of the smaller entity the first (in mention order) close one of the larger: distinct times, at most 50."""
    m = mentions.select("video_id", "mention_idx", "entity_id", "start").withColumn("slot", F.floor(F.col("start") / window))
    left = m.withColumn("slot", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1))).alias("l")
    same = (F.col("l.video_id") == F.col("r.video_id")) & (F.col("l.slot") == F.col("r.slot"))
    close = (F.abs(F.col("l.start") - F.col("r.start")) <= window) & (F.col("l.entity_id") < F.col("r.entity_id"))
    met = left.join(m.alias("r"), same & close).groupBy(
        F.col("l.video_id").alias("video_id"), F.col("l.entity_id").alias("entity_a"), F.col("r.entity_id").alias("entity_b"), F.col("l.mention_idx").alias("idx")
    )
    first = met.agg(F.least(F.first("l.start"), F.min_by("r.start", "r.mention_idx")).alias("at"))
    times = F.slice(F.array_sort(F.collect_set("at")), 1, TIMES)
    out = first.groupBy("video_id", "entity_a", "entity_b").agg(times.alias("timestamps"))
    return out.withColumn("count", F.size("timestamps").cast("long"))


def recent_pairs(mentions: DataFrame, window: float = WINDOW) -> DataFrame:
    """Distinct pairs of entities that came close."""
    return near_pairs(mentions, window).select("video_id", "entity_a", "entity_b").distinct()


def graph_nodes(entity_rows: DataFrame) -> DataFrame:
    """Entities over all items: the name and type of the first item, items and mentions in total."""
    return entity_rows.groupBy("entity_id").agg(
        F.min_by("canonical_name", "video_id").alias("canonical_name"), F.min_by("entity_type", "video_id").alias("entity_type"),
        F.countDistinct("video_id").alias("total_videos"), F.sum("mention_count").alias("total_mentions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("aliases"),
    )


def graph_edges(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both directions of every pair, summed over items; ends must be nodes."""
    both = pairs.select(F.col("entity_a").alias("entity_id"), F.col("entity_b").alias("related_id"), "count", "video_id").unionByName(
        pairs.select(F.col("entity_b").alias("entity_id"), F.col("entity_a").alias("related_id"), "count", "video_id")
    )
    known = nodes.select("entity_id")
    both = both.join(known, "entity_id", "left_semi").join(known.withColumnRenamed("entity_id", "related_id"), "related_id", "left_semi")
    return both.groupBy("entity_id", "related_id").agg(F.sum("count").alias("count"), F.countDistinct("video_id").alias("videos"))


def alias_index(entity_rows: DataFrame) -> DataFrame:
    """For every lower-cased alias the entity that the last item gave it."""
    rows = entity_rows.select("video_id", "entity_id", F.explode("aliases").alias("alias"))
    return rows.groupBy(F.lower("alias").alias("alias")).agg(F.max_by("entity_id", F.struct("video_id", "entity_id")).alias("entity_id"))


def without_item(entity_rows: DataFrame, item) -> DataFrame:
    """Entity rows after an item is taken out; nodes and edges follow from what is left."""
    return entity_rows.where(F.col("video_id") != item)


def search_entities(nodes: DataFrame, query: str, most: int = 10) -> DataFrame:
    score = match_score(query, F.col("entity_id"), F.col("canonical_name"), F.col("aliases"))
    found = nodes.withColumn("score", score).where("score > 0")
    return found.orderBy(F.desc("score"), F.desc("total_mentions"), "entity_id").limit(most)


def related(edges: DataFrame, nodes: DataFrame, entity: str, most: int = 10) -> DataFrame:
    """An entity's neighbours by weight, with their names."""
    names = nodes.select(F.col("entity_id").alias("related_id"), "canonical_name")
    mine = edges.where(F.col("entity_id") == entity).join(names, "related_id")
    return mine.select("related_id", "canonical_name", "count").orderBy(F.desc("count"), "related_id").limit(most)


def entity_videos(entity_rows: DataFrame, entity: str) -> DataFrame:
    return entity_rows.where(F.col("entity_id") == entity).select("video_id", "mention_count")
