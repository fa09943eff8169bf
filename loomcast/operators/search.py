"""Search over segments: keywords, topics, entities and vectors; all end in a top-k with a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import TOPIC_TERMS
from ..functions.text import cosine, keyword_score

CONTEXT = 100


def scored(segments: DataFrame, query: str) -> DataFrame:
    """Segments that answer the query at all, with their score; one scan."""
    rows = segments.select("video_id", "seg_idx", F.col("start").alias("timestamp"), "text", keyword_score(F.col("text"), query).alias("score"))
    return rows.where("score > 0")


def keyword(segments: DataFrame, query: str, most: int = 20) -> DataFrame:
    """The best segments, with the texts beside them; only the items of these, `most` at most, are put in order."""
    best = [F.desc("score"), "video_id", "seg_idx"]
    hits = scored(segments, query).orderBy(*best).limit(most)
    by = Window.partitionBy("video_id").orderBy("seg_idx")
    beside = lambda f: F.substring(F.coalesce(f("text").over(by), F.lit("")), 1, CONTEXT)
    items = F.broadcast(hits.select("video_id").distinct())
    context = segments.join(items, "video_id", "left_semi").select("video_id", "seg_idx", beside(F.lag).alias("context_before"), beside(F.lead).alias("context_after"))
    return context.join(F.broadcast(hits), ["video_id", "seg_idx"]).select(*hits.columns, "context_before", "context_after").orderBy(*best)


def titled(results: DataFrame, media: DataFrame) -> DataFrame:
    """Results with their item's title, its id where there is none."""
    titles = media.select("video_id", "title")
    return results.join(titles, "video_id", "left").withColumn("video_title", F.coalesce("title", F.col("video_id").cast("string"))).drop("title")


def expanded(topic: str, neighbours: list[str]) -> list[str]:
    """Search terms of a topic: itself and its neighbours in the graph (five at most), or the fixed terms."""
    if neighbours:
        return [topic, *neighbours[:5]]
    return list(TOPIC_TERMS.get(topic.lower(), (topic,)))


def topic(segments: DataFrame, terms: list[str], most: int = 10) -> DataFrame:
    """The best segments of several terms: 2*most of each, of equal item and second the first term's, then the top.

    All terms are scored in one scan and ranked by term; a segment found by an earlier term stays with its score.
    """
    scores = F.array(*[F.struct(F.lit(i).alias("term"), keyword_score(F.col("text"), t).alias("score")) for i, t in enumerate(terms)])
    rows = segments.select("video_id", "seg_idx", F.col("start").alias("timestamp"), "text", F.explode(scores).alias("x")).select("*", "x.*").drop("x")
    rows = rows.where("score > 0")
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "video_id", "seg_idx"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= 2 * most)
    first = Window.partitionBy("video_id", F.floor("timestamp")).orderBy("term", "rank")
    rows = rows.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return rows.select("video_id", "seg_idx", "timestamp", "text", "score").orderBy(F.desc("score"), "video_id", "seg_idx").limit(most)


def by_entity(mentions: DataFrame, best: DataFrame, most: int = 20) -> DataFrame:
    """Mentions of the best matching entity in order of item and time, each scoring 15."""
    hit = best.orderBy(F.desc("score"), F.desc("total_mentions"), "entity_id").limit(1).select("entity_id")  # one row
    found = mentions.join(F.broadcast(hit), "entity_id", "left_semi").withColumn("score", F.lit(15.0))
    return found.orderBy("video_id", "start", "mention_idx").limit(most)


def semantic(vectors: DataFrame, query: list[float], least: float = 0.3, most: int = 20) -> DataFrame:
    """Vectors more than `least` like the query, the most alike first; scores are ten times the cosine."""
    rows = vectors.withColumn("similarity", cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])))
    rows = rows.where(F.col("similarity") > least).withColumn("score", F.col("similarity") * 10)
    return rows.orderBy(F.desc("similarity"), "vec_id").limit(most)


def catalogue(media: DataFrame) -> DataFrame:
    """Items with defaults for what is unknown, the longest first."""
    return media.select(
        "video_id", F.coalesce("title", F.lit("Unknown")).alias("title"), F.coalesce("channel", F.lit("Unknown")).alias("channel"),
        F.coalesce("duration", F.lit(0.0)).alias("duration"),
    ).orderBy(F.desc("duration"), "video_id")


def shown(results: DataFrame) -> DataFrame:
    """Results as lines for people."""
    from ..functions.text import clock

    return results.withColumn("line", F.format_string("[%s] %s: %s", F.col("video_id").cast("string"), clock(F.col("timestamp")), F.col("text")))
