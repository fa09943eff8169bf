"""Column expressions over text, times and identifiers.  All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-cased, blank-separated words of a text; no empty ones, none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def entity_id(name: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clock(seconds: Column, missing: str | None = None) -> Column:
    """Seconds as M:SS, or H:MM:SS from one hour on."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    long_form = F.format_string("%d:%02d:%02d", h, m, r)
    out = F.when(h > 0, long_form).otherwise(F.format_string("%d:%02d", m, r))
    return out if missing is None else F.when(seconds.isNull(), F.lit(missing)).otherwise(out)


def dashed_date(date: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD; anything else as it is."""
    parts = F.concat_ws("-", F.substring(date, 1, 4), F.substring(date, 5, 2), F.substring(date, 7, 2))
    return F.when(F.length(date) == 8, parts).otherwise(date)


def stamp_seconds(stamp: Column) -> Column:
    """HH:MM:SS.mmm (or with a comma) as seconds."""
    part = F.split(F.replace(stamp, F.lit(","), F.lit(".")), ":")
    return part[0].cast("double") * 3600 + part[1].cast("double") * 60 + part[2].cast("double")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' word sets; null if either has no words."""
    x, y = words(a), words(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def _any_holds(have: Column, part: str) -> Column:
    return F.exists(have, lambda x: F.contains(x, F.lit(part)))


def keyword_score(text: Column, query: str) -> Column:
    """10 for the phrase, 2 for each query word in the text, 0.5 for each query word inside any text word."""
    asked = list(dict.fromkeys(query.lower().split()))
    have = F.array_distinct(words(text))
    score = F.when(F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(query.lower())), F.lit(10.0)).otherwise(F.lit(0.0))
    for w in asked:
        score = score + F.when(F.array_contains(have, w), F.lit(2.0)).otherwise(F.lit(0.0))
        score = score + F.when(_any_holds(have, w), F.lit(0.5)).otherwise(F.lit(0.0))
    return score


def name_rank(name: Column) -> Column:
    """What makes a name the better canonical one: a capital first, a blank inside, length up to 50, then the name."""
    first = F.substring(name, 1, 1)
    return F.struct(
        ((first == F.upper(first)) & (first != F.lower(first))).alias("capital"),
        F.contains(name, F.lit(" ")).alias("blank"),
        F.least(F.length(name), F.lit(50)).alias("size"),
        name.alias("name"),
    )


def match_score(query: str, eid: Column, canonical: Column, aliases: Column) -> Column:
    """How well an entity answers a query: by id 100, by alias 90, inside its name 70, inside its id 50, else 0."""
    norm = "_".join(x for x in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split())
    low = F.lit(query.lower())
    return (
        F.when(eid == norm, 100)
        .when(F.exists(aliases, lambda a: F.lower(a) == low), 90)
        .when(F.contains(F.lower(canonical), low), 70)
        .when(F.contains(eid, F.lit(norm)), 50)
        .otherwise(0)
    )


def media_id(url: Column) -> Column:
    """The 11-character id in an address: behind v=, /v/ or youtu.be/, else the first such run; null if none."""
    named = F.regexp_extract(url, r"(?:v=|/v/|youtu\.be/)([a-zA-Z0-9_-]{11})", 1)
    loose = F.regexp_extract(url, r"([a-zA-Z0-9_-]{11})", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(loose, F.lit("")))


def stream_kind(url: Column) -> Column:
    """Kind of live stream by its address, by the first rule that holds; null if none."""
    low = F.lower(url)
    return (
        F.when(F.contains(low, F.lit(".m3u8")) | F.contains(low, F.lit("/hls/")), "hls")
        .when(low.rlike("^rtmps?://"), "rtmp")
        .when(F.contains(low, F.lit("twitch.tv/")), "twitch")
        .when(low.rlike(r"youtube\.com/live/|youtu\.be/live/"), "youtube_live")
    )


def local_id(filename: Column) -> Column:
    return F.substring(F.md5(filename), 1, 11)


def safe_filename(name: Column) -> Column:
    """Characters that file systems refuse become underscores; at most 200 characters."""
    return F.substring(F.translate(name, '<>:"/\\|?*', "_________"), 1, 200)


def checksum(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 16)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
