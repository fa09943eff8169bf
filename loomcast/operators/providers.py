"""Stages that need a model (names, vectors, speech, characters) as functions from rows to rows.

A provider gets a DataFrame and returns one with the declared columns; the defaults here need no model and no network.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[DataFrame], DataFrame]


def gazetteer_mentions(names: dict[str, str]) -> Provider:
    """Finds names of a fixed list (name to label) in segments, wherever a word begins and ends with them."""

    def run(segments: DataFrame) -> DataFrame:
        table = F.array(*[F.struct(F.lit(n).alias("text"), F.lit(label).alias("label")) for n, label in sorted(names.items())])
        padded = F.concat(F.lit(" "), F.regexp_replace("text", r"[^\p{L}\p{N}]+", " "), F.lit(" "))
        hit = F.filter(table, lambda x: F.contains(padded, F.concat(F.lit(" "), x["text"], F.lit(" "))))
        rows = segments.select("video_id", "seg_idx", "start", "end", F.posexplode(hit).alias("nth", "m"))
        return rows.select("video_id", "seg_idx", "start", "end", "m.text", "m.label", (F.col("seg_idx") * 1000 + F.col("nth")).alias("mention_idx"))

    return run


def hashed_vectors(size: int = 64) -> Provider:
    """A bag of hashed words as a vector of unit length (zero for texts without words)."""

    def run(segments: DataFrame) -> DataFrame:
        words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        slot = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
        counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slot, lambda s: s == i)).cast("double"))
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return segments.withColumn("embedding", F.transform(counts, lambda x: F.coalesce(x / F.nullif(norm, F.lit(0.0)), F.lit(0.0))))

    return run


def missing(vectors: DataFrame, segments: DataFrame, model: str) -> DataFrame:
    """Segments that this model has not embedded yet."""
    known = vectors.where(F.col("model_name") == model).select("video_id", "seg_idx")
    return segments.join(known, ["video_id", "seg_idx"], "left_anti")


def completed(vectors: DataFrame, segments: DataFrame, model: str, encode: Provider) -> DataFrame:
    """Cached vectors of the model, and fresh ones for what is missing."""
    fresh = encode(missing(vectors, segments, model)).withColumn("model_name", F.lit(model))
    cached = vectors.where(F.col("model_name") == model)
    return cached.unionByName(fresh.select(*cached.columns))
