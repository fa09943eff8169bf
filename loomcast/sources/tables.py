"""Where rows come from: tables of an item store and subtitle files, each with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import stamp_seconds

SEGMENTS = "video_id string, seg_idx int, start double, end double, text string, speaker string"
JSON3 = "events array<struct<tStartMs: bigint, dDurationMs: bigint, segs: array<struct<utf8: string>>>>"
TRANSCRIPT = T.StructType(
    [
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("speaker", T.StringType()),
    ]
)
CUE = r"(?s)(\d{2}:\d{2}:\d{2}\.\d{3}) --> (\d{2}:\d{2}:\d{2}\.\d{3})\n(.*?)(?=\n\n|\z)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def conversation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as timed segments: a turn starts every ten seconds or so and lasts with its length."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    start = (10 * F.col("turn") + (F.col("conv_id") + F.col("turn")) % 4).cast("double")
    return c.select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("seg_idx"), start.alias("start"),
        (start + 2 + F.length("text") % 9).alias("end"), "text", F.col("role").alias("speaker"),
    )


def event_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entity mentions: a quarter of the users is an item, the type the entity, the time in seconds the start."""
    e = table(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return e.select(
        (F.col("user_id") % 4).alias("video_id"), F.col("event_id").alias("mention_idx"), F.col("event_type").alias("entity_id"),
        F.concat(F.lit("K"), F.get_json_object("props", "$.k")).alias("label"), seconds.alias("start"), "user_id",
    )


def document_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a media catalogue."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("video_id"), F.concat(F.col("lang"), F.lit(" "), F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("channel"), F.col("n_chars").cast("double").alias("duration"),
    )


def json3_segments(spark: SparkSession, path: str) -> DataFrame:
    """Timed-text JSON: events with parts become segments; blank ones are dropped and the rest keep their order."""
    raw = spark.read.schema(JSON3).json(path, multiLine=True).select(F.input_file_name().alias("file"), F.posexplode("events").alias("pos", "e"))
    text = F.trim(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    start = F.coalesce("e.tStartMs", F.lit(0)) / 1000.0
    rows = raw.where("e.segs is not null").select("file", "pos", start.alias("start"), (start + F.coalesce("e.dDurationMs", F.lit(0)) / 1000.0).alias("end"), text.alias("text"))
    return _numbered(rows.where("text <> ''"))


def vtt_segments(spark: SparkSession, path: str) -> DataFrame:
    """Cues of whole WebVTT files; stamps need hours, and a cue with settings behind its end is no cue."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    cues = whole.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(CUE), F.lit(0))).alias("pos", "cue"))
    part = lambda i: F.regexp_extract("cue", CUE.replace(r"(?=\n\n|\z)", r"\z"), i)
    text = F.regexp_replace(F.replace(part(3), F.lit("\n"), F.lit(" ")), r"^\s+|\s+$", "")
    rows = cues.select("file", "pos", stamp_seconds(part(1)).alias("start"), stamp_seconds(part(2)).alias("end"), text.alias("text"))
    return _numbered(rows.where("text <> ''"))


def subtitle_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of a subtitle file by its suffix; none for other kinds."""
    if path.endswith(".json3"):
        return json3_segments(spark, path)
    if path.endswith(".vtt"):
        return vtt_segments(spark, path)
    return spark.createDataFrame([], "file string, seg_idx int, start double, end double, text string")


def _numbered(rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1
    return rows.select("file", at.alias("seg_idx"), "start", "end", "text")


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """A transcript file, a bare array or an object with `segments`, as numbered segments."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.trim("value").alias("value"))
    bare = F.from_json("value", T.ArrayType(TRANSCRIPT))
    wrapped = F.from_json("value", T.StructType([T.StructField("segments", T.ArrayType(TRANSCRIPT))]))["segments"]
    found = F.when(F.startswith("value", F.lit("[")), bare).otherwise(wrapped)
    return raw.select("file", F.posexplode(found).alias("seg_idx", "s")).select("file", "seg_idx", "s.*")


def write_segments(segments: DataFrame, path: str) -> None:
    """Overwrite the items that occur in the rows, one folder per item."""
    segments.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(path)
