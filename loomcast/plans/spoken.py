"""Queries over small spoken fixtures, which hold the fixed English phrases that the driver's invented texts lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.patterns import CONTENT_TYPES, ENTITY_LABELS, FAMILIES, Family
from ..functions.session import scratch
from ..operators import clusters, entities, merging, timeline, triggers
from ..sources import tables as S

Rows = list[tuple]

#: video_id, seg_idx, start, end, text, speaker
SPOKEN: Rows = [
    (1, 0, 0.0, 4.0, "Welcome back. So tell me, what was your first album?", "host"),
    (1, 1, 4.5, 9.0, "Yeah, so I think the most really honest answer", "guest"),
    (1, 2, 9.2, 14.0, "is that I loved that song.", "guest"),
    (1, 3, 18.0, 22.0, "That's fascinating. Speaking of songs, how did you write it?", "host"),
    (1, 4, 22.5, 31.0, "What I've learned is that it's hard, and honestly it was incredible", "guest"),
    (1, 5, 31.5, 40.0, "My advice: take a look at this picture.", "guest"),
    (1, 6, 70.0, 71.0, "exactly right", None),
    (2, 0, 1.0, 6.0, "In this lecture we'll explore what entropy means", "teacher"),
    (2, 1, 6.2, 12.0, "Entropy is defined as a measure of disorder.", "teacher"),
    (2, 2, 12.5, 20.0, "As you can see on the slide, this shows the second law", "teacher"),
    (2, 3, 26.0, 33.0, "Moving on to the next topic: the key idea is that this implies that order decays.", "teacher"),
    (2, 4, 33.5, 41.0, "According to Boltzmann, the relationship between both is simple", ""),
    (2, 5, 64.0, 69.0, "In conclusion, this brings us to the problem of time.", "teacher"),
    (3, 0, 7.0, 10.0, "Python is a high-level language", "coder"),
    (3, 1, 10.1, 14.0, "that lets you define a function by using indentation.", "coder"),
    (3, 2, 14.5, 21.0, "Now let's look at the code here: run this instead of that!", "coder"),
    (3, 3, 21.5, 27.0, "It also has frameworks like Flask and tools like pip", "coder"),
    (3, 4, 27.2, 33.0, "and a huge ecosystem of libraries such as numpy", "coder"),
    (4, 0, 0.0, 2.0, "nothing to see", "someone"),
]
SPOKEN_TYPES = "video_id long, seg_idx long, start double, end double, text string, speaker string"


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)


def values(name: str, columns: str, rows: Rows) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)})"


SEG = values("seg", 'video_id, seg_idx, start, "end", text, speaker', SPOKEN)
MERGED = """o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) AS rn, start - lag("end") OVER (PARTITION BY video_id ORDER BY seg_idx) AS gap FROM seg),
m AS (SELECT video_id, rn, 0 AS grp, text AS acc FROM o WHERE rn = 1
  UNION ALL SELECT o.video_id, o.rn, CASE WHEN o.gap > 1 OR length(m.acc) > 200 OR regexp_matches(m.acc, '[.!?]\\s*$') THEN m.grp + 1 ELSE m.grp END,
    CASE WHEN o.gap > 1 OR length(m.acc) > 200 OR regexp_matches(m.acc, '[.!?]\\s*$') THEN o.text ELSE m.acc || ' ' || o.text END
  FROM m JOIN o ON o.video_id = m.video_id AND o.rn = m.rn + 1),
merged AS (SELECT m.video_id, CAST(grp AS BIGINT) AS seg_idx, arg_min(start, rn) AS start, arg_max("end", rn) AS "end", trim(string_agg(text, ' ' ORDER BY rn)) AS text
  FROM m JOIN o USING (video_id, rn) GROUP BY 1, 2)"""


def scan_sql(families: tuple[Family, ...], source: str) -> str:
    """What triggers.detect() finds in a table, family by family."""
    parts = []
    for i, f in enumerate(families):
        context = "lower(text)" if f.lower_context else "text"
        parts.append(
            f"SELECT video_id, seg_idx, start AS timestamp, {i} AS rank, {literal(f.trigger)} AS trigger_type, {f.confidence}::DOUBLE AS confidence, "
            f"{literal(f.content)} AS content, substr({context}, 1, {f.context}) AS context FROM {source} WHERE regexp_matches(lower(text), {literal(f.pattern)})"
        )
    return " UNION ALL ".join(parts)


RAW = tuple(f for f in FAMILIES if not f.merged)
JOINED = tuple(f for f in FAMILIES if f.merged)
PLAN = tuple(f for f in FAMILIES if f.name in ("visual", "transition"))
COUNTS = ", ".join(f"CAST(coalesce(sum(CASE WHEN content = '{c}' THEN 1 ELSE 0 END), 0) AS BIGINT) AS {c}" for c in CONTENT_TYPES)
PICK = "CASE WHEN podcast = greatest(podcast, lecture, tutorial) THEN 'podcast' WHEN lecture = greatest(podcast, lecture, tutorial) THEN 'lecture' ELSE 'tutorial' END"
BEST = f"""hit AS ({scan_sql(JOINED, "merged")}), tally AS (SELECT a.video_id, {COUNTS} FROM (SELECT DISTINCT video_id FROM merged) a LEFT JOIN hit USING (video_id) GROUP BY 1),
best AS (SELECT video_id, {PICK} AS content_type, greatest(podcast, lecture, tutorial) AS triggers, podcast, lecture, tutorial FROM tally)"""


def spoken(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPOKEN, SPOKEN_TYPES)


def phrase_triggers(spark, d):
    return triggers.detect(spoken(spark), RAW)


def merged_phrase_triggers(spark, d):
    return triggers.detect(timeline.merged(spoken(spark)).withColumn("seg_idx", F.col("seg_idx").cast("long")), JOINED)


def spoken_content_type(spark, d):
    return triggers.content_type(timeline.merged(spoken(spark)))


def content_analysis(spark, d):
    rows = [triggers.analyzed(spoken(spark), c) for c in CONTENT_TYPES]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    listed = F.array_join(F.transform("triggers", lambda t: F.concat_ws("@", t["trigger_type"], F.round(t["timestamp"] * 10).cast("long"))), " ")
    return every.withColumn("triggers", listed)


def best_content_frames(spark, d):
    return triggers.best_frames(spoken(spark), 2).select("video_id", "content_type", "timestamp", "trigger_type", "confidence")


def spoken_density(spark, d):
    return timeline.density(spoken(spark))


def spoken_keyframe_plan(spark, d):
    rows = spoken(spark)
    found = triggers.detect(rows, PLAN).select("video_id", "timestamp", "rank", "trigger_type", "confidence")
    silent = timeline.pauses(rows).select("video_id", "timestamp", F.lit(len(PLAN)).alias("rank"), "trigger_type", "confidence")
    return timeline.keyframe_plan(rows, found.unionByName(silent), rows.groupBy("video_id").agg(F.max("end").alias("duration")))


MENTIONS: Rows = [(1, i, float(i), t, label) for i, (t, label) in enumerate([
    ("Ada Lovelace", "PERSON"), (" ada lovelace ", "PERSON"), ("X", "ORG"), ("London", "GPE"), ("2020", "DATE"), ("!!", "ORG"), ("The UN", "NORP"), ("five", "CARDINAL"), ("Café", "LOC"),
])]


def labelled_mentions(spark, d):
    return entities.relevant_mentions(spark.createDataFrame(MENTIONS, "video_id long, mention_idx long, start double, text string, label string"))


LOCAL: Rows = [(1, "ada", "Ada", "Ada|Countess", "1:Ada|5:Ada"), (1, "bob", "Bob", "Bob", "2:Bob")]
REMOTE: Rows = [(1, "ada", "Lovelace", "Lovelace|Ada", "5:Lovelace|9:Ada"), (2, "eve", "Eve", "Eve", "3:Eve")]


def merged_entities(spark, d):
    def table(rows: Rows) -> DataFrame:
        said = F.transform(F.split("said", r"\|"), lambda x: F.struct(F.split(x, ":")[0].cast("double").alias("start"), F.split(x, ":")[1].alias("text")))
        named = spark.createDataFrame(rows, "video_id long, entity_id string, canonical_name string, names string, said string")
        return named.select("video_id", "entity_id", "canonical_name", F.split("names", r"\|").alias("aliases"), said.alias("mentions"))

    out = merging.merge_entities(table(LOCAL), table(REMOTE))
    said = F.array_join(F.transform("mentions", lambda m: F.concat_ws(":", m["start"].cast("long"), m["text"])), "|")
    return out.select("video_id", "entity_id", "canonical_name", F.array_join("aliases", "|").alias("aliases"), said.alias("said"), "mention_count")


TERMS: Rows = [(0, "brain", 9, 1), (0, "neuron", 7, 2), (0, "cortex", 7, 3), (0, "sleep", 2, 4), (1, "python", 8, 1), (1, "code", 5, 2), (2, "yoga", 1, 1)]


def _labelled(spark):
    return clusters.labels(spark.createDataFrame(TERMS, "cluster int, term string, n long, place int"))


def cluster_labels(spark, d):
    return _labelled(spark).select("cluster", "label", F.array_join("terms", " ").alias("terms"))


def cluster_for_query(spark, d):
    return clusters.best_cluster(_labelled(spark), "Python code").select("cluster", "label", F.col("score").cast("long").alias("score"))


def order_dates(spark, d):
    days = F.date_format("o_orderdate", "yyyyMMdd")
    dates = S.table(spark, d, "orders").select("o_orderkey", X.dashed_date(days).alias("day"), X.dashed_date(F.substring(days, 1, 6)).alias("month"))
    return dates


VTT = "WEBVTT\n\n00:00:01.000 --> 00:00:02.500\nHello\nthere\n\n00:00:03,250 --> 00:00:04.000\n \n\n01:00:05.000 --> 01:00:06.000\nBye\n"
JSON3 = (
    '{"events": [{"tStartMs": 0, "dDurationMs": 1500, "segs": [{"utf8": "Hel"}, {"utf8": "lo "}]}, {"tStartMs": 2000, "segs": [{"utf8": "\\n"}]}, '
    '{"tStartMs": 2500, "dDurationMs": 500}, {"segs": [{"utf8": "late"}]}]}'
)
TRANSCRIPT = '{"segments": [{"start": 0.5, "end": 2.0, "text": "one", "speaker": "A"}, {"start": 2.0, "end": 3.0, "text": "two"}]}'


def _file(spark: SparkSession, tag: str, content: str) -> str:
    path = scratch(spark, tag)
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.text(path)
    return path


def vtt_cues(spark, d):
    return S.vtt_segments(spark, _file(spark, "vtt", VTT)).drop("file")


def json3_events(spark, d):
    return S.json3_segments(spark, _file(spark, "json3", JSON3)).drop("file")


def transcript_rows(spark, d):
    return S.read_transcript(spark, _file(spark, "transcript", TRANSCRIPT)).select("seg_idx", "start", "end", "text", "speaker")


QUERIES = {
    f.__name__: f
    for f in (
        phrase_triggers, merged_phrase_triggers, spoken_content_type, content_analysis, best_content_frames, spoken_density, spoken_keyframe_plan,
        labelled_mentions, merged_entities, cluster_labels, cluster_for_query, order_dates, vtt_cues, json3_events, transcript_rows,
    )
}

ANALYSIS = " UNION ALL ".join(
    f"""SELECT i.video_id, '{c}' AS content_type, CAST(n AS BIGINT) AS merged_segments, CAST(raw AS BIGINT) AS raw_segments, raw / n::DOUBLE AS compression_ratio,
  coalesce((SELECT string_agg(trigger_type || '@' || CAST(round(timestamp * 10) AS BIGINT), ' ' ORDER BY timestamp, rank, seg_idx) FROM hit h WHERE h.video_id = i.video_id AND h.content = '{c}'), '') AS triggers FROM i"""
    for c in CONTENT_TYPES
)

ORACLE_SQL = {
    "phrase_triggers": f"WITH {SEG} {scan_sql(RAW, 'seg')}",
    "merged_phrase_triggers": f"WITH RECURSIVE {SEG}, {MERGED} {scan_sql(JOINED, 'merged')}",
    "spoken_content_type": f"WITH RECURSIVE {SEG}, {MERGED}, {BEST} SELECT * FROM best",
    "content_analysis": f"""WITH RECURSIVE {SEG}, {MERGED}, {BEST}, i AS (SELECT video_id, count(*) AS n, any_value(raw) AS raw FROM merged JOIN (SELECT video_id, count(*) AS raw FROM seg GROUP BY 1) USING (video_id) GROUP BY 1)
{ANALYSIS}""",
    "best_content_frames": f"""WITH RECURSIVE {SEG}, {MERGED}, {BEST}, t AS (SELECT hit.*, content_type FROM hit JOIN best ON hit.video_id = best.video_id AND content = content_type),
a AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, rank) AS arrival FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, timestamp, rank) AS place FROM a WHERE arrival <= 4)
SELECT video_id, content_type, timestamp, trigger_type, confidence FROM b WHERE place <= 2""",
    "spoken_density": f"""WITH {SEG}, s AS (SELECT video_id, unnest(range(0, CAST(ceil(max("end") / 60) AS BIGINT))) AS slot FROM seg GROUP BY video_id HAVING max("end") > 0),
c AS (SELECT video_id, CAST(floor(start / 60) AS BIGINT) AS slot, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS w,
  count(*) FILTER (regexp_matches(lower(text), {literal(PLAN[0].pattern)})) AS v, count(*) FILTER (regexp_matches(lower(text), {literal(PLAN[1].pattern)})) AS t FROM seg GROUP BY 1, 2)
SELECT video_id, slot * 60.0::DOUBLE AS start, (slot + 1) * 60.0::DOUBLE AS "end", coalesce(w, 0) AS word_count, coalesce(v, 0) AS visual_references, coalesce(t, 0) AS topic_transitions,
  coalesce(w, 0) / 60.0::DOUBLE + coalesce(v, 0) * 10 + coalesce(t, 0) * 5 AS density_score FROM s LEFT JOIN c USING (video_id, slot)""",
    "spoken_keyframe_plan": f"""WITH RECURSIVE {SEG}, p AS (SELECT *, lag("end") OVER (PARTITION BY video_id ORDER BY seg_idx) AS b FROM seg),
trig AS (SELECT video_id, timestamp, rank, trigger_type, confidence FROM ({scan_sql(PLAN, 'seg')})
  UNION ALL SELECT video_id, b + (start - b) / 2, {len(PLAN)}, 'significant_pause', least(0.5 + (start - b) / 10, 0.9) FROM p WHERE start - b >= 3),
o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, rank, trigger_type, confidence) AS rn FROM trig),
g AS (SELECT video_id, rn, timestamp AS last, true AS taken FROM o WHERE rn = 1
  UNION ALL SELECT o.video_id, o.rn, CASE WHEN o.timestamp - g.last >= 10 THEN o.timestamp ELSE g.last END, o.timestamp - g.last >= 10 FROM g JOIN o ON o.video_id = g.video_id AND o.rn = g.rn + 1),
t AS (SELECT o.video_id, o.timestamp, o.trigger_type, o.confidence FROM g JOIN o USING (video_id, rn) WHERE taken),
e AS (SELECT video_id, min(timestamp) AS first, max(timestamp) AS last FROM t GROUP BY 1), d AS (SELECT video_id, max("end") AS duration FROM seg GROUP BY 1)
SELECT * FROM t UNION ALL SELECT video_id, 1.0, 'start', 1.0 FROM e WHERE first > 5
UNION ALL SELECT d.video_id, duration - 5, 'end', 1.0 FROM d LEFT JOIN e USING (video_id) WHERE duration > 30 AND (last IS NULL OR last < duration - 30)""",
    "labelled_mentions": f"""WITH {values("m", "video_id, mention_idx, start, text, label", MENTIONS)}, k AS (
SELECT *, regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS entity_id FROM m
WHERE label IN ({", ".join(map(literal, ENTITY_LABELS))}) AND length(trim(text)) >= 2) SELECT * FROM k WHERE entity_id <> ''""",
    "merged_entities": f"""WITH {values("l", "video_id, entity_id, canonical_name, names, said", LOCAL)}, {values("r", "video_id, entity_id, canonical_name, names, said", REMOTE)},
both_ AS (SELECT *, 0 AS src FROM l UNION ALL SELECT *, 1 FROM r),
x AS (SELECT video_id, entity_id, src, unnest(string_split(said, '|')) AS s FROM both_),
y AS (SELECT video_id, entity_id, arg_max(s, src) AS s, CAST(split_part(s, ':', 1) AS INT) AS moment FROM x GROUP BY 1, 2, 4),
n AS (SELECT DISTINCT video_id, entity_id, unnest(string_split(names, '|')) AS a FROM both_)
SELECT video_id, entity_id, canonical_name, aliases, said, mention_count FROM (SELECT video_id, entity_id, arg_min(canonical_name, src) AS canonical_name FROM both_ GROUP BY 1, 2)
JOIN (SELECT video_id, entity_id, string_agg(s, '|' ORDER BY moment) AS said, count(*) AS mention_count FROM y GROUP BY 1, 2) USING (video_id, entity_id)
JOIN (SELECT video_id, entity_id, string_agg(a, '|' ORDER BY a) AS aliases FROM n GROUP BY 1, 2) USING (video_id, entity_id)""",
    "cluster_labels": f"""WITH {values("t", "cluster, term, n, place", TERMS)} SELECT cluster, string_agg(term, ' / ' ORDER BY place) FILTER (place <= 3) AS label,
string_agg(term, ' ' ORDER BY place) AS terms FROM t GROUP BY 1""",
    "cluster_for_query": f"""WITH {values("t", "cluster, term, n, place", TERMS)}, s AS (SELECT cluster, string_agg(term, ' / ' ORDER BY place) FILTER (place <= 3) AS label,
CAST(sum(CASE WHEN contains(term, 'python code') OR contains('python code', term) THEN 5 ELSE 0 END) AS BIGINT) AS score FROM t GROUP BY 1)
SELECT cluster, label, CAST(score + CASE WHEN contains(lower(label), 'python code') THEN 10 ELSE 0 END AS BIGINT) AS score FROM s ORDER BY score DESC, cluster LIMIT 1""",
    "order_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y%m') AS month FROM orders",
    "vtt_cues": f"""WITH {values('v', 'seg_idx, start, "end", text', [(0, 1.0, 2.5, "Hello there"), (1, 3605.0, 3606.0, "Bye")])} SELECT * FROM v""",
    "json3_events": f"""WITH {values('v', 'seg_idx, start, "end", text', [(0, 0.0, 1.5, "Hello"), (1, 0.0, 0.0, "late")])} SELECT * FROM v""",
    "transcript_rows": f"""WITH {values('v', 'seg_idx, start, "end", text, speaker', [(0, 0.5, 2.0, "one", "A"), (1, 2.0, 3.0, "two", None)])} SELECT * FROM v""",
}
