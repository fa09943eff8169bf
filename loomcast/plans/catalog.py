"""Registered queries of the media operators and, beside each, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.session import reach_package, scratch
from ..functions.patterns import Family
from ..operators import clusters, entities, merging, search, timeline, triggers
from ..sources import tables as S
from ..streaming import live
from . import reports, spoken

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Phrases over words that the driver's texts have; the fixed families speak English prose and match next to nothing.
ADAPTED = (
    Family("visual", "visual_reference", 0.8, "podcast", False, 100, False, ("that the", "this was")),
    Family("transition", "topic_transition", 0.7, "lecture", False, 100, False, ("with the", "and that", "from the")),
    Family("feature", "tutorial_feature", 0.9, "tutorial", False, 80, True, ("for the", "are to")),
)

SEG = """seg AS (SELECT conv_id AS video_id, turn AS seg_idx, CAST(10 * turn + (conv_id + turn) % 4 AS DOUBLE) AS start,
  CAST(10 * turn + (conv_id + turn) % 4 + 2 + length(text) % 9 AS DOUBLE) AS "end", text, role AS speaker
  FROM conversations WHERE text IS NOT NULL)"""
MEN = """men AS (SELECT user_id % 4 AS video_id, event_id AS mention_idx, event_type AS entity_id,
  'K' || json_extract_string(props, '$.k') AS label, epoch_us(ts) / 1e6 AS start, user_id FROM events)"""
NEAR = """near AS (SELECT l.video_id, least(l.entity_id, r.entity_id) AS entity_a, greatest(l.entity_id, r.entity_id) AS entity_b,
  l.start AS "at", l.mention_idx AS early_idx, r.mention_idx AS late_idx FROM men l JOIN men r ON l.video_id = r.video_id
  AND r.start >= l.start AND r.start - l.start <= 30 AND l.entity_id <> r.entity_id
  AND (r.start > l.start OR r.mention_idx > l.mention_idx))"""
ENT = """ent AS (SELECT video_id, entity_id, arg_max(label, (start, mention_idx)) AS entity_type, entity_id AS canonical_name,
  count(*) AS mention_count, min(start) AS first_seen FROM men GROUP BY 1, 2)"""
COOC = """cooc AS (SELECT video_id, entity_a, entity_b, count(*) AS count FROM near GROUP BY 1, 2, 3)"""
WORDS = "len(list_filter(regexp_split_to_array(coalesce({0}, ''), '\\s+'), lambda x: x <> ''))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def keyword_sql(q: str) -> str:
    parts = [f"(CASE WHEN contains(lower(text), '{q.lower()}') THEN 10.0 ELSE 0.0 END)"]
    for w in dict.fromkeys(q.lower().split()):
        parts.append(f"(CASE WHEN list_contains(words, '{w}') THEN 2.0 ELSE 0.0 END)")
        parts.append(f"(CASE WHEN len(list_filter(words, lambda x: contains(x, '{w}'))) > 0 THEN 0.5 ELSE 0.0 END)")
    return "CAST(" + " + ".join(parts) + " AS DOUBLE)"


SCORED = """w AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS words,
  substr(coalesce(lag(text) OVER i, ''), 1, 100) AS context_before, substr(coalesce(lead(text) OVER i, ''), 1, 100) AS context_after
  FROM seg WINDOW i AS (PARTITION BY video_id ORDER BY seg_idx))"""


@query(f"""WITH {SEG}, {SCORED}
SELECT video_id, seg_idx, start AS timestamp, text, score, context_before, context_after
FROM (SELECT *, {keyword_sql("that the")} AS score FROM w) WHERE score > 0 ORDER BY score DESC, video_id, seg_idx LIMIT 20""")
def keyword_search(spark, d):
    return search.keyword(S.conversation_segments(spark, d), "that the")


@query(f"""WITH {SEG}, {SCORED}, t AS (
  SELECT 0 AS term, video_id, seg_idx, start AS timestamp, text, {keyword_sql("thought")} AS score FROM w
  UNION ALL SELECT 1, video_id, seg_idx, start, text, {keyword_sql("with")} FROM w
  UNION ALL SELECT 2, video_id, seg_idx, start, text, {keyword_sql("from the")} FROM w
), r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, video_id, seg_idx) AS rk FROM t WHERE score > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY video_id, floor(timestamp) ORDER BY term, rk) AS nth FROM r WHERE rk <= 20)
SELECT video_id, seg_idx, timestamp, text, score FROM f WHERE nth = 1 ORDER BY score DESC, video_id, seg_idx LIMIT 10""")
def topic_search(spark, d):
    return search.topic(S.conversation_segments(spark, d), ["thought", "with", "from the"])


@query(f"""WITH {SEG}, {SCORED}, h AS (SELECT video_id, count(*) AS hits, max(score) AS best FROM (SELECT *, {keyword_sql("that the")} AS score FROM w) WHERE score > 0 GROUP BY 1)
SELECT h.video_id, hits, best, coalesce(d.lang || ' ' || CAST(d.doc_id AS VARCHAR), CAST(h.video_id AS VARCHAR)) AS video_title
FROM h LEFT JOIN documents d ON d.doc_id = h.video_id""")
def search_hits_titled(spark, d):
    hits = search.scored(S.conversation_segments(spark, d), "that the").groupBy("video_id").agg(F.count("*").alias("hits"), F.max("score").alias("best"))
    return search.titled(hits, S.document_media(spark, d))


@query(f"""WITH {SEG}, p AS (SELECT *, lag("end") OVER (PARTITION BY video_id ORDER BY seg_idx) AS b FROM seg)
SELECT video_id, b + (start - b) / 2 AS timestamp, 'significant_pause' AS trigger_type, least(0.5 + (start - b) / 10, 0.9) AS confidence, start - b AS gap
FROM p WHERE start - b >= 3""")
def pause_detection(spark, d):
    return timeline.pauses(S.conversation_segments(spark, d))


@query(f"""WITH {SEG}, a AS (SELECT *, lag("end") OVER i AS be, last_value(nullif(speaker, '') IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bs,
  last_value(nullif(speaker, '') IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS who,
  row_number() OVER i AS rn FROM seg WINDOW i AS (PARTITION BY video_id ORDER BY seg_idx)),
b AS (SELECT *, sum(CASE WHEN rn > 1 AND (start - coalesce(be, 0) > 2 OR (nullif(speaker, '') IS NOT NULL AND speaker IS DISTINCT FROM bs)) THEN 1 ELSE 0 END)
  OVER (PARTITION BY video_id ORDER BY seg_idx) AS paragraph FROM a)
SELECT video_id, CAST(paragraph AS BIGINT) AS paragraph, arg_min(start, seg_idx) AS start, arg_max("end", seg_idx) AS "end", arg_max(who, seg_idx) AS speaker, count(*) AS segments,
  string_agg(text, ' ' ORDER BY seg_idx) AS text FROM b GROUP BY 1, 2""")
def paragraphs(spark, d):
    return timeline.paragraphs(S.conversation_segments(spark, d))


@query(f"""WITH {SEG}, s AS (SELECT video_id, speaker, sum("end" - start) AS duration, count(*) AS segments, CAST(sum({WORDS.format("text")}) AS BIGINT) AS words
  FROM seg WHERE speaker IS NOT NULL AND speaker <> '' GROUP BY 1, 2)
SELECT *, CASE WHEN sum(duration) OVER (PARTITION BY video_id) > 0 THEN duration / sum(duration) OVER (PARTITION BY video_id) ELSE 0.0 END AS share FROM s""")
def speaker_summary(spark, d):
    return timeline.speaker_summary(S.conversation_segments(spark, d))


@query(f"""WITH {SEG}, s AS (SELECT video_id, unnest(range(0, CAST(ceil(max("end") / 60) AS BIGINT))) AS slot FROM seg GROUP BY video_id HAVING max("end") > 0),
c AS (SELECT video_id, CAST(floor(start / 60) AS BIGINT) AS slot, CAST(sum({WORDS.format("text")}) AS BIGINT) AS word_count FROM seg GROUP BY 1, 2)
SELECT video_id, slot * 60.0::DOUBLE AS start, (slot + 1) * 60.0::DOUBLE AS "end", coalesce(word_count, 0) AS word_count, 0::BIGINT AS visual_references, 0::BIGINT AS topic_transitions,
  coalesce(word_count, 0) / 60.0::DOUBLE AS density_score FROM s LEFT JOIN c USING (video_id, slot)""")
def density_windows(spark, d):
    return timeline.density(S.conversation_segments(spark, d))


@query(f"""WITH RECURSIVE {SEG}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) AS rn, start - lag("end") OVER (PARTITION BY video_id ORDER BY seg_idx) AS gap,
  lag(text) OVER (PARTITION BY video_id ORDER BY seg_idx) AS pt FROM seg),
m AS (SELECT video_id, rn, 0 AS grp, text AS acc FROM o WHERE rn = 1
  UNION ALL SELECT o.video_id, o.rn, CASE WHEN o.gap > 1 OR length(m.acc) > 200 OR regexp_matches(m.acc, '[.!?]\\s*$') THEN m.grp + 1 ELSE m.grp END,
    CASE WHEN o.gap > 1 OR length(m.acc) > 200 OR regexp_matches(m.acc, '[.!?]\\s*$') THEN o.text ELSE m.acc || ' ' || o.text END
  FROM m JOIN o ON o.video_id = m.video_id AND o.rn = m.rn + 1)
SELECT m.video_id, CAST(grp AS BIGINT) AS seg_idx, arg_min(start, rn) AS start, arg_max("end", rn) AS "end", trim(string_agg(text, ' ' ORDER BY rn)) AS text, count(*) AS n_originals
FROM m JOIN o USING (video_id, rn) GROUP BY 1, 2""")
def merge_segments(spark, d):
    return timeline.merged(S.conversation_segments(spark, d)).withColumn("seg_idx", F.col("seg_idx").cast("long"))


def adapted_sql(i: int, f: Family) -> str:
    ctx = "lower(text)" if f.lower_context else "text"
    return f"SELECT video_id, seg_idx, start AS timestamp, {i} AS rank, '{f.trigger}' AS trigger_type, {f.confidence}::DOUBLE AS confidence, '{f.content}' AS content, substr({ctx}, 1, {f.context}) AS context FROM seg WHERE regexp_matches(lower(text), '{f.pattern}')"


TRIG = "trig AS (" + " UNION ALL ".join(adapted_sql(i, f) for i, f in enumerate(ADAPTED)) + ")"


@query(f"WITH {SEG}, {TRIG} SELECT * FROM trig")
def trigger_scan(spark, d):
    return triggers.detect(S.conversation_segments(spark, d), ADAPTED)


@query(f"WITH {SEG}, {TRIG} SELECT video_id, trigger_type, count(*) AS triggers FROM trig GROUP BY 1, 2")
def trigger_counts(spark, d):
    return triggers.trigger_counts(triggers.detect(S.conversation_segments(spark, d), ADAPTED))


@query(f"""WITH {SEG}, c AS (SELECT video_id, {", ".join(f"count(*) FILTER (regexp_matches(lower(text), '{f.pattern}')) AS {f.content}" for f in ADAPTED)} FROM seg GROUP BY 1)
SELECT video_id, CASE WHEN podcast = greatest(podcast, lecture, tutorial) THEN 'podcast' WHEN lecture = greatest(podcast, lecture, tutorial) THEN 'lecture' ELSE 'tutorial' END AS content_type,
  greatest(podcast, lecture, tutorial) AS triggers, podcast, lecture, tutorial FROM c""")
def content_type(spark, d):
    return triggers.content_type(S.conversation_segments(spark, d), ADAPTED)


@query(f"""WITH RECURSIVE {SEG}, {TRIG}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, rank, trigger_type, confidence) AS rn FROM trig),
g AS (SELECT video_id, rn, timestamp AS last, true AS taken FROM o WHERE rn = 1
  UNION ALL SELECT o.video_id, o.rn, CASE WHEN o.timestamp - g.last >= 10 THEN o.timestamp ELSE g.last END, o.timestamp - g.last >= 10 FROM g JOIN o ON o.video_id = g.video_id AND o.rn = g.rn + 1),
t AS (SELECT o.video_id, o.timestamp, o.trigger_type, o.confidence FROM g JOIN o USING (video_id, rn) WHERE taken),
e AS (SELECT video_id, min(timestamp) AS first, max(timestamp) AS last FROM t GROUP BY 1), m AS (SELECT video_id, max("end") AS duration FROM seg GROUP BY 1)
SELECT * FROM t UNION ALL SELECT video_id, 1.0, 'start', 1.0 FROM e WHERE first > 5
UNION ALL SELECT m.video_id, duration - 5, 'end', 1.0 FROM m LEFT JOIN e USING (video_id) WHERE duration > 30 AND (last IS NULL OR last < duration - 30)""")
def keyframe_plan(spark, d):
    seg = S.conversation_segments(spark, d)
    return timeline.keyframe_plan(seg, triggers.detect(seg, ADAPTED), seg.groupBy("video_id").agg(F.max("end").alias("duration")))


@query(f"""WITH {SEG}, {TRIG}, a AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, rank) AS arrival FROM trig),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, timestamp, rank) AS place FROM a WHERE arrival <= 6)
SELECT video_id, timestamp, trigger_type, confidence FROM b WHERE place <= 3""")
def frame_triggers(spark, d):
    found = timeline.top_frames(triggers.detect(S.conversation_segments(spark, d), ADAPTED), 3)
    return found.select("video_id", "timestamp", "trigger_type", "confidence")


@query(f"""WITH {MEN}, {NEAR} SELECT video_id, entity_a, entity_b, count(*) AS count, list_slice(list_sort(list(DISTINCT "at")), 1, 50) AS timestamps FROM near GROUP BY 1, 2, 3""")
def cooccurrence_pairs(spark, d):
    return entities.cooccurrences(S.event_mentions(spark, d))


@query(f"""WITH {MEN}, j AS (SELECT l.video_id, l.entity_id AS entity_a, r.entity_id AS entity_b, l.mention_idx, any_value(l.start) AS s, arg_min(r.start, r.mention_idx) AS t
  FROM men l JOIN men r ON l.video_id = r.video_id AND l.entity_id < r.entity_id AND abs(l.start - r.start) <= 30 GROUP BY 1, 2, 3, 4),
k AS (SELECT video_id, entity_a, entity_b, list_slice(list_sort(list(DISTINCT least(s, t))), 1, 50) AS timestamps FROM j GROUP BY 1, 2, 3)
SELECT *, CAST(len(timestamps) AS BIGINT) AS count FROM k""")
def cooccurrence_sliding(spark, d):
    return entities.sliding_cooccurrences(S.event_mentions(spark, d))


@query(f"WITH {MEN}, {NEAR} SELECT DISTINCT video_id, entity_a, entity_b FROM near")
def recent_pairs(spark, d):
    return entities.recent_pairs(S.event_mentions(spark, d))


def _mentions(spark, d):
    return S.event_mentions(spark, d).withColumn("text", F.col("entity_id"))


@query(f"WITH {MEN}, {ENT} SELECT *, [entity_id] AS aliases FROM ent")
def entity_rollup(spark, d):
    return entities.entities(_mentions(spark, d))


@query(f"""WITH {MEN} SELECT video_id, entity_id, arg_min(label, (start, mention_idx)) AS entity_type, count(*) AS mention_count FROM men GROUP BY 1, 2""")
def entity_types_first(spark, d):
    return entities.entities(_mentions(spark, d), label="first").select("video_id", "entity_id", "entity_type", "mention_count")


@query("""SELECT p_brand AS entity_id, arg_max(p_name, (CASE WHEN regexp_matches(substr(p_name, 1, 1), '[A-Z]') THEN 1 ELSE 0 END, CASE WHEN contains(p_name, ' ') THEN 1 ELSE 0 END, least(length(p_name), 50), p_name)) AS canonical_name,
  count(DISTINCT p_name) AS aliases FROM part GROUP BY 1""")
def canonical_name(spark, d):
    p = S.table(spark, d, "part")
    best = F.max(X.name_rank(F.col("p_name")))["name"].alias("canonical_name")
    return p.groupBy(F.col("p_brand").alias("entity_id")).agg(best, F.countDistinct("p_name").alias("aliases"))


@query(f"""WITH {MEN}, {ENT} SELECT lower(entity_id) AS alias, arg_max(entity_id, (video_id, entity_id)) AS entity_id FROM ent GROUP BY lower(entity_id)""")
def alias_index(spark, d):
    return entities.alias_index(entities.entities(_mentions(spark, d)))


NODES = """nodes AS (SELECT entity_id, arg_min(canonical_name, video_id) AS canonical_name, arg_min(entity_type, video_id) AS entity_type, count(DISTINCT video_id) AS total_videos,
  CAST(sum(mention_count) AS BIGINT) AS total_mentions, [entity_id] AS aliases FROM ent GROUP BY entity_id)"""
EDGES = """edges AS (SELECT entity_id, related_id, CAST(sum(count) AS BIGINT) AS count, count(DISTINCT video_id) AS videos FROM (
  SELECT entity_a AS entity_id, entity_b AS related_id, count, video_id FROM cooc UNION ALL SELECT entity_b, entity_a, count, video_id FROM cooc) GROUP BY 1, 2)"""


@query(f"WITH {MEN}, {ENT}, {NODES} SELECT * FROM nodes")
def global_graph_nodes(spark, d):
    return entities.graph_nodes(entities.entities(_mentions(spark, d)))


@query(f"WITH {MEN}, {NEAR}, {COOC}, {EDGES} SELECT * FROM edges")
def global_graph_edges(spark, d):
    return entities.graph_edges(entities.cooccurrences(_mentions(spark, d)), global_graph_nodes(spark, d))


@query(f"""WITH {MEN}, {ENT}, {NODES} SELECT entity_id, total_videos, total_mentions FROM (SELECT entity_id, arg_min(canonical_name, video_id) AS n, count(DISTINCT video_id) AS total_videos,
  CAST(sum(mention_count) AS BIGINT) AS total_mentions FROM ent WHERE video_id <> 3 GROUP BY entity_id)""")
def graph_without_item(spark, d):
    left = entities.without_item(entities.entities(_mentions(spark, d)), 3)
    return entities.graph_nodes(left).select("entity_id", "total_videos", "total_mentions")


@query(f"""WITH {MEN}, {NEAR}, {COOC}, {EDGES} SELECT related_id, related_id AS canonical_name, count FROM edges
WHERE entity_id = (SELECT min(event_type) FROM events) ORDER BY count DESC, related_id LIMIT 10""")
def related_entities(spark, d):
    edges, nodes = global_graph_edges(spark, d), global_graph_nodes(spark, d)
    least = S.table(spark, d, "events").agg(F.min("event_type").alias("entity_id"))  # one row
    names = nodes.select(F.col("entity_id").alias("related_id"), "canonical_name")
    mine = edges.join(F.broadcast(least), "entity_id", "left_semi").join(names, "related_id")
    return mine.select("related_id", "canonical_name", "count").orderBy(F.desc("count"), "related_id").limit(10)


@query(f"""WITH {MEN}, {ENT}, {NODES} SELECT entity_id, total_mentions, CASE WHEN entity_id = 'click' THEN 100 WHEN lower(entity_id) = 'click' THEN 90 WHEN contains(lower(canonical_name), 'click') THEN 70 WHEN contains(entity_id, 'click') THEN 50 ELSE 0 END AS score
FROM nodes WHERE contains(lower(canonical_name), 'click') ORDER BY score DESC, total_mentions DESC, entity_id LIMIT 10""")
def entity_search(spark, d):
    return entities.search_entities(global_graph_nodes(spark, d), "click").select("entity_id", "total_mentions", "score")


@query(f"""WITH {MEN}, {ENT}, {NODES}, b AS (SELECT entity_id FROM nodes WHERE contains(lower(canonical_name), 'c') ORDER BY CASE WHEN entity_id = 'c' THEN 100 ELSE 70 END DESC, total_mentions DESC, entity_id LIMIT 1)
SELECT video_id, mention_idx, entity_id, start, 15.0::DOUBLE AS score FROM men SEMI JOIN b USING (entity_id) ORDER BY video_id, start, mention_idx LIMIT 20""")
def entity_mentions(spark, d):
    best = entities.search_entities(global_graph_nodes(spark, d), "c")
    return search.by_entity(_mentions(spark, d), best).select("video_id", "mention_idx", "entity_id", "start", "score")


@query(f"""WITH {MEN}, {ENT} SELECT video_id, mention_count FROM ent WHERE entity_id = 'click'""")
def entity_videos(spark, d):
    return entities.entity_videos(entities.entities(_mentions(spark, d)), "click")


QUERY_VECTOR = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


@query(f"""SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({QUERY_VECTOR} AS DOUBLE[])), 6) AS similarity FROM embeddings
WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({QUERY_VECTOR} AS DOUBLE[])) > 0.3 ORDER BY similarity DESC, vec_id LIMIT 20""")
def semantic_topk(spark, d):
    vectors = S.table(spark, d, "embeddings")
    asked = vectors.orderBy("vec_id").limit(1).select("embedding").collect()  # one vector; none of an empty table
    return search.semantic(vectors, list(asked[0].embedding) if asked else [0.0]).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("""WITH c AS (SELECT label AS cluster, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT cluster, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM c),
m AS (SELECT cluster, list(a ORDER BY i) AS centre FROM (SELECT cluster, i, avg(x) AS a FROM u GROUP BY 1, 2) GROUP BY 1), s AS (SELECT cluster, vec_id, list_cosine_similarity(e, centre) AS s FROM c JOIN m USING (cluster))
SELECT cluster, vec_id, round(s, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY s DESC, vec_id) <= 10""")
def cluster_members(spark, d):
    rows = S.table(spark, d, "embeddings").select(F.col("label").alias("cluster"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    flat = rows.select("cluster", F.posexplode("embedding").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("a"))
    centre = flat.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda p: p["a"]).alias("centre"))
    return clusters.members(rows.join(centre, "cluster"), least=1).where("rank <= 10").select("cluster", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("""WITH t AS (SELECT source AS cluster, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, text FROM documents WHERE text IS NOT NULL),
w AS (SELECT cluster, rank, generate_subscripts(a, 1) AS pos, regexp_replace(unnest(a), '[^\\p{L}\\p{N}]', '', 'g') AS term FROM (SELECT cluster, rank, regexp_split_to_array(lower(text), '\\s+') AS a FROM t WHERE rank <= 20)),
c AS (SELECT cluster, term, count(*) AS n, min((rank, pos)) AS seen FROM w WHERE length(term) > 2 AND term NOT IN (STOP) GROUP BY 1, 2)
SELECT cluster, term, n, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, seen) AS place FROM c) WHERE place <= 5""".replace(
    "STOP", ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(clusters.STOPWORDS))
))
def cluster_top_terms(spark, d):
    docs = S.table(spark, d, "documents").where("text is not null")
    return clusters.top_terms(docs.select(F.col("source").alias("cluster"), F.col("doc_id").alias("rank"), "text"))


@query()
def kmeans_topics(spark, d):
    got = clusters.kmeans(S.table(spark, d, "embeddings").select("vec_id", "embedding", "label"), restarts=3)
    return clusters.members(got).groupBy("cluster").agg(F.count("*").alias("size"), F.round(F.avg("similarity"), 6).alias("mean_similarity"))


TURNS = """turns AS (SELECT video_id, seg_idx AS turn_idx, start + 3 AS start, "end" + 3 AS "end", 'S' || CAST(seg_idx % 3 AS VARCHAR) AS speaker FROM seg)"""


@query(f"""WITH {SEG}, {TURNS}, o AS (SELECT s.video_id, s.seg_idx, arg_max(t.speaker, (least(s."end", t."end") - greatest(s.start, t.start), -t.turn_idx)) AS who
  FROM seg s JOIN turns t ON s.video_id = t.video_id AND s.start < t."end" AND t.start < s."end" GROUP BY 1, 2)
SELECT video_id, seg_idx, start, coalesce(who, speaker) AS speaker FROM seg LEFT JOIN o USING (video_id, seg_idx)""")
def speaker_overlap(spark, d):
    seg = S.conversation_segments(spark, d)
    turns = seg.select("video_id", F.col("seg_idx").alias("turn_idx"), (F.col("start") + 3).alias("start"), (F.col("end") + 3).alias("end"), F.concat(F.lit("S"), (F.col("seg_idx") % 3).cast("string")).alias("speaker"))
    return merging.speakers_by_overlap(seg, turns).select("video_id", "seg_idx", "start", "speaker")


@query(f"""WITH {SEG}, b AS (SELECT *, 0 AS src FROM seg UNION ALL SELECT video_id, seg_idx, start, "end" + 1, text, 'remote', 1 FROM seg WHERE seg_idx % 2 = 0)
SELECT video_id, start, arg_max("end", (src, seg_idx)) AS "end", arg_max(text, (src, seg_idx)) AS text, arg_max(speaker, (src, seg_idx)) AS speaker FROM b GROUP BY video_id, start, substr(text, 1, 50)""")
def merge_lww(spark, d):
    seg = S.conversation_segments(spark, d)
    remote = seg.where("seg_idx % 2 = 0").withColumn("end", F.col("end") + 1).withColumn("speaker", F.lit("remote"))
    return merging.merge_transcripts(seg, remote)


@query(f"""WITH {SEG}, x AS (SELECT * FROM seg WHERE seg_idx < 4), n AS (SELECT video_id, seg_idx, start, "end", text, speaker FROM seg WHERE seg_idx >= 2),
l AS (SELECT video_id, arg_max("end", seg_idx) AS last FROM x GROUP BY 1), t AS (SELECT video_id, text AS old FROM x QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY seg_idx DESC) <= 5),
ws AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda v: v <> '')) AS a FROM n),
wt AS (SELECT video_id, list_distinct(list_filter(regexp_split_to_array(lower(old), '\\s+'), lambda v: v <> '')) AS b FROM t),
f AS (SELECT ws.* FROM ws LEFT JOIN l USING (video_id) WHERE last IS NULL OR ws."end" > last - 3)
SELECT video_id, seg_idx, start, "end", text, speaker FROM x UNION ALL
SELECT video_id, seg_idx, start, "end", text, speaker FROM f WHERE NOT EXISTS (SELECT 1 FROM wt WHERE wt.video_id = f.video_id AND len(a) > 0 AND len(b) > 0
  AND len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.8)""")
def overlap_dedupe(spark, d):
    seg = S.conversation_segments(spark, d)
    return merging.drop_overlap(seg.where("seg_idx < 4"), seg.where("seg_idx >= 2"))


@query("""SELECT doc_id AS video_id, lang || ' ' || CAST(doc_id AS VARCHAR) AS title, source AS channel, CAST(n_chars AS DOUBLE) AS duration FROM documents""")
def catalog_list(spark, d):
    return search.catalogue(S.document_media(spark, d))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' & ' || p_type), '[^a-z0-9]+', '_', 'g'), '_') AS entity_id, substr(md5(p_name), 1, 11) AS local_id, substr(sha256(p_name), 1, 16) AS checksum FROM part""")
def normalize_ids(spark, d):
    name = F.concat("p_name", F.lit(" & "), "p_type")
    return S.table(spark, d, "part").select("p_partkey", X.entity_id(name).alias("entity_id"), X.local_id(F.col("p_name")).alias("local_id"), X.checksum(F.col("p_name")).alias("checksum"))


@query("""SELECT doc_id, CASE WHEN n_chars >= 3600 THEN printf('%d:%02d:%02d', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) ELSE printf('%d:%02d', n_chars // 60, n_chars % 60) END AS clock FROM documents""")
def format_duration(spark, d):
    return S.table(spark, d, "documents").select("doc_id", X.clock(F.col("n_chars")).alias("clock"))


@query("""SELECT page_id, coalesce(nullif(regexp_extract(url, '(?:v=|/v/|youtu\\.be/)([a-zA-Z0-9_-]{11})', 1), ''), nullif(regexp_extract(url, '([a-zA-Z0-9_-]{11})', 1), '')) AS media_id,
  CASE WHEN contains(lower(url), '.m3u8') OR contains(lower(url), '/hls/') THEN 'hls' WHEN regexp_matches(lower(url), '^rtmps?://') THEN 'rtmp' WHEN contains(lower(url), 'twitch.tv/') THEN 'twitch'
    WHEN regexp_matches(lower(url), 'youtube\\.com/live/|youtu\\.be/live/') THEN 'youtube_live' END AS kind, translate(substr(url, 1, 200), '<>:"/\\|?*', '_________') AS file FROM pages""")
def classify_urls(spark, d):
    url = F.col("url")
    return S.table(spark, d, "pages").select("page_id", X.media_id(url).alias("media_id"), X.stream_kind(url).alias("kind"), X.safe_filename(url).alias("file"))


@query(f"""WITH {MEN} SELECT video_id, entity_id, max(start) AS last_seen, count(*) AS mentions, min(start) AS first_seen FROM men GROUP BY 1, 2""")
def entity_spans(spark, d):
    return _mentions(spark, d).groupBy("video_id", "entity_id").agg(F.max("start").alias("last_seen"), F.count("*").alias("mentions"), F.min("start").alias("first_seen"))


@query("""SELECT time_bucket(INTERVAL 30 SECOND, ts) AS chunk_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_chunks(spark, d):
    e = S.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = e.groupBy(F.window("ts", "30 seconds").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("chunk_start"), "event_type", "events", "total")


@query(f"""WITH {MEN}, {ENT}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id, entity_type ORDER BY mention_count DESC, entity_id) AS rank FROM ent)
SELECT video_id, entity_type, entity_id, mention_count, first_seen, rank FROM r WHERE rank <= 8""")
def digest_entities(spark, d):
    top = reports.top_entities(entities.entities(_mentions(spark, d)))
    return top.select("video_id", "entity_type", "entity_id", "mention_count", "first_seen", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {SEG}, {MEN}, {NEAR}, {ENT}, {COOC}, s AS (SELECT video_id, count(*) AS segments, CAST(sum({WORDS.format("text")}) AS BIGINT) AS words, max("end") AS duration FROM seg GROUP BY 1),
e AS (SELECT video_id, count(*) AS entities, CAST(sum(mention_count) AS BIGINT) AS mentions FROM ent GROUP BY 1), p AS (SELECT video_id, count(*) AS pairs FROM cooc GROUP BY 1)
SELECT video_id, segments, words, duration, coalesce(entities, 0) AS entities, coalesce(mentions, 0) AS mentions, coalesce(pairs, 0) AS pairs FROM s LEFT JOIN e USING (video_id) LEFT JOIN p USING (video_id)""")
def manifest_stats(spark, d):
    m = _mentions(spark, d)
    return reports.manifest(S.conversation_segments(spark, d), entities.entities(m), entities.cooccurrences(m))


@query(f"""WITH {MEN}, {NEAR}, {ENT}, {COOC}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id, entity_type ORDER BY mention_count DESC, entity_id) AS rk FROM ent),
t AS (SELECT video_id, 'entity' AS part, row_number() OVER (PARTITION BY video_id ORDER BY entity_type, rk) AS place, entity_type || ' ' || canonical_name AS line, mention_count AS n FROM r WHERE rk <= 5),
q AS (SELECT video_id, 'pair' AS part, row_number() OVER (PARTITION BY video_id ORDER BY count DESC, entity_a, entity_b) AS place, entity_a || ' ' || entity_b AS line, count AS n FROM cooc)
SELECT * FROM t UNION ALL SELECT * FROM q WHERE place <= 10""")
def partial_digest(spark, d):
    m = _mentions(spark, d)
    return reports.partial_digest(entities.entities(m), entities.cooccurrences(m)).withColumn("place", F.col("place").cast("long"))


@query()
def item_digest(spark, d):
    seg, m = S.conversation_segments(spark, d), _mentions(spark, d)
    media = seg.groupBy("video_id").agg(F.max("end").alias("duration")).select("video_id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("channel"), "duration", F.lit("20240131").alias("upload_date"), F.lit("").alias("description"))
    return reports.digest(media, seg, entities.entities(m), entities.cooccurrences(m))


@query(f"""WITH {SEG} SELECT video_id, seg_idx, substr(string_agg(text, ' ') OVER (PARTITION BY video_id ORDER BY seg_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 1, 200) AS context FROM seg""")
def mention_context(spark, d):
    return entities.with_context(S.conversation_segments(spark, d)).select("video_id", "seg_idx", "context")


@query("""SELECT page_id AS image, string_agg(trim(t), ' ' ORDER BY i) AS ocr_text, avg(c) AS confidence, count(*) AS blocks FROM (
  SELECT page_id, generate_subscripts(a, 1) AS i, unnest(a) AS t FROM (SELECT page_id, string_split(url, '/') AS a FROM pages)), LATERAL (SELECT ((page_id + i) % 10) / 10.0::DOUBLE AS c)
WHERE c >= 0.3 AND trim(t) <> '' GROUP BY 1 HAVING avg(c) > 0.3""")
def readable_frames(spark, d):
    parts = S.table(spark, d, "pages").select(F.col("page_id").alias("image"), F.posexplode(F.split("url", "/")).alias("p", "text"))
    blocks = parts.select("image", (F.col("p") + 1).alias("block_idx"), "text", (((F.col("image") + F.col("p") + 1) % 10) / 10.0).alias("confidence"))
    return merging.readable_frames(merging.recognised_text(blocks))


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The event table, a file or a folder of files, as a file stream of mentions (a stream takes one file as a pattern only)."""
    kind = S.table(spark, d, "events").schema
    raw = spark.readStream.schema(kind).parquet(f"{d.rstrip('/')}/events.parque[t]")
    return raw.select((F.col("user_id") % 4).alias("video_id"), F.col("event_type").alias("entity_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("start"))


@query(f"""WITH {MEN} SELECT CAST(video_id AS BIGINT) AS video_id, entity_id, count(*) AS mention_count, min(start) AS first_seen, max(start) AS last_seen FROM men GROUP BY 1, 2""")
def stream_entities(spark, d):
    out = scratch(spark, "stream-entities")
    live.upserted(live.running_entities(_event_stream(spark, d)), f"{out}/rows", f"{out}/state").awaitTermination()
    got = spark.read.parquet(f"{out}/rows")
    newest = got.groupBy("video_id", "entity_id").agg(F.max_by(F.struct("mention_count", "first_seen", "last_seen"), "version").alias("x"))
    return newest.select("video_id", "entity_id", "x.*")


@query(f"""WITH {MEN}, {NEAR} SELECT DISTINCT CAST(video_id AS VARCHAR) AS video_id, entity_a, entity_b FROM near""")
def stream_cooccurrence(spark, d):
    reach_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = scratch(spark, "stream-pairs")
    live.appended(live.new_pairs(_event_stream(spark, d)), f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.schema(live.PAIRS).parquet(f"{out}/rows").select("video_id", "entity_a", "entity_b")


@query("""SELECT event_id, event_type, ts FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) WHERE event_type = 'click'""")
def event_history(spark, d):
    return live.recent_events(S.table(spark, d, "events"), "click").select("event_id", "event_type", "ts")


@query("""SELECT page_id, 'LIVE_20240131_101530_' || substr(md5(url), 1, 8) AS stream_id FROM pages""")
def stream_ids(spark, d):
    started = F.to_timestamp(F.lit("2024-01-31 10:15:30"))
    return S.table(spark, d, "pages").select("page_id", live.stream_id(F.col("url"), started).alias("stream_id"))


QUERIES.update(spoken.QUERIES)
ORACLE_SQL.update(spoken.ORACLE_SQL)
