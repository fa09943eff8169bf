"""Hand-derived results of the media operators, and their edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from loomcast.functions import text as X
from loomcast.functions.patterns import FAMILIES
from loomcast.operators import clusters, entities, merging, providers, search, timeline, triggers
from loomcast.plans import reports
from loomcast.sources import tables

SEG = "video_id string, seg_idx int, start double, end double, text string, speaker string"
DEMO = [
    (0.0, 5.0, "Welcome to the show"),
    (5.0, 15.0, "As you can see on the screen, we have our first topic"),
    (20.0, 30.0, "Now let's move on to the next point"),
    (30.0, 45.0, "This is really interesting stuff"),
    (50.0, 60.0, "Look at this diagram here"),
]


@pytest.fixture(scope="module")
def demo(spark):
    return spark.createDataFrame([("v", i, s, e, t, None) for i, (s, e, t) in enumerate(DEMO)], SEG)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_pauses(demo):
    assert rows(timeline.pauses(demo), "timestamp", "confidence") == [(17.5, 0.9), (47.5, 0.9)]


def test_triggers(demo):
    found = triggers.detect(demo, triggers.families_of(""))
    assert rows(found.where("rank = 0"), "timestamp") == [(5.0,), (50.0,)]
    assert rows(found.where("rank = 1"), "timestamp") == [(5.0,), (20.0,)]
    assert {r.confidence for r in found.where("rank = 1").collect()} == {0.7}


def test_every_family_compiles(demo):
    assert sum(len(f.phrases) for f in FAMILIES) == 81
    triggers.detect(demo, FAMILIES).count()


def test_merge_and_content_type(demo):
    merged = timeline.merged(demo)
    assert rows(merged, "start", "end") == [(0.0, 15.0), (20.0, 45.0), (50.0, 60.0)]
    got = triggers.content_type(merged).collect()[0]
    assert (got.content_type, got.podcast, got.lecture, got.tutorial) == ("podcast", 1, 1, 0)


def test_merge_length_and_sentence(spark):
    parts = ["I think", "that consciousness", "is fundamental"]
    df = spark.createDataFrame([("v", i, float(i), i + 1.0, t, None) for i, t in enumerate(parts)], SEG)
    assert rows(timeline.merged(df), "text") == [("I think that consciousness is fundamental",)]
    long = spark.createDataFrame([("v", i, float(i), i + 1.0, "x" * 150, None) for i in range(5)], SEG)
    assert [r.n_originals for r in timeline.merged(long).orderBy("seg_idx").collect()] == [2, 2, 1]
    ended = spark.createDataFrame([("v", 0, 0.0, 1.0, "Done. ", None), ("v", 1, 1.0, 2.0, "Next", None)], SEG)
    assert timeline.merged(ended).count() == 2


def test_density(demo):
    got = timeline.density(demo).collect()
    assert len(got) == 1
    assert (got[0].word_count, got[0].visual_references, got[0].topic_transitions) == (34, 2, 2)
    assert abs(got[0].density_score - 30.566667) < 1e-5


def test_density_has_empty_windows(spark):
    df = spark.createDataFrame([("v", 0, 0.0, 1.0, "a b", None), ("v", 1, 130.0, 131.0, "c", None)], SEG)
    assert rows(timeline.density(df), "start", "word_count") == [(0.0, 2), (60.0, 0), (120.0, 1)]


def test_keyframes(spark, demo):
    base = triggers.detect(demo, triggers.families_of("")).select("video_id", "timestamp", "rank", "trigger_type", "confidence")
    quiet = timeline.pauses(demo).select("video_id", "timestamp", F.lit(9).alias("rank"), "trigger_type", "confidence")
    length = spark.createDataFrame([("v", 60.0)], "video_id string, duration double")
    plan = timeline.keyframe_plan(demo, base.unionByName(quiet), length)
    assert rows(plan, "timestamp", "trigger_type") == [(5.0, "visual_reference"), (17.5, "significant_pause"), (47.5, "significant_pause")]
    assert timeline.top_frames(base.unionByName(quiet), 2).count() == 2


def test_paragraphs_and_speakers(spark):
    df = spark.createDataFrame(
        [("v", 0, 0.0, 2.0, "a b", "A"), ("v", 1, 2.0, 3.0, "c", None), ("v", 2, 3.0, 4.0, "d", "B"), ("v", 3, 9.0, 10.0, "e", "B")], SEG
    )
    got = timeline.paragraphs(df).orderBy("paragraph").collect()
    assert [(r.text, r.speaker) for r in got] == [("a b c", "A"), ("d", "B"), ("e", "B")]
    who = {r.speaker: (r.duration, r.words, r.share) for r in timeline.speaker_summary(df).collect()}
    assert who == {"A": (2.0, 2, 0.5), "B": (2.0, 2, 0.5)}


MEN = "video_id string, mention_idx int, entity_id string, start double, label string, text string"


def mentions(spark, items):
    return spark.createDataFrame([("v", i, e, float(t), "PERSON", e) for i, (e, t) in enumerate(items)], MEN)


def test_cooccurrence(spark):
    m = mentions(spark, [("a", 0), ("b", 10), ("c", 30), ("a", 40), ("b", 71)])
    got = {(r.entity_a, r.entity_b): (r["count"], r.timestamps) for r in entities.cooccurrences(m).collect()}
    assert got == {("a", "b"): (2, [0.0, 10.0]), ("a", "c"): (2, [0.0, 30.0]), ("b", "c"): (1, [10.0])}


def test_two_kinds_of_cooccurrence(spark):
    m = mentions(spark, [("a", 0), ("b", 5), ("b", 6)])
    assert [(r["count"], r.timestamps) for r in entities.cooccurrences(m).collect()] == [(2, [0.0])]
    assert [(r["count"], r.timestamps) for r in entities.sliding_cooccurrences(m).collect()] == [(1, [0.0])]


def test_graph(spark):
    m = mentions(spark, [("a", 0), ("b", 5), ("c", 6)])
    e = entities.entities(m)
    nodes = entities.graph_nodes(e)
    edges = entities.graph_edges(entities.cooccurrences(m), nodes)
    assert rows(edges, "entity_id", "related_id", "count") == [(x, y, 1) for x in "abc" for y in "abc" if x != y]
    assert [r.related_id for r in entities.related(edges, nodes, "a").collect()] == ["b", "c"]
    assert entities.search_entities(nodes, "A").collect()[0].score == 100
    assert entities.without_item(e, "v").count() == 0
    assert entities.alias_index(e).count() == 3
    assert rows(entities.entity_videos(e, "a"), "video_id") == [("v",)]


def test_labels_first_and_last(spark):
    m = spark.createDataFrame([("v", 0, "x", 0.0, "ORG", "x"), ("v", 1, "x", 1.0, "PERSON", "The X")], MEN)
    assert entities.entities(m).collect()[0].entity_type == "PERSON"
    first = entities.entities(m, label="first").collect()[0]
    assert (first.entity_type, first.canonical_name, first.aliases) == ("ORG", "The X", ["The X", "x"])


def test_keyword_score(spark):
    df = spark.createDataFrame([("v", 0, 0.0, 1.0, "Free will is freedom.", None), ("v", 1, 1.0, 2.0, "", None)], SEG)
    got = search.keyword(df, "free will").collect()
    assert [(r.score, r.context_before, r.context_after) for r in got] == [(15.0, "", "")]
    assert search.keyword(df, "zebra").count() == 0


def test_topics(spark):
    assert search.expanded("Yoga", [])[0] == "yoga"
    assert search.expanded("zen", ["a", "b"]) == ["zen", "a", "b"]
    df = spark.createDataFrame([("v", 0, 0.0, 1.0, "yoga pose", None)], SEG)
    assert [r.score for r in search.topic(df, ["yoga", "pose"]).collect()] == [12.5]


def test_text_functions(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).collect()[0].x
    assert [pick(X.entity_id(F.lit(s))) for s in ("Sam Harris", "New York City", "AI", "Dr. Sam Harris", "--")] == ["sam_harris", "new_york_city", "ai", "dr_sam_harris", ""]
    assert [pick(X.clock(F.lit(s))) for s in (59, 3661)] == ["0:59", "1:01:01"]
    assert pick(X.clock(F.lit(None).cast("double"), "00:00")) == "00:00"
    assert pick(X.dashed_date(F.lit("20240131"))) == "2024-01-31"
    assert pick(X.jaccard(F.lit("a b c d"), F.lit("a b c d e"))) == 0.8
    assert pick(X.jaccard(F.lit(""), F.lit("a"))) is None
    assert pick(X.media_id(F.lit("https://x.org/watch?v=abcdefghijk&t=1"))) == "abcdefghijk"
    assert pick(X.stream_kind(F.lit("rtmp://x/y"))) == "rtmp"
    assert pick(X.safe_filename(F.lit('a<b>:"c'))) == "a_b___c"
    assert pick(X.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_merging(spark):
    local = spark.createDataFrame([("v", 0, 1.0, 2.0, "hi", "x")], SEG)
    remote = spark.createDataFrame([("v", 0, 1.0, 2.0, "hi", "y"), ("v", 1, 0.5, 0.9, "yo", "z")], SEG)
    assert rows(merging.merge_transcripts(local, remote), "start", "speaker") == [(0.5, "z"), (1.0, "y")]
    old = spark.createDataFrame([("v", 0, 0.0, 10.0, "a b c d", None)], SEG)
    new = spark.createDataFrame([("v", 1, 5.0, 7.0, "gone", None), ("v", 2, 9.0, 11.0, "a b c d e", None), ("v", 3, 10.0, 12.0, "a b c", None)], SEG)
    assert rows(merging.drop_overlap(old, new), "seg_idx") == [(0,), (3,)]


def test_speaker_overlap(spark):
    seg = spark.createDataFrame([("v", 0, 0.0, 10.0, "t", "old"), ("v", 1, 50.0, 51.0, "u", "old")], SEG)
    turns = spark.createDataFrame([("v", 0, 0.0, 3.0, "A"), ("v", 1, 3.0, 7.0, "B"), ("v", 2, 7.0, 10.0, "A")], "video_id string, turn_idx int, start double, end double, speaker string")
    assert rows(merging.speakers_by_overlap(seg, turns), "seg_idx", "speaker") == [(0, "B"), (1, "old")]


def test_entity_merge(spark):
    kind = "video_id string, entity_id string, canonical_name string, aliases array<string>, mentions array<struct<start:double,text:string>>"
    a = spark.createDataFrame([("v", "x", "X", ["X"], [(1.0, "old"), (2.0, "kept")])], kind)
    b = spark.createDataFrame([("v", "x", "Y", ["x"], [(1.0, "new")])], kind)
    got = merging.merge_entities(a, b).collect()[0]
    assert (got.canonical_name, got.aliases, got.mention_count, got.mentions[0].text) == ("X", ["X", "x"], 2, "new")


def test_recognised_text(spark):
    df = spark.createDataFrame([("i", 0, "a", 0.9), ("i", 1, " ", 0.9), ("i", 2, "b", 0.2), ("j", 0, "c", 0.1)], "image string, block_idx int, text string, confidence double")
    got = {r.image: (r.ocr_text, r.confidence) for r in merging.recognised_text(df).collect()}
    assert got == {"i": ("a", 0.9), "j": ("", 0.0)}
    assert merging.readable_frames(merging.recognised_text(df)).count() == 1


def test_providers(spark, demo):
    found = providers.gazetteer_mentions({"Welcome": "EVENT", "diagram": "PRODUCT"})(demo)
    assert rows(found, "seg_idx", "text") == [(0, "Welcome"), (4, "diagram")]
    vec = providers.hashed_vectors(8)(demo).select("video_id", "seg_idx", "embedding").withColumn("model_name", F.lit("m"))
    assert providers.missing(vec, demo, "m").count() == 0
    assert providers.completed(vec.where("seg_idx < 3"), demo.select("video_id", "seg_idx", "text"), "m", lambda d: providers.hashed_vectors(8)(d)).count() == 5
    assert entities.relevant_mentions(found.withColumn("label", F.lit("DATE"))).count() == 0


def test_clusters(spark):
    vec = spark.createDataFrame([(i, [float(i % 2), 1.0 - i % 2]) for i in range(12)], "vec_id int, embedding array<double>")
    got = clusters.members(clusters.kmeans(vec, k=2, restarts=2))
    assert got.count() == 12 and got.where("similarity < 0.999").count() == 0
    texts = spark.createDataFrame([(0, 0, "Neural nets and neural code"), (0, 1, "code!")], "cluster int, rank int, text string")
    terms = clusters.top_terms(texts)
    assert [r.term for r in terms.orderBy("place").collect()] == ["neural", "code", "nets"]
    assert clusters.labels(terms).collect()[0].label == "neural / code / nets"
    assert clusters.best_cluster(clusters.labels(terms), "code").collect()[0].score == 15
    assert clusters.best_cluster(clusters.labels(terms), "zebra").count() == 0


def test_subtitles(spark, tmp_path):
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n00:00:01.000 --> 00:00:02.500\nhello\nthere\n\n00:00:03.000 --> 00:00:04.000 align:start\nno\n\n00:00:05.000 --> 00:00:06.000\nend\n\n")
    assert [tuple(r) for r in tables.vtt_segments(spark, f"{tmp_path}/a.vtt").select("start", "end", "text").orderBy("seg_idx").collect()] == [(1.0, 2.5, "hello there"), (5.0, 6.0, "end")]
    events = {"events": [{"tStartMs": 1000, "dDurationMs": 500, "segs": [{"utf8": "a "}, {"utf8": "b"}]}, {"tStartMs": 5}, {"segs": [{"utf8": "\n"}]}]}
    (tmp_path / "a.json3").write_text(json.dumps(events))
    assert [tuple(r) for r in tables.subtitle_segments(spark, f"{tmp_path}/a.json3").select("seg_idx", "start", "end", "text").collect()] == [(0, 1.0, 1.5, "a b")]
    assert tables.subtitle_segments(spark, f"{tmp_path}/a.txt").count() == 0
    (tmp_path / "t.json").write_text(json.dumps({"segments": [{"start": 1.0, "end": 2.0, "text": "x"}]}))
    assert tables.read_transcript(spark, f"{tmp_path}/t.json").collect()[0].text == "x"


def test_digest(spark, demo):
    media = spark.createDataFrame([("v", None, None, 60.0, "20240131", "d" * 1200)], "video_id string, title string, channel string, duration double, upload_date string, description string")
    m = mentions(spark, [("a", 0), ("b", 5)])
    got = reports.digest(media, demo, entities.entities(m), entities.cooccurrences(m)).collect()[0].markdown
    assert got.startswith("# v\n\nUnknown, 1:00, 2024-01-31\n\n" + "d" * 1000 + "...")
    assert "- a (PERSON): 1 mentions, first at 0:00" in got and "- a and b: 1" in got and "**[0:20]**" in got


def test_empty_tables(spark):
    none = spark.createDataFrame([], SEG)
    for f in (timeline.pauses, timeline.merged, timeline.paragraphs, timeline.speaker_summary, timeline.density):
        assert f(none).count() == 0
    assert search.keyword(none, "x").count() == 0
    assert entities.cooccurrences(spark.createDataFrame([], MEN)).count() == 0
