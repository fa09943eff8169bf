"""The fixed phrases and small fixtures: every query against its SQL in DuckDB."""

import duckdb
import pytest

from loomcast.operators import clusters, triggers
from loomcast.plans import spoken


def rows_of(columns, rows):
    order = sorted(columns)
    return sorted((tuple(round(r[columns.index(c)], 9) if isinstance(r[columns.index(c)], float) else r[columns.index(c)] for c in order) for r in rows), key=str)


@pytest.mark.parametrize("name", [n for n in spoken.QUERIES if n != "order_dates"])
def test_query_equals_sql(spark, name):
    got = spoken.QUERIES[name](spark, "")
    asked = duckdb.connect().execute(spoken.ORACLE_SQL[name])
    want = asked.fetchall()
    assert want and rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of([x[0] for x in asked.description], want)


def test_every_family_is_heard(spark):
    heard = {r.trigger_type for q in (spoken.phrase_triggers, spoken.merged_phrase_triggers) for r in q(spark, "").collect()}
    assert {f.trigger for f in spoken.RAW + spoken.JOINED} == heard


def test_nothing_said(spark):
    none = spoken.spoken(spark).where("video_id < 0")
    assert triggers.analyzed(none, "podcast").count() == 0 and triggers.best_frames(none, 3).count() == 0
    assert clusters.kmeans(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert clusters.kmeans(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")).first().cluster == 0
