"""The search on a corpus small enough to read: legs, notes, orders, caps and the ways to find nothing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomspark.operators import inverted as I
from loomspark.operators import search as S
from loomspark.operators.vector_store import VectorStore

VIDEOS = [(1, "a", "first", 100), (2, "a", "second", 300), (3, "b", "third", 200)]
CUES = [
    (1, 10, "Ann", 0.0, 4.0, "Caching is a cache"),
    (1, 11, "Bob", 5.0, 9.0, "of cached things"),
    (1, 12, "Bob", 60.0, 64.0, "and the cache again"),
    (2, 20, "Ann", 0.0, 3.0, "nothing of note"),
    (2, 21, "Ann", 30.0, 33.0, "a cache, once"),
    (3, 30, None, 0.0, 3.0, "weather"),
]
LINES = [(7, 2, 12.0, "cache nvidia-smi"), (8, 3, 5.0, "nvidia-smi --help"), (9, 1, 1.0, "")]
FRAMES = [(7, 2, 12.0, [1.0, 0.0]), (8, 3, 5.0, [0.0, 1.0]), (9, 1, 1.0, [0.9, 0.1])]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    tmp = tmp_path_factory.mktemp("search")
    cues = spark.createDataFrame(CUES, "video_id long, cue_id long, speaker string, start_s double, end_s double, text string")
    lines = spark.createDataFrame(LINES, "frame_id long, video_id long, t_s double, text string")
    return S.Corpus(
        spark.createDataFrame(VIDEOS, "video_id long, channel string, title string, published long"),
        cues,
        I.build(cues, "cue_id", {"text": F.col("text")}, I.PROSE, f"{tmp}/cues", folders=4),
        lines,
        I.build(lines, "frame_id", {"text": F.col("text")}, I.SCREEN, f"{tmp}/lines", folders=4),
        VectorStore.at(spark, f"{tmp}/frames", 4).write(spark.createDataFrame(FRAMES, "id long, owner long, t_s double, vector array<float>")),
    )


def test_legs_and_notes():
    legs = lambda footing=True, **kw: S.plan_legs(S.Request(**{"words": ("x",), "vector": (1.0,)} | kw), footing)[0]
    assert legs() == S.LEGS and legs(content="ocr") == ("ocr",)
    assert legs(vector=None) == legs(False) == legs(max_chars=5) == ("transcript", "ocr")
    assert legs(speaker="x") == legs(words=()) == ("transcript",) and legs(speaker="x", content="frame") == ()
    notes = S.plan_legs(S.Request(words=("x",), speaker="x"), True)[1]
    assert len(notes) == 1 and "ocr" in notes[0] and "frame" in notes[0]
    with pytest.raises(ValueError, match="one video"):
        S.Request(order="video_time")
    with pytest.raises(ValueError, match="content"):
        S.Request(content="smell")


def places(answer):
    return [(r["video_id"], r["start_s"], r["source"]) for r in answer.rows]


def test_pages(spark, corpus):
    ask = lambda **kw: S.search(spark, corpus, S.Request(**kw))
    found = ask(words=("cache",), vector=(1.0, 0.0))
    # Stems meet; neighbouring cues are one hit; the line and the frame of one picture are one hit of two legs.
    assert found.state == "page" and set(places(found)) == {(1, 0.0, "transcript"), (1, 60.0, "transcript"), (2, 30.0, "transcript"), (2, 12.0, "ocr+frame"), (1, 1.0, "frame")}
    assert places(found)[0] == (2, 12.0, "ocr+frame") and found.rows[0]["n_legs"] == 2 and found.rows[0]["title"] == "second"
    assert found.counts == {"videos": 3, "transcript": 3, "ocr": 1, "frame": 2, "total": 5} and not found.has_more
    run = next(r for r in found.rows if r["start_s"] == 0.0)
    assert run["text"] == "Caching is a cache of cached things" and run["end_s"] == 9.0 and run["coverage"] == 1.0
    first = ask(words=("cache",), vector=(1.0, 0.0), per_video=1, limit=1)
    assert len(first.rows) == 1 and first.has_more and first.counts["total"] == 2 and first.dominant == [2]
    both = [ask(words=("cache",), limit=2, offset=k).rows for k in (0, 2)]
    assert [r["place"] for rows in both for r in rows] == [1, 2, 3, 4] and len({(r["video_id"], r["start_s"]) for rows in both for r in rows}) == 4
    assert places(ask(words=("cache",), content="transcript", order="recency"))[0] == (2, 30.0, "transcript")
    timed = ask(words=("cache",), video_ids=(1,), order="video_time", gap=0.0)
    assert [r["start_s"] for r in timed.rows] == [0.0, 5.0, 60.0]
    assert places(ask(words=("cache",), speaker="BOB")) == [(1, 5.0, "transcript"), (1, 60.0, "transcript")]
    assert {p[:2] for p in places(ask(words=("cache",), t_from=20.0, t_to=40.0))} == {(2, 30.0)}
    assert places(ask(words=("nvidia",), content="ocr", channels=("b",))) == [(3, 5.0, "ocr")]
    exact = ask(words=("of", "cached"), content="transcript").rows
    assert [(r["exact"], r["coverage"]) for r in exact] == [(1, 1.0)]
    listed = ask(channels=("a",))
    assert places(listed) == [(1, 0.0, "transcript"), (1, 60.0, "transcript"), (2, 0.0, "transcript"), (2, 30.0, "transcript")]


def test_ways_to_find_nothing(spark, corpus):
    ask = lambda c=corpus, **kw: S.search(spark, c, S.Request(**kw)).state
    assert ask(words=("cache",), offset=99) == "past_end"
    assert ask(words=("cache", "weather")) == "nothing_matched" == ask(words=("cache",), speaker="nobody")
    assert ask(words=("zzz",), vector=(1.0, 0.0)) == "no_footing"
    assert ask(words=("cache",), channels=("c",)) == ask(words=("cache",), video_ids=()) == "no_video"
    none = S.Corpus(corpus.videos.limit(0), corpus.cues, corpus.cue_index, corpus.lines, corpus.line_index, corpus.frames)
    assert ask(none, words=("cache",)) == "empty_corpus"


def test_counts_beyond_the_last_page(spark, corpus):
    """Videos too many to broadcast: the join of an empty page is dropped as a whole, with whatever was observed below it."""
    many = corpus.videos.unionByName(spark.range(100, 30_000).selectExpr("id AS video_id", "'z' AS channel", "repeat(cast(id AS string), 9) AS title", "id AS published"))
    wide = S.Corpus(many, corpus.cues, corpus.cue_index, corpus.lines, corpus.line_index, corpus.frames)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = S.search(spark, wide, S.Request(words=("cache",), vector=(1.0, 0.0), offset=100_000))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found.state == "past_end" and found.rows == [] and not found.has_more
    assert found.counts == {"videos": 29_903, "transcript": 3, "ocr": 1, "frame": 2, "total": 5}
