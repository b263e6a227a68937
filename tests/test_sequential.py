from __future__ import annotations

import itertools
import random

import numpy as np

from loomspark.operators import sequential as S
from loomspark.operators import timeline as T
from loomspark.streaming import budgets

DIR = "/root/testdata/sf0.001"


def test_chunks_cover_every_cue_in_every_layout():
    for gaps in itertools.product((0.0, 5.0, 40.0), (1.0, 20.0, 50.0), repeat=3):
        start, t, ends = [], 0.0, []
        for gap, size in zip(gaps[::2], gaps[1::2], strict=True):
            t += gap
            start.append(t)
            t += size
            ends.append(t)
        s, e = np.array(start), np.array(ends)
        bounds = S.chunk_bounds(s, e)
        assert set().union(*(range(i, j + 1) for i, j in bounds)) == set(range(3))
        assert all(i == j or e[j] - s[i] <= S.CHUNK_S for i, j in bounds)


def test_words_that_differ(spark):
    def plain(a, b):
        d = list(range(len(b) + 1))
        for x in a:
            d = list(itertools.accumulate(zip(d[1:], d, b, strict=False), lambda left, t: min(left + 1, t[0] + 1, t[1] + (t[2] != x)), initial=d[0] + 1))
        return d[-1]

    rng = random.Random(1)
    rows = [([rng.choice("abc") for _ in range(rng.randrange(6))], [rng.choice("abc") for _ in range(rng.randrange(6))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    from pyspark.sql import functions as F

    assert [r["e"] for r in df.select(S.word_errors(F.col("a"), F.col("b")).alias("e")).collect()] == [plain(a, b) for a, b in rows]


def test_wer_compares_whole_passages(spark, tmp_path):
    from loomspark.plans import catalogue

    words = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(words)), (1, " ".join([*words[:40], "x", *words[41:]])), (2, " ".join(words[:30]))]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["item_id"]: (r["errors"], r["wer"]) for r in catalogue.load().functions()["wer"](spark, str(tmp_path)).collect()}
    assert got == {0: (1, round(1 / 60, 4)), 1: (30, 1.0)}


def test_bucket_and_near_duplicates(spark):
    rows = [(1, t, k) for k, t in enumerate([0, 0, 0, 5, 30, 31, 32])]
    got = S.token_bucket(spark.createDataFrame(rows, "client long, t long, id long"), "client", "t", "id", 2, 0.1).orderBy("id").collect()
    assert [r["allowed"] for r in got] == [True, True, False, False, True, True, False]
    frames = spark.createDataFrame([(1, 0, 0, 0b0), (1, 1, 1, 0b1), (1, 2, 2, 0b111), (1, 3, 3, 0b110)], "video_id long, frame_id long, t_s long, phash long")
    assert [(r[0], r[1]) for r in S.greedy_neardup(frames, 1).orderBy("frame_id").collect()] == [(0, None), (1, 0), (2, None), (3, 2)]


def test_interpolation(spark):
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate([None, 2.0, None, None, 8.0, None])], "k long, o long, v double")
    got = [round(r["v"], 6) for r in S.interpolate(rows, "k", "o", "v", 0.0, 1.0).orderBy("o").collect()]
    assert got == [0.0, 2.0, 4.0, 6.0, 8.0, 9.0]


CUE = "video_id long, cue_id long, start_s double, end_s double, text string"


def tidy_by_hand(rows):
    out = []
    for v, i, s, e, t in sorted((r for r in rows if (r[4] or "").strip()), key=lambda r: (r[0], r[2], r[3], r[1])):
        e = min(max(e, s + 0.01), s + 30)
        if out and out[-1][0] == v:
            if out[-1][4] == t and abs(out[-1][2] - s) < 0.05:
                continue
            if out[-1][3] > s:
                out[-1][3] = max(s, out[-1][2] + 0.01)
        out.append([v, i, s, e, t])
    return sorted((v, i, s, round(e, 9)) for v, i, s, e, _ in out)


def test_tidy(spark):
    got = lambda rows: sorted((r[0], r[1], r[2], round(r[3], 9)) for r in S.tidy(spark.createDataFrame(rows, CUE)).select("video_id", "cue_id", "start_s", "end_s").collect())
    yes = [(1, k, float(k), k + 1.0, "yes") for k in range(3)]
    assert got(yes) == [(1, k, float(k), k + 1.0) for k in range(3)]  # said again, not an echo
    chain = [(1, k, 0.03 * k, 9.0, "a") for k in range(9)] + [(1, 20, 0.0, 2.0, "a"), (1, 30, 0.3, 99.0, "b"), (1, 31, 0.3, 99.0, "c"), (2, 1, 5.0, 1.0, "x"), (2, 2, 5.0, 6.0, " "), (2, 3, 6.0, 7.0, None)]
    assert got(chain) == tidy_by_hand(chain)
    rng = random.Random(4)
    for _ in range(3):
        rows = [(rng.randrange(3), k, rng.randrange(60) * 0.02, rng.randrange(60) * 0.05, rng.choice(["a", "a", "b", ""])) for k in range(120)]
        assert got(rows) == tidy_by_hand(rows)


def test_chunks_of_stretches_are_those_of_the_whole_video(spark):
    rng = random.Random(8)
    rows = []
    for v in range(4):
        t = 0.0
        for k in range(150):
            t += rng.choice([0.5, 3.0, 3.0, 9.0, 44.0, 45.0, 60.0, 200.0])
            rows.append((v, v * 1000 + k, t, t + rng.choice([0.5, 4.0, 30.0, 50.0]), rng.choice(["x", "x", ""])))
    want = []
    for v in range(4):
        own = sorted((r for r in rows if r[0] == v), key=lambda r: r[2])
        s, e = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        made = [(i, j) for i, j in S.chunk_bounds(s, e) if any(r[4] for r in own[i : j + 1])]
        want += [(v, n, own[i][1], own[j][1], s[i], e[j]) for n, (i, j) in enumerate(made)]
    assert sorted(tuple(r) for r in S.chunk_windows(spark.createDataFrame(rows, CUE)).collect()) == sorted(want)


def test_no_island_leaves_its_cell(spark):
    rows = [(1, k, float(7 * k), float(7 * k + 6), "x") for k in range(100)]
    cues = spark.createDataFrame(rows, "video_id long, cue_id long, start_s double, end_s double, text string")
    made = T.island_rows(T.islands(cues, 4.0)).collect()
    assert all(r["end_s"] - r["start_s"] <= T.CELL for r in made) and sum(r["n_cues"] for r in made) == 100
    assert T.islands(cues, 0.0).select("island").distinct().count() == 100


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    stream = budgets.event_stream(spark, str(tmp_path / "in"), schema)
    # Complete output: files here come in no order of time.
    q = budgets.daily_budget(stream, "60 days").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r["client"], r["day"]): r["n"] for r in budgets.daily_budget(events).collect()}
    assert {(r["client"], r["day"]): r["n"] for r in spark.table("days").collect()} == want
    q = budgets.upsert_latest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["user_id"], "event_id")
    q.awaitTermination(120)
    latest = budgets.read_latest(spark, str(tmp_path / "out"), ["user_id"], "event_id")
    assert {r["user_id"]: r["event_id"] for r in latest.collect()} == {r[0]: r[1] for r in events.groupBy("user_id").agg({"event_id": "max"}).collect()}


def test_screen_text_joins_its_cue(spark):
    spoken = spark.createDataFrame([(1, 1, 0.0, 4.0, "install the driver", 1.0), (1, 2, 50.0, 54.0, "install the driver", 2.0)], "video_id long, cue_id long, start_s double, end_s double, text string, score double")
    shown = spark.createDataFrame([(1, 7, 2.0, "Install the driver now", 0.5), (1, 8, 3.0, "install", 0.5), (1, 9, 20.0, "install the driver", 0.5), (2, 1, 0.0, "x", 0.5)], "video_id long, line_id long, t_s double, text string, score double")
    got = S.collapse_screen_text(spoken, shown).orderBy("video_id", "t_s").collect()
    assert [(r["t_s"], r["text"], r["score"], r["source"]) for r in got] == [
        (0.0, "Install the driver now", 1.5, "transcript+ocr"),
        (20.0, "install the driver", 0.5, "ocr"),
        (50.0, "install the driver", 2.0, "transcript"),
        (0.0, "x", 0.5, "ocr"),
    ]


def test_context_ends_at_its_budget(spark):
    rows = [(1, k, float(5 * k), float(5 * k + 4), "x" * (k % 4 + 1)) for k in range(20)] + [(2, 100, 50.0, 51.0, "long" * 9), (3, 200, 0.0, 1.0, "far")]
    cues = spark.createDataFrame(rows, CUE)
    moments = spark.createDataFrame([(1, 50.0), (2, 50.0), (3, 50.0), (4, 50.0)], "video_id long, t double")
    for budget in (0, 7, 10, 1000):
        want = []
        for v in (1, 2, 3):
            near = [r for r in rows if r[0] == v and r[3] >= 35 and r[2] <= 60]
            used, kept, bound = 0, [], "window"
            for r in near:
                if budget and used + len(r[4]) > budget:
                    bound = "budget"
                    break
                used += len(r[4])
                kept.append((v, r[1], used))
            want += [(*k, bound) for k in kept]
        got = T.context(cues, moments, 15.0, 10.0, budget).select("video_id", "cue_id", "used", "bound").collect()
        assert sorted(tuple(r) for r in got) == want, budget


def test_a_batch_of_stretches_is_cut_at_once(spark):
    """One call of Python cuts many short videos, and a stretch over several batches stays whole; ids beyond 2**53 and null ones too."""
    big = 1 << 60
    rows = [(big + v, big + v * 100 + k, k * 7.0, k * 7.0 + 5.0, "x") for v in range(300) for k in range(8)] + [(None, None, 0.0, 2.0, "x")]
    rows += [(7, k, k * 2.0, k * 2.0 + 1.0, "" if k % 3 else "x") for k in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        made = S.chunk_windows(spark.createDataFrame(rows, CUE))
        plan = made._jdf.queryExecution().executedPlan().toString()
        got = made.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for v in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == v), key=lambda r: r[2])
        bounds = S.chunk_bounds(np.array([r[2] for r in own]), np.array([r[3] for r in own]))
        want += [(v, n, own[i][1], own[j][1], own[i][2], own[j][3]) for n, (i, j) in enumerate(bounds)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
