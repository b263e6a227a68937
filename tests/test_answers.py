"""Citations, highlights, frames of a stream, subtitle choice, and two series side by side."""

from __future__ import annotations

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from loomspark.functions import answers as A
from loomspark.operators import alignment as L
from loomspark.operators import captions as K


def test_citations(spark):
    want = {
        "the block table [9] is kept": "the block table is kept", "see [9].": "see.", "text [8][9] end": "text end", "[9] begin": "begin", "end [9]": "end",
        "a [1 transcript] b": "a [1] b", "a[01]b [2, ocr+frame]": "a[1]b [2]", "x [9]y": "x y", "x[9]y": "xy", "x [9] [9] [1] y": "x [1] y", "a [1] [9] b": "a [1] b",
        "no markers": "no markers", "[123] [x] []": "[123] [x] []", "": "", "  [9]  ": "", "line\n[9] next": "line\nnext", "[2] and [1] and [2]": "[2] and [1] and [2]",
    }
    rows = [(t,) for t in [*want, None]]
    made = spark.createDataFrame(rows, "t string").select("t", A.cite(F.col("t"), F.array(F.lit(1), F.lit(2))).alias("a")).collect()
    got = {r["t"]: r["a"] for r in made}
    assert {t: got[t]["answer"] for t in want} == want and got[None] is None
    assert got["[2] and [1] and [2]"]["used"] == [1, 2] and got["see [9]."]["used"] == []


def parts_by_hand(text, query):
    if not text:
        return []
    terms = A.highlight_terms(query)
    out, at = [], 0
    for n, m in enumerate(re.finditer("|".join(map(re.escape, terms)), text, re.I) if terms else []):
        if n >= 40:
            break
        out += [(text[at : m.start()], False), (m[0], True)]
        at = m.end()
    return [p for p in [*out, (text[at:], False)] if p[0]]


def test_highlights(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "THE", "then", "cat", "it's", "a.b", "é", "x"]) for _ in range(n)) for n in (1, 5, 30, 200)] + ["", None, "the", "Éa éa"]
    for query in ("the then cat", "it's a.b", "x", "", "éa", "one two three four five six seven eight nine the"):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", A.highlight(F.col("t"), query).alias("p")).collect()
        assert [[tuple(p) for p in r["p"]] for r in rows] == [parts_by_hand(r["t"], query) for r in rows], query
    assert A.highlight_terms("aa b ccc AA") == ["ccc", "aa"] and len(A.highlight_terms(" ".join(f"w{i}" for i in range(20)))) == 8


def test_frames_of_a_stream(spark):
    row = spark.createDataFrame([("a\nb", "x\r\ny")], "name string, t string")
    got = row.select(A.sse_frame(F.col("name"), F.struct("t")), A.sse_frame(F.lit("\n"), F.struct("t"))).first()
    assert got[0] == 'event: ab\ndata: {"t":"x\\r\\ny"}\n\n' and got[1].startswith("event: message\n")


def test_lines_are_written_once(spark, tmp_path):
    from loomspark.streaming.lines import write_lines

    shape, source = "id long, t string", f"{tmp_path}/in"
    for n in range(2):
        spark.createDataFrame([(n, f"line\n{n}")], shape).write.mode("append").parquet(source)
        for _ in range(2):
            write_lines(spark.readStream.schema(shape).parquet(source), F.struct("id", "t"), f"{tmp_path}/out", f"{tmp_path}/state")
        assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/out").collect()) == [f'{{"id":{k},"t":"line\\n{k}"}}' for k in range(n + 1)]


def test_subtitle_choice(spark):
    track = lambda *exts: [{"ext": e, "url": "u" if e != "none" else ""} for e in exts]
    rows = [
        (1, {"subtitles": {"fr": track("vtt")}}),
        (2, {"subtitles": {"en-US": track("ttml", "srt"), "de": track("json3")}}),
        (3, {"subtitles": {"de": track("json3")}, "automatic_captions": {"EN-orig": track("vtt"), "enx": track("json3")}}),
        (4, {"subtitles": {"en": track("none")}}),
        (5, {}),
        (6, {"subtitles": {"de-AT": track("odd", "vtt")}}),
    ]
    made = K.choose_subtitle(spark.createDataFrame(rows, f"k long, info {K.INFO}"), "k", "info", ["en", "de"]).collect()
    assert {r["k"]: (r["lang"], r["ext"], r["automatic"]) for r in made} == {2: ("en-US", "srt", False), 3: ("EN-orig", "vtt", True), 6: ("de-AT", "vtt", False)}


def test_drift_and_pairs(spark):
    rng = random.Random(9)
    side = lambda n: [(rng.randrange(4), k, round(rng.random() * 60, 2), rng.randrange(2**63) - 2**62) for k in range(n)]
    a, b = side(120), [(v, 1000 + k, t, h) for v, k, t, h in side(90) if v != 3]
    b.append((9, 5000, 1.0, 0))
    frame = lambda rows: spark.createDataFrame(rows, "video_id long, frame_id long, t_s double, phash long")
    got = {r["video_id"]: r for r in L.drift(frame(a), frame(b), "video_id", "t_s").collect()}
    for v in range(4):
        x, y = [t for w, _, t, _ in a if w == v], [t for w, _, t, _ in b if w == v]
        assert (got[v]["count_a"], got[v]["count_b"]) == (len(x), len(y))
        if y:
            forth, back = [min(abs(p - q) for q in y) for p in x], [min(abs(p - q) for q in x) for p in y]
            assert got[v]["mean_s"] == round(sum(forth) / len(forth), 4) and got[v]["max_s"] == round(max(forth), 4) and got[v]["reverse_max_s"] == round(max(back), 4)
            assert got[v]["moved"] == sum(d > 0.3 for d in forth) and abs(min(abs(got[v]["worst_s"] - q) for q in y) - max(forth)) < 2e-3
        else:
            assert got[v]["mean_s"] is None and got[v]["moved"] is None
    assert (got[9]["count_a"], got[9]["count_b"]) == (0, 1)
    for within in (0.4, 5.0):
        want = set()
        for v in range(4):
            x = sorted((t, k, h) for w, k, t, h in a if w == v)
            y = sorted((t, k, h) for w, k, t, h in b if w == v)
            at = L._matched(np.array([t for t, _, _ in x]), np.array([t for t, _, _ in y]), within)
            want |= {(v, k, y[j][1] if j >= 0 else None, (h ^ y[j][2]).bit_count() if j >= 0 and h ^ y[j][2] >= 0 else ((h ^ y[j][2]) % 2**64).bit_count() if j >= 0 else None) for (t, k, h), j in zip(x, at, strict=True)}
        made = L.pairs(frame(a), frame(b), "video_id", "t_s", "frame_id", F.col("phash"), within).collect()
        assert {(r["video_id"], r["a"], r["b"], r["bits"]) for r in made} == want


def test_pairs_of_many_keys_go_by_in_batches(spark):
    """Many short keys and one long one over several batches; rows without a key, a time or an id."""
    rng = random.Random(3)
    rows = [(1 << 60 | v, 10 * v + k, rng.randrange(12), rng.randrange(1 << 40)) for v in range(300) for k in range(2)] + [(7, 5000 + k, rng.randrange(300), rng.randrange(1 << 40)) for k in range(400)]
    rows += [(None, 9000, 3, 1), (None, 9001, 3, 1), (7, 9002, None, 1), (7, 9004, 10**6, 1), (None, 9006, 4, 2)]
    sides = {True: [r for r in rows if r[1] % 4 < 2], False: [*[r for r in rows if r[1] % 4 >= 2], (7, None, 10**6, 5), (7, 9003, None, 5), (8, 9005, None, 5)]}
    frame = lambda rows: spark.createDataFrame(rows, "video_id long, frame_id long, t_s long, phash long")
    want, left = set(), {r for r in sides[False] if None not in r}
    for v, k, t, h in sorted((r for r in sides[True] if r[0] is not None), key=lambda r: (r[2] is None, r[2], r[1])):
        near = [(abs(r[2] - t), r[2], r[1], r) for r in left if r[0] == v and abs(r[2] - t) <= 5] if t is not None else []
        if near:
            dt, _, i, r = min(near)
            left.remove(r)
        want.add((v, k, i, float(dt), (h ^ r[3]).bit_count()) if near else (v, k, None, None, None))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        made = L.pairs(frame(sides[True]), frame(sides[False]), "video_id", "t_s", "frame_id", F.col("phash"), 5.0)
        plan = made._jdf.queryExecution().executedPlan().toString()
        got = [tuple(r) for r in made.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and set(got) == want
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_a_crowd_of_moments_is_matched_in_little_time():
    at = np.arange(60_000.0)
    began = time.process_time()
    assert L._matched(at, at + 0.25, 3600.0) == list(range(60_000)) and L._matched(np.zeros(60_000), at[::-1] * 0, 1.0) == list(range(60_000))
    assert time.process_time() - began < 10


def snippet_by_hand(text, terms):
    """FTS5's own steps over the words of one column."""
    found = list(re.finditer(r"[^\W_]+", text))
    words, size = [m.group().lower() for m in found], 64
    hits = [(k, w) for k, w in enumerate(words) if w in terms]
    if not hits:
        return text
    opens = [0]
    for k in range(1, len(found)):
        before = text[: found[k].start()]
        bare = before.rstrip(" \t\n\r")
        if bare != before and bare[-1] in ".:":
            opens.append(k)

    def score(pos):
        seen, total, inside = set(), 0, []
        for k, w in hits:
            if pos <= k < pos + size:
                total += 1 if w in seen else 1000
                seen.add(w)
                inside.append(k)
        shift = inside[0] - (size - (inside[-1] + 1 - inside[0])) // 2 if inside else 0
        return total, max(0, min(shift, len(words) - size))

    best, begin = 0, 0
    for k, _ in hits:
        total, at = score(k)
        if total > best:
            best, begin = total, at
        if len(words) > size:
            s = max(o for o in opens if o <= k)
            total = score(s)[0] + (120 if s == 0 else 100)
            if s < k and total > best:
                best, begin = total, s
    until = begin + size
    body = text[found[begin].start() if begin else 0 : found[until - 1].end() if until < len(words) else len(text)]
    return " … " * (begin > 0) + body + " … " * (until < len(words))


def test_snippets(spark):
    rng = random.Random(12)
    texts = ["", "...", "no word of it", "The", " the end. ", "x " * 70 + "the", "the " + "x " * 70, "x " * 63 + "the", "x " * 64 + "the.", "a: The b", ("x " * 80 + "the ") * 3 + "cat", "x. " * 65 + "the", "x  the. \x85The " + "y " * 90]
    for _ in range(150):
        rare, n = rng.choice([0.005, 0.03, 0.3]), rng.randrange(1, 400)
        texts.append("".join(rng.choice(["", "(", "\n"]) * (k == 0) + (rng.choice(["the", "The", "cat", "été"]) if rng.random() < rare else rng.choice(["x", "thé", "theme", "42"])) + rng.choice([" "] * 12 + [". ", ": ", ".\n", ".", "-", " (", "! ", ".  \t", "… "]) for k in range(n)))
    for terms in (["the", "cat", "été"], ["cat"], ["the", "missing"]):
        rows = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, text string").select("k", A.snippet(F.col("text"), terms).alias("s")).collect()
        assert [r["s"] for r in sorted(rows)] == [*(snippet_by_hand(t, terms) for t in texts), None]


def test_every_row_of_the_page_has_a_snippet(spark, tmp_path):
    """Also one that only another term than the first has found."""
    from loomspark.plans import catalogue

    tail = " filler" * 90
    rows = [(1, "Said THEA, once." + tail), (2, "the" + tail + " Queaux" + " z" * 40), (3, "none"), (4, None), (5, "Queaux!")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["snippet"] for r in catalogue.load().functions()["snippet"](spark, str(tmp_path)).collect()}
    assert got == {k: snippet_by_hand(t, ["the", "thea", "queaux"]) for k, t in rows if k in (1, 2, 5)}
    assert got[1].startswith("Said THEA, once. filler") and got[1].endswith("filler … ") and got[5] == "Queaux!"
