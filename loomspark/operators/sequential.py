"""Operators whose next row depends on what was decided for the last one.

Each runs over rows in order, as a fold inside a task: per stretch of a video where
one can say where a decision ends, else per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of a chunk and from one chunk's start to the next one's.
CHUNK_S, STRIDE_S = 45.0, 30.0
#: Seconds of the shortest and the longest cue, and between a text and its echo.
LEAST_S, LONGEST_S, ECHO_S = 0.01, 30.0, 0.05
#: Fixed value: bits of a 64-bit hash that may differ between near-duplicates, as 24 of 256 do.
NEAR_BITS = 6


def chunk_bounds(start: np.ndarray, end: np.ndarray, more: bool = False) -> list[tuple[int, int]]:
    """Windows of whole cues as (first, last): at most ``CHUNK_S`` long, one cue at least, no cue left out.

    A window that reaches the last cue is the last one, unless ``more`` cues follow, which it can't reach.
    """
    out, i, n = [], 0, len(start)
    while i < n:
        j = i
        while j + 1 < n and end[j + 1] - start[i] <= CHUNK_S:
            j += 1
        out.append((i, j))
        if j == n - 1 and not more:
            break
        stride = int(np.searchsorted(start, start[i] + STRIDE_S))
        i = max(min(stride, j + 1), i + 1)
    return out


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole stretches in order, many at a time, and where each begins, with the end; one that goes on in the next batch waits for it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        heads = np.flatnonzero(batch.column("__head").to_numpy(zero_copy_only=False))
        if not len(heads):
            held.append(batch)
            continue
        last = int(heads[-1])
        if held or last:
            whole = pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            yield whole, np.r_[np.flatnonzero(whole.column("__head").to_numpy()), len(whole)]
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), np.array([0, sum(map(len, held))])


def _cut_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, edges in _stretches(batches):
        start, end = (rows.column(k).to_numpy() for k in ("start_s", "end_s"))
        says, last = (rows.column(k).to_numpy() for k in ("says", "__last"))
        at = np.arange(len(rows))
        first, final = [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at[a:b] = a + np.argsort(start[a:b], kind="stable")  # cues without a time come last
            o = at[a:b]
            for i, j in chunk_bounds(start[o], end[o], more=not last[o].any()):
                if says[o[i : j + 1]].any():
                    first.append(o[i])
                    final.append(o[j])
        i, j = pa.array(first, pa.int64()), pa.array(final, pa.int64())
        columns = [rows.column(k).take(x) for k, x in (("video_id", i), ("cue_id", i), ("cue_id", j), ("start_s", i), ("end_s", j))]
        yield from pa.table(columns, names=["video_id", "first_cue", "last_cue", "start_s", "end_s"]).to_batches()


def chunk_windows(cues: DataFrame) -> DataFrame:
    """(video_id, chunk, first_cue, last_cue, start_s, end_s): a chunk ends where its last cue does; one without text is left out.

    No window holds two cues of which the later ends more than ``CHUNK_S`` after the
    earlier begins. Where neighbours are so far apart a video is cut, and its
    stretches are folded one by one: a task holds a stretch of speech, never a whole
    video, and a batch of short stretches costs one call.
    """
    order = W.partitionBy("video_id").orderBy("start_s", "cue_id")
    rows = cues.select("video_id", "cue_id", "start_s", "end_s", (F.trim(F.coalesce("text", F.lit(""))) != "").alias("says"))
    apart = F.coalesce(F.col("end_s") - F.lag("start_s").over(order) > CHUNK_S, F.lit(False))
    place = F.row_number().over(order)
    marked = rows.withColumns({"__n": place, "__head": apart | (place == 1), "__last": F.lead("cue_id").over(order).isNull()})
    shape = "video_id long, first_cue long, last_cue long, start_s double, end_s double"
    # A video's rows lie in one task since the windows, and stretch follows stretch there.
    made = marked.sortWithinPartitions("video_id", "__n").mapInArrow(_cut_stretches, shape)
    number = F.row_number().over(W.partitionBy("video_id").orderBy("start_s", "first_cue")) - 1
    return made.select("video_id", number.cast("long").alias("chunk"), "first_cue", "last_cue", "start_s", "end_s")


def interpolate(rows: DataFrame, key: str, order: str, value: str, floor: float, step: float) -> DataFrame:
    """Fills null values evenly between their known neighbours, then never lets a value fall: windows alone say it."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(key).orderBy(order).rowsBetween(1, W.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    lo = F.last(at, ignorenulls=True).over(before)
    hi = F.first(at, ignorenulls=True).over(after)
    near = rows.withColumn("__lo", lo).withColumn("__hi", hi)
    part = (F.col(order) - F.col("__lo.o")) / (F.col("__hi.o") - F.col("__lo.o"))
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(F.col("__lo").isNotNull() & F.col("__hi").isNotNull(), F.col("__lo.v") + part * (F.col("__hi.v") - F.col("__lo.v")))
        .when(F.col("__lo").isNotNull(), F.col("__lo.v") + step * (F.col(order) - F.col("__lo.o")))
        .otherwise(F.lit(floor))
    )
    run = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return near.withColumn("__f", filled).withColumn(value, F.max("__f").over(run)).drop("__lo", "__hi", "__f")


def tidy(cues: DataFrame) -> DataFrame:
    """Cues in time order without blank ones and echoes, of sensible length, none reaching into the next.

    An echo says what the cue kept before it says and begins less than ``ECHO_S`` after
    that one. Only cues that follow one another so closely depend on each other;
    such a chain is folded, all else is windows.
    """
    w = W.partitionBy("video_id").orderBy("start_s", "end_s", "cue_id")
    said = cues.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    near = (F.lag("text").over(w) == F.col("text")) & (F.col("start_s") - F.lag("start_s").over(w) < ECHO_S)
    chained = said.withColumn("__new", F.coalesce(near, F.lit(False)).cast("int")).withColumn(
        "__chain", F.sum(1 - F.col("__new")).over(w.rowsBetween(W.unboundedPreceding, 0))
    )
    # Of equal starts the first can stay at most: a chain's array holds each start once.
    starts = chained.groupBy("video_id", "__chain").agg(F.sort_array(F.collect_set("start_s")).alias("s"))
    none = F.array().cast("array<double>")
    apart = lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= ECHO_S), F.concat(kept, F.array(x))).otherwise(kept)
    longer = starts.where(F.size("s") > 1).select("video_id", "__chain", F.aggregate("s", none, apart).alias("__kept"))
    first = F.row_number().over(W.partitionBy("video_id", "__chain", "start_s").orderBy("end_s", "cue_id"))
    marked = chained.withColumn("__first", first).where("__first = 1").join(longer, ["video_id", "__chain"], "left")
    kept = marked.where(F.col("__kept").isNull() | F.array_contains("__kept", F.col("start_s")))
    bounded = F.least(F.greatest(F.col("end_s"), F.col("start_s") + LEAST_S), F.col("start_s") + LONGEST_S)
    kept = kept.withColumn("end_s", bounded).drop("__new", "__chain", "__first", "__kept")
    following = F.lead("start_s").over(W.partitionBy("video_id").orderBy("start_s", "__end", "cue_id"))
    trimmed = F.when(F.col("end_s") > F.col("__next"), F.greatest(F.col("__next"), F.col("start_s") + LEAST_S)).otherwise(F.col("end_s"))
    ordered = kept.withColumn("__end", F.col("end_s")).withColumn("__next", following)
    return ordered.withColumn("end_s", trimmed).drop("__end", "__next")


def greedy_neardup(frames: DataFrame, bits: int = NEAR_BITS) -> DataFrame:
    """(frame_id, dup_of): the earliest kept frame of the video within so many bits, or null for a kept frame."""

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.sort_values(["t_s", "frame_id"])
        ids, hashes = r["frame_id"].to_numpy(), r["phash"].to_numpy().astype(np.uint64)
        kept = np.zeros(len(r), np.int64)
        n, dup = 0, []
        for k in range(len(r)):
            near = np.flatnonzero(np.bitwise_count(hashes[kept[:n]] ^ hashes[k]) <= bits)
            dup.append(ids[kept[near[0]]] if len(near) else None)
            if not len(near):
                kept[n] = k
                n += 1
        return pd.DataFrame({"frame_id": ids, "dup_of": pd.Series(dup, dtype="Int64")})

    return frames.select("video_id", "frame_id", "t_s", "phash").groupBy("video_id").applyInPandas(mark, "frame_id long, dup_of long")


def token_bucket(requests: DataFrame, key: str, at: str, order: str, capacity: float, per_second: float) -> DataFrame:
    """Adds ``allowed``: each key's bucket refills with time and a request takes one token if there is one."""
    zero = F.struct(F.lit(float(capacity)).alias("left"), F.lit(None).cast("double").alias("at"), F.array().cast("array<struct<id:long,allowed:boolean>>").alias("out"))
    rows = F.sort_array(F.collect_list(F.struct(F.col(at).cast("double").alias("t"), F.col(order).alias("id"))))

    def step(s: Column, r: Column) -> Column:
        full = F.least(F.lit(float(capacity)), s["left"] + F.coalesce((r["t"] - s["at"]) * per_second, F.lit(0.0)))
        ok = full >= 1
        return F.struct(
            (full - ok.cast("double")).alias("left"), r["t"].alias("at"), F.concat(s["out"], F.array(F.struct(r["id"].alias("id"), ok.alias("allowed")))).alias("out")
        )

    folded = requests.groupBy(key).agg(rows.alias("rows")).select(key, F.aggregate("rows", zero, step, lambda s: s["out"]).alias("out"))
    return folded.select(key, F.explode("out").alias("x")).select(key, F.col("x.id").alias(order), F.col("x.allowed").alias("allowed"))


def _edits(a: list[str | None], b: list[str | None]) -> int:
    """Edit distance with two rows of the dynamic program; a null word equals no other."""
    ids = {w: k for k, w in enumerate(dict.fromkeys(b))}
    codes = np.array([-2 if w is None else ids[w] for w in b], np.int64)
    place = np.arange(len(b) + 1)
    prev = place
    for k, w in enumerate(a, 1):
        cur = np.minimum(prev[1:] + 1, prev[:-1] + (codes != (-1 if w is None else ids.get(w, -1))))
        prev = np.minimum.accumulate(np.r_[k, cur] - place) + place
    return int(prev[-1])


def word_errors(a: Column, b: Column) -> Column:
    """Edit distance over all words of two arrays; null if either is."""

    @F.pandas_udf("int")
    def errors(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _edits(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return errors(a, b)


#: Seconds around a cue in which screen text may repeat it, and the similarity that counts as a repeat.
NEAR_S, SAME_TEXT = 5.0, 0.8


def _grams(text: str) -> set[str]:
    padded = f"  {text} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def same_text(a: str, b: str) -> bool:
    """One holds the other, or their trigrams are alike."""
    if not a or not b:
        return False
    x, y = _grams(a), _grams(b)
    return a in b or b in a or len(x & y) >= SAME_TEXT * len(x | y)


def collapse_screen_text(spoken: DataFrame, shown: DataFrame) -> DataFrame:
    """Merges a video's screen-text hits (t_s, text, score) into the first cue hit that says the same at about the time.

    A cue hit takes one such score, whichever text is longer, and names both
    sources; screen text without its cue stays a hit of its own. Hits of a video
    are a capped pool, so a group is small.
    """

    def merge(cues: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        c = cues.sort_values(["start_s", "cue_id"]).to_dict("records")
        out = [{**r, "t_s": r["start_s"], "source": "transcript"} for r in c]
        for line in lines.sort_values(["t_s", "line_id"]).to_dict("records"):
            said = next(
                (r for r in out if "start_s" in r and r["start_s"] - NEAR_S <= line["t_s"] <= r["end_s"] + NEAR_S and same_text(r["text"].lower(), line["text"].lower())),
                None,
            )
            if said is None:
                out.append({**line, "source": "ocr"})
                continue
            if said["source"] == "transcript":
                said["score"] += line["score"]
                said["source"] = "transcript+ocr"
            said["text"] = max(said["text"], line["text"], key=len)
        return pd.DataFrame(out, columns=["video_id", "t_s", "text", "score", "source"])

    shape = "video_id long, t_s double, text string, score double, source string"
    return spoken.groupBy("video_id").cogroup(shown.groupBy("video_id")).applyInPandas(merge, shape)
