"""One search over three kinds of evidence: what is said, what stands on the screen, and what frames look like.

The order of steps carries the meaning: resolve the scope, choose the legs, let each leg
rank its capped candidates inside the scope, fuse ranks, join what two legs say of
one frame, score the words in the text, sort by a total order, cap each video once over all
legs, cut the page, and only then read what a page shows of its videos.

All of that is one plan, and counts along the way are columns of its rows: a plan
that Spark cuts short, as it does beyond the last page, still says what it counted. What
leaves Spark is a page. An empty page says which of five things it means.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.operators import retrieval as R
from loomspark.operators.inverted import Index, expands, match
from loomspark.operators.pages import capped
from loomspark.operators.timeline import islands
from loomspark.operators.vector_store import VectorStore

#: Hits of a leg that are fused, whatever the page; nearest frames that are looked at.
POOL = 400
NEAREST = 800
LEGS = ("transcript", "ocr", "frame")
STATES = ("page", "past_end", "nothing_matched", "no_footing", "no_video", "empty_corpus")
ORDERS = ("relevance", "recency", "video_time")


@dataclass(frozen=True)
class Corpus:
    #: (video_id, channel, title, published)
    videos: DataFrame
    #: (video_id, cue_id, speaker, start_s, end_s, text) and an index of texts by cue_id.
    cues: DataFrame
    cue_index: Index
    #: (frame_id, video_id, t_s, text) and an index of texts by frame_id.
    lines: DataFrame
    line_index: Index
    #: Vectors of frames, by video.
    frames: VectorStore


@dataclass(frozen=True)
class Request:
    #: All of them must be found, each also as the beginning of a word; none: the transcript is listed.
    words: tuple[str, ...] = ()
    #: What the words look like to the model that made the frames' vectors.
    vector: tuple[float, ...] | None = None
    content: str = "all"
    channels: tuple[str, ...] | None = None
    video_ids: tuple[int, ...] | None = None
    speaker: str | None = None
    t_from: float | None = None
    t_to: float | None = None
    min_chars: int | None = None
    max_chars: int | None = None
    order: str = "relevance"
    limit: int = 10
    offset: int = 0
    per_video: int = 3
    gap: float = 8.0
    frame_ceiling: float = 0.65
    frame_band: float = 0.15

    def __post_init__(self) -> None:
        if self.content not in ("all", *LEGS) or self.order not in ORDERS:
            raise ValueError(f"content is all or one of {LEGS}, order one of {ORDERS}")
        if self.order == "video_time" and len(self.video_ids or ()) != 1:
            raise ValueError("video_time orders the moments of one video: name it")


@dataclass
class Answer:
    state: str
    #: (place, source, video_id, channel, title, start_s, end_s, text, score, exact, coverage, n_legs)
    rows: list[Row] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    #: Hits by leg that were fused, videos in scope, hits after the cap.
    counts: dict[str, int] = field(default_factory=dict)
    has_more: bool = False
    #: A leg had more hits than are fused: the counts are bounds.
    pool_full: bool = False
    #: Videos that fill their share of the page.
    dominant: list[int] = field(default_factory=list)


def plan_legs(request: Request, footing: bool) -> tuple[tuple[str, ...], list[str]]:
    """Legs that run, and a note for each reason why others don't."""
    legs, notes = set(LEGS if request.content == "all" else (request.content,)), []

    def without(gone: set[str], why: str) -> None:
        if legs & gone:
            notes.append(f"{why}: {', '.join(sorted(legs & gone))} not queried")
            legs.difference_update(gone)

    if request.speaker is not None:
        without({"ocr", "frame"}, "speakers are known of the transcript only")
    if request.min_chars is not None or request.max_chars is not None:
        without({"frame"}, "frames have no text length")
    if not request.words:
        without({"ocr", "frame"}, "without words the transcript is listed")
    elif not footing:
        without({"frame"}, "no word of the query occurs anywhere, and the nearest frames would be found all the same")
    if request.vector is None:
        without({"frame"}, "the query has no vector")
    return tuple(x for x in LEGS if x in legs), notes


def has_footing(request: Request, *indexes: Index) -> bool:
    """Does any word of the query, or what it begins, stand in any index? Without words there is nothing to miss."""
    for index in indexes:
        terms = index.analyzer.terms(index.spark, request.words)
        if not terms or not index.vocabulary(terms, [t for t in terms if expands(t)]).limit(1).isEmpty():
            return True
    return False


def _scope(corpus: Corpus, request: Request) -> DataFrame:
    rows = corpus.videos
    for column, wanted in (("channel", request.channels), ("video_id", request.video_ids)):
        rows = rows if wanted is None else rows.where(F.col(column).isin(*wanted) if wanted else F.lit(False))
    return rows.select("video_id").distinct()


def _within(rows: DataFrame, request: Request, start: str, end: str) -> DataFrame:
    size = F.length("text")
    for bound, fits in (
        (request.t_from, F.col(end) >= F.lit(request.t_from)),
        (request.t_to, F.col(start) <= F.lit(request.t_to)),
        (request.min_chars, size >= F.lit(request.min_chars)),
        (request.max_chars, size <= F.lit(request.max_chars)),
    ):
        rows = rows if bound is None else rows.where(fits)
    return rows


def _fused(leg: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Adds the score of a rank over capped candidates."""
    return R.ranked(leg, list(order)).withColumn("score", F.lit(1.0) / (F.lit(R.RRF) + F.col("r"))).drop("r")


_HIT = ("source", "frame_id", "video_id", "start_s", "end_s", "text", "score")


def _pool(rows: DataFrame, request: Request, leg: str) -> DataFrame:
    """The best of a leg: no video more than a few times its share. ``n_<leg>`` counts them, up to one hit beyond the pool to tell that it is full."""
    share = min(50, max(3 * request.per_video, request.per_video + 2))
    order = [F.desc("score"), F.asc("video_id"), F.asc("start_s")]
    pool = capped(rows, "video_id", share, order).orderBy(*order).limit(POOL + 1).select(*_HIT)
    counted = pool.withColumn(f"n_{leg}", F.count("*").over(W.partitionBy(F.lit(0))))  # POOL + 1 rows at most
    return counted.orderBy(*order).limit(POOL)


def _together(pools: Sequence[DataFrame], legs: Sequence[str]) -> DataFrame:
    """Pools in one table, each row with the counts of all legs: a leg without a row has 0."""
    names = [f"n_{leg}" for leg in legs]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pools)
    return every.withColumns({n: F.coalesce(F.max(n).over(W.partitionBy(F.lit(0))), F.lit(0)) for n in names})  # the pools' rows


def _transcript(corpus: Corpus, scope: DataFrame, request: Request) -> DataFrame:
    cues = _within(corpus.cues.join(scope, "video_id", "left_semi"), request, "start_s", "end_s")
    cues = cues if request.speaker is None else cues.where(F.contains(F.lower("speaker"), F.lit(request.speaker.lower())))
    if request.words:
        found = match(corpus.cue_index, request.words, expand=True, scope=cues.select(F.col("cue_id").alias("id")))
        first = found.orderBy(F.desc("score"), "id").limit(R.CANDIDATES)
        ranked = _fused(first, [F.desc("score"), F.asc("id")]).select(F.col("id").alias("cue_id"), "score")
        hits = cues.join(F.broadcast(ranked), "cue_id")  # CANDIDATES rows at most
    else:
        by_place = [F.asc("video_id"), F.asc("start_s"), F.asc("cue_id")]
        hits = _fused(cues.orderBy(*by_place).limit(R.CANDIDATES), by_place)
    # A run of cues is one hit; its best cue is what the link points at.
    best = F.max_by("start_s", F.struct("score", -F.col("start_s")))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_s", "cue_id", "text"))), lambda x: x["text"]), " ")
    runs = islands(hits, request.gap).groupBy("video_id", "island").agg(
        best.alias("start_s"), F.max("end_s").alias("end_s"), texts.alias("text"), F.max("score").alias("score")
    )
    return runs.withColumns({"source": F.lit("transcript"), "frame_id": F.lit(None).cast("long")})


def _ocr(corpus: Corpus, scope: DataFrame, request: Request) -> DataFrame:
    lines = _within(corpus.lines.join(scope, "video_id", "left_semi"), request, "t_s", "t_s")
    found = match(corpus.line_index, request.words, expand=True, scope=lines.select(F.col("frame_id").alias("id")))
    first = found.orderBy(F.desc("score"), "id").limit(R.CANDIDATES)
    ranked = _fused(first, [F.desc("score"), F.asc("id")]).select(F.col("id").alias("frame_id"), "score")
    hits = lines.join(F.broadcast(ranked), "frame_id")  # CANDIDATES rows at most
    return hits.select(F.lit("ocr").alias("source"), "frame_id", "video_id", F.col("t_s").alias("start_s"), F.col("t_s").alias("end_s"), "text", "score")


def _frame(corpus: Corpus, scope: DataFrame, request: Request) -> DataFrame:
    near = corpus.frames.knn(list(request.vector), NEAREST, scope.withColumnRenamed("video_id", "owner"), request.t_from, request.t_to)
    kept = R.relevance_band(near, request.frame_ceiling, request.frame_band)
    at = F.col("t_s")
    hits = _fused(kept, [F.asc("distance"), F.asc("id")])
    return hits.select(F.lit("frame").alias("source"), F.col("id").alias("frame_id"), F.col("owner").alias("video_id"), at.alias("start_s"), at.alias("end_s"), F.lit("").alias("text"), "score")


_RUN = {"transcript": _transcript, "ocr": _ocr, "frame": _frame}


def _collapsed(hits: DataFrame) -> DataFrame:
    """What two legs say of one frame is one hit: scores add up, the longer text stays. At most the pools' rows.

    Other columns are the legs' counts, which all rows share.
    """
    counts = [c for c in hits.columns if c not in _HIT]
    alone = hits.where("frame_id IS NULL").withColumn("n_legs", F.lit(1).cast("long"))
    longest = F.max_by("text", F.struct(F.length("text"), "text"))
    met = hits.where("frame_id IS NOT NULL").groupBy("frame_id", "video_id").agg(
        F.array_join(F.reverse(F.array_sort(F.collect_set("source"))), "+").alias("source"),
        F.min("start_s").alias("start_s"),
        F.max("end_s").alias("end_s"),
        longest.alias("text"),
        F.sum("score").alias("score"),
        F.count("*").alias("n_legs"),
        *[F.max(c).alias(c) for c in counts],
    )
    return alone.unionByName(met.select(*alone.columns))


def _scored(hits: DataFrame, words: Sequence[str]) -> DataFrame:
    """``exact``: the words stand there as one phrase; ``coverage``: the part of them that stands there at all."""
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(R.tokens(c), " "), F.lit(" "))
    body, asked = F.col("__body"), [F.lit(w) for w in words]
    if not asked:
        return hits.withColumns({"exact": F.lit(0), "coverage": F.lit(0.0)})
    held = reduce(lambda a, b: a + b, [F.contains(body, spaced(w)).cast("int") for w in asked])
    exact = F.contains(body, spaced(F.concat_ws(" ", *asked))).cast("int") if len(asked) > 1 else F.lit(0)
    both = {"exact": exact, "coverage": F.round(held / len(asked), 2)}
    return hits.withColumn("__body", spaced(F.col("text"))).withColumns(both).drop("__body")


def search(spark: SparkSession, corpus: Corpus, request: Request) -> Answer:
    """One page of hits and what they were chosen from."""
    scope = _scope(corpus, request)
    n_scope = scope.count()
    if not n_scope:
        return Answer("empty_corpus" if corpus.videos.isEmpty() else "no_video", counts={"videos": 0})
    footing = has_footing(request, corpus.cue_index, corpus.line_index)
    legs, notes = plan_legs(request, footing)
    counts = {"videos": n_scope, **dict.fromkeys(LEGS, 0), "total": 0}
    empty = Answer("nothing_matched" if footing else "no_footing", notes=notes, counts=counts)
    if not legs:
        return empty
    hits = _together([_pool(_RUN[leg](corpus, scope, request), request, leg) for leg in legs], legs)
    hits = _scored(_collapsed(hits), request.words)
    hits = hits.join(corpus.videos.select("video_id", "channel", "title", "published"), "video_id") if request.order == "recency" else hits
    worth = [F.desc("score"), F.desc("exact"), F.desc("coverage"), F.desc("n_legs")]
    last = [F.asc("video_id"), F.asc("start_s"), F.asc("source"), F.asc_nulls_first("frame_id"), F.asc("text")]
    ahead = {"relevance": [], "recency": [F.desc_nulls_last("published")], "video_time": [F.asc("start_s")]}[request.order]
    order = [*ahead, *worth, *last]
    kept = capped(hits.withColumn("score", F.round("score", 6)), "video_id", request.per_video, order)
    counted = R.ranked(kept, order, "place").withColumn("n_total", F.count("*").over(W.partitionBy(F.lit(0))))  # the pools' rows
    on_page = (F.col("place") > request.offset) & (F.col("place") <= request.offset + request.limit)
    placed = counted.where(on_page | (F.col("place") == 1))  # the first says the counts, on whatever page it is
    if request.order != "recency":  # names are read for the page alone
        placed = corpus.videos.select("video_id", "channel", "title", "published").join(F.broadcast(placed), "video_id", "right")
    columns = ["place", "source", "video_id", "channel", "title", "start_s", "end_s", "text", "score", "exact", "coverage", "n_legs"]
    counters = [f"n_{leg}" for leg in legs]
    read = sorted(placed.select(*columns, *counters, "n_total").collect(), key=lambda r: r["place"])  # ``limit`` rows at most, and one
    rows = [r for r in read if request.offset < r["place"] <= request.offset + request.limit]
    n = {leg: read[0][f"n_{leg}"] if read else 0 for leg in legs}
    counts |= {leg: min(POOL, k) for leg, k in n.items()} | {"total": read[0]["n_total"] if read else 0}
    full = any(k > POOL for k in n.values())
    if not counts["total"]:
        return empty
    by_video: dict[int, int] = {}
    for r in rows:
        by_video[r["video_id"]] = by_video.get(r["video_id"], 0) + 1
    dominant = sorted(v for v, n in by_video.items() if n >= request.per_video)
    return Answer("page" if rows else "past_end", rows, notes, counts, counts["total"] > request.offset + request.limit, full, dominant)
