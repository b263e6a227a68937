"""Queries of the whole search: one for a page of each order, one for each way to find nothing, and stemmed lookups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.stemming import stem
from loomspark.operators import inverted as I
from loomspark.operators import search as S
from loomspark.operators.keyed import KeyedTable
from loomspark.operators.vector_store import VectorStore
from loomspark.plans import corpus as C
from loomspark.plans import text_sql as X
from loomspark.registry import core
from loomspark.sources.tables import read
from loomspark.store import Files, complete, derived

#: Frames stand at a second of their own: number modulo this.
_SECONDS = 60


def _page_text() -> Column:
    return F.regexp_replace("html", "<[^>]*>", " ")


def cue_index(spark: SparkSession, sf_dir: str) -> I.Index:
    cue_id = F.col("conv_id") * 1000 + F.col("turn")
    return I.open_or_build(spark, f"{sf_dir}/conversations.parquet", cue_id, {"text": F.col("text")}, I.PROSE)


def line_index(spark: SparkSession, sf_dir: str) -> I.Index:
    return I.open_or_build(spark, f"{sf_dir}/pages.parquet", "page_id", {"text": _page_text()}, I.SCREEN)


def frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as frames: one for each video."""
    at = (F.col("vec_id") % _SECONDS).cast("double")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("owner"), at.alias("t_s"), F.col("embedding").alias("vector"))


def frame_store(spark: SparkSession, sf_dir: str) -> VectorStore:
    path = derived(spark, f"{sf_dir}/embeddings.parquet", "frames-v1")
    if not Files(spark).exists(path):
        with complete(spark, path) as aside:
            VectorStore.at(spark, aside).write(frame_rows(spark, sf_dir))
    return VectorStore.at(spark, path)


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    published = F.lit(C.NOW) - F.col("video_id") * 7919 % 1000 * 86400
    return C.videos(spark, sf_dir).select("video_id", "channel", "title", published.alias("published"))


def corpus(spark: SparkSession, sf_dir: str) -> S.Corpus:
    lines = read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("frame_id"), F.col("page_id").alias("video_id"), (F.col("page_id") % _SECONDS).cast("double").alias("t_s"), F.coalesce(_page_text(), F.lit("")).alias("text")
    )
    cues = C.cues(spark, sf_dir).select("video_id", "cue_id", "speaker", "start_s", "end_s", "text")
    return S.Corpus(videos(spark, sf_dir), cues, cue_index(spark, sf_dir), lines, line_index(spark, sf_dir), frame_store(spark, sf_dir))


# --- stemmed lookups -------------------------------------------------------------------------------------------------


def _postings_sql(name: str, rows: str, tokens: str, stemmed: bool) -> str:
    """``name`` (id, term, dl, tf) of ``rows`` (id, text)."""
    split = f"{name}_w AS (SELECT id, {tokens.format('text')} AS ws FROM {rows}), {name}_t AS (SELECT id, len(ws) AS dl, unnest(ws) AS term FROM {name}_w)"
    if not stemmed:
        return f"{split}, {name} AS (SELECT id, term, max(dl) AS dl, count(*) AS tf FROM {name}_t GROUP BY id, term)"
    return f"{split},\n{X.stems(name + '_t')},\n{name} AS (SELECT id, stem AS term, max(dl) AS dl, count(*) AS tf FROM {name}_t JOIN stems USING (term) GROUP BY id, stem)"


def _match_sql(out: str, name: str, terms: list[str], mode: str, expand: bool) -> str:
    """``out`` (id, score, n_terms) from postings ``name``, frequencies of the whole table."""
    hit = [f"starts_with(term, '{t}')" if expand and I.expands(t) else f"term = '{t}'" for t in terms]
    tf = ", ".join(f"coalesce(sum(tf) FILTER ({h}), 0) AS tf{i}" for i, h in enumerate(hit))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    part = " + ".join(
        f"greatest(ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"
        for i in range(len(terms))
    )
    count = " + ".join(f"(tf{i} > 0)::INTEGER" for i in range(len(terms)))
    least = len(terms) if mode == "all" else 1
    return f"""{out}_g AS (SELECT id, max(dl) AS dl, {tf} FROM {name} WHERE {' OR '.join(hit)} GROUP BY id),
{out}_d AS (SELECT {df} FROM {out}_g), {out}_n AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM {name}_w),
{out} AS (SELECT id, round({part}, 6) AS score, {count} AS n_terms FROM {out}_g, {out}_d, {out}_n WHERE {count} >= {least})"""


_CUE_ROWS = "cue_rows AS (SELECT conv_id * 1000 + turn AS id, coalesce(text, '') AS text FROM conversations)"
_LINE_ROWS = "line_rows AS (SELECT page_id AS id, coalesce(regexp_replace(html, '<[^>]*>', ' ', 'g'), '') AS text FROM pages)"
_CUE_POSTINGS = f"{_CUE_ROWS},\n{_postings_sql('cue_p', 'cue_rows', X.PROSE, True)}"
_LINE_POSTINGS = f"{_LINE_ROWS},\n{_postings_sql('line_p', 'line_rows', X.SCREEN, False)}"

#: A word with an accent and an ending, and one that begins others.
_PROSE_WORDS = ("Étions", "thing")


@core.query(
    "prose_search",
    f"WITH {_CUE_POSTINGS},\n{_match_sql('m', 'cue_p', [stem('etions'), stem('thing')], 'any', True)} SELECT id AS cue_id, score, CAST(n_terms AS INTEGER) AS n_terms FROM m ORDER BY score DESC, id LIMIT 50",
)
def prose_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stemmed, accent-free words that also stand for what they begin."""
    found = I.match(cue_index(spark, sf_dir), _PROSE_WORDS, mode="any", expand=True)
    return found.select(F.col("id").alias("cue_id"), "score", "n_terms").orderBy(F.desc("score"), "cue_id").limit(50)


@core.query(
    "vocabulary_prefix",
    f"WITH {_CUE_POSTINGS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM cue_p WHERE starts_with(term, 'tion') GROUP BY term",
)
def vocabulary_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue_index(spark, sf_dir).vocabulary(prefixes=["tion"]).select("term", "df", "cf")


@core.query(
    "screen_search",
    f"WITH {_LINE_POSTINGS},\n{_match_sql('m', 'line_p', ['the'], 'all', False)} SELECT id AS frame_id, score FROM m ORDER BY score DESC, id LIMIT 50",
)
def screen_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.match(line_index(spark, sf_dir), ["the"])
    return found.select(F.col("id").alias("frame_id"), "score").orderBy(F.desc("score"), "frame_id").limit(50)


# --- nearest frames --------------------------------------------------------------------------------------------------

_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_D = f"round(1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]), 6)"


def _vector(spark: SparkSession, sf_dir: str) -> tuple[float, ...]:
    return tuple(read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()["embedding"])


@core.query(
    "frame_knn",
    f"SELECT vec_id AS id, CAST(vec_id % 60 AS DOUBLE) AS t_s, {_D} AS distance FROM embeddings WHERE vec_id % 3 <> 1 AND vec_id % 60 BETWEEN 10 AND 45 ORDER BY distance, id LIMIT 30",
)
def frame_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest frames of two thirds of the videos between two moments, by way of 8-bit codes."""
    scope = read(spark, sf_dir, "embeddings").where("vec_id % 3 <> 1").select(F.col("vec_id").alias("owner"))
    return frame_store(spark, sf_dir).knn(list(_vector(spark, sf_dir)), 30, scope, 10.0, 45.0).select("id", "t_s", "distance")


@core.query(
    "frame_replace",
    f"""WITH v AS (SELECT vec_id AS id, embedding FROM embeddings WHERE vec_id % 4 <> 0
  UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda x: -x) FROM embeddings WHERE vec_id % 4 = 0 AND vec_id % 8 <> 0)
SELECT id, {_D} AS distance FROM v ORDER BY distance, id LIMIT 40""",
)
def frame_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth video is embedded anew, every eighth has no frames any more; written twice, as after a lost job."""
    path = f"{derived(spark, f'{sf_dir}/embeddings.parquet', 'frames-changed')}"
    rows = frame_rows(spark, sf_dir)
    store = VectorStore.at(spark, path, folders=8).write(rows)
    new = rows.where("owner % 4 = 0 AND owner % 8 <> 0").select((F.col("id") + 1_000_000).alias("id"), "owner", "t_s", F.transform("vector", lambda x: -x).alias("vector"))
    for _ in range(2):
        store.replace(new, rows.where("owner % 8 = 0").select("owner"))
    return store.knn(list(_vector(spark, sf_dir)), 40).select("id", "distance")


# --- keyed tables ----------------------------------------------------------------------------------------------------


@core.query(
    "stage_upsert",
    f"""WITH {C.STAGES}, n AS (
  SELECT video_id, stage, 'done' AS state FROM stages WHERE stage = 'ocr' AND video_id % 3 = 0
  UNION ALL SELECT doc_id, 'frames', CASE WHEN n_chars > 1000 THEN 'pending' ELSE 'skipped' END FROM documents WHERE doc_id % 5 = 0)
SELECT video_id, stage, coalesce(n.state, s.state) AS state, n.state IS NOT NULL AS changed FROM stages s FULL JOIN n USING (video_id, stage)""",
)
def stage_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage rows by (video, stage), written twice; a later row counts more than an earlier one of the same key."""
    stages = C.stages(spark, sf_dir).withColumns({"changed": F.lit(False), "at": F.lit(0)})
    done = stages.where("stage = 'ocr' AND video_id % 3 = 0").withColumns({"state": F.lit("done"), "changed": F.lit(True), "at": F.lit(2)})
    soon = done.withColumns({"state": F.lit("running"), "at": F.lit(1)})
    frames = read(spark, sf_dir, "documents").where("doc_id % 5 = 0").select(
        F.col("doc_id").alias("video_id"), F.lit("frames").alias("stage"), F.when(F.col("n_chars") > 1000, "pending").otherwise("skipped").alias("state"), F.lit(True).alias("changed"), F.lit(1).alias("at")
    )
    table = KeyedTable(spark, derived(spark, f"{sf_dir}/labels.parquet", "stages-changed"), ("video_id",), 8).write(stages)
    for _ in range(2):
        table.upsert(done.unionByName(soon).unionByName(frames), ["video_id", "stage"], order=[F.col("at")])
    return table.read().select("video_id", "stage", "state", "changed")


@core.query(
    "backfill_documents",
    f"""WITH {C.FRAMES}, d AS (SELECT video_id, count(*) AS n_frames, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds, max(t_s) AS last_s FROM frames GROUP BY video_id)
SELECT video_id, CASE WHEN video_id % 7 = 0 THEN -1 ELSE n_frames END AS n_frames, CASE WHEN video_id % 7 = 0 THEN 'kept' ELSE kinds END AS kinds,
 CASE WHEN video_id % 7 = 0 THEN 0 ELSE last_s END AS last_s FROM d""",
)
def backfill_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new table's rows from an old one's groups; what is there already stays, so the backfill may run again."""
    frames = C.frames(spark, sf_dir)
    grouped = frames.groupBy("video_id").agg(
        F.count("*").alias("n_frames"), F.array_join(F.sort_array(F.collect_set("kind")), "|").alias("kinds"), F.max("t_s").alias("last_s")  # a handful of kinds
    )
    there = frames.where("video_id % 7 = 0").select("video_id").distinct()
    there = there.select("video_id", F.lit(-1).cast("long").alias("n_frames"), F.lit("kept").alias("kinds"), F.lit(0).cast("long").alias("last_s"))
    table = KeyedTable(spark, derived(spark, f"{sf_dir}/events.parquet", "frame-documents"), ("video_id",), 8).write(there)
    for _ in range(2):
        table.insert_missing(grouped, ["video_id"])
    return table.read()


# --- the whole search ------------------------------------------------------------------------------------------------

_SHAPE = "state string, place int, source string, video_id long, channel string, start_s double, score double, n_legs long, has_more boolean, n_videos long, n_transcript long, n_ocr long, n_frame long, n_total long"
_FRAME = {"frame_ceiling": 0.9, "frame_band": 0.9}


def _rows(spark: SparkSession, answer: S.Answer) -> DataFrame:
    """A page's rows, or one row that says why there are none."""
    counts = [answer.counts.get(k, 0) for k in ("videos", *S.LEGS, "total")]
    rows = [(answer.state, r["place"], r["source"], r["video_id"], r["channel"], r["start_s"], r["score"], r["n_legs"], answer.has_more, *counts) for r in answer.rows]
    return spark.createDataFrame(rows or [(answer.state, *[None] * 7, answer.has_more, *counts)], _SHAPE)


def _search_sql(words: tuple[str, ...], channel: str | None = None, order: str = "relevance", limit: int = 10, offset: int = 0, per_video: int = 3, frames: bool = True) -> str:
    """The search in SQL, for words that no index splits: the legs, their fusion, the cap and the page."""
    share = min(50, max(3 * per_video, per_video + 2))
    cue_terms, line_terms = [stem(w) for w in words], list(words)
    scope = f"WHERE source = '{channel}'" if channel else ""
    phrase = " ".join(words)
    pool = lambda leg: f"""{leg}_c AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, start_s) AS c FROM {leg}),
{leg}_p AS (SELECT * EXCLUDE (c) FROM {leg}_c WHERE c <= {share} ORDER BY score DESC, video_id, start_s LIMIT 400)"""  # noqa: E731
    ahead = {"relevance": "", "recency": "published DESC NULLS LAST, "}[order]
    keys = f"{ahead}score DESC, exact DESC, coverage DESC, n_legs DESC, video_id, start_s, source, frame_id NULLS FIRST, text"
    held = " + ".join(f"contains(body, ' {w} ')::INTEGER" for w in words)
    return f"""WITH {C.CUES}, scope AS (SELECT DISTINCT doc_id AS video_id FROM documents {scope}),
{_CUE_POSTINGS}, {_LINE_POSTINGS},
{_match_sql('cm', 'cue_p', cue_terms, 'all', True)}, {_match_sql('lm', 'line_p', line_terms, 'all', True)},
ch AS (SELECT c.*, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id)) AS score FROM cm JOIN cues c ON c.cue_id = cm.id JOIN scope USING (video_id) QUALIFY row_number() OVER (ORDER BY cm.score DESC, id) <= 5000),
ci AS (SELECT *, CASE WHEN start_s - lag(end_s) OVER w <= 8 AND floor(start_s / 120) = floor(lag(start_s) OVER w / 120)
    AND end_s <= (floor(start_s / 120) + 1) * 120 AND lag(end_s) OVER w <= (floor(lag(start_s) OVER w / 120) + 1) * 120 THEN 0 ELSE 1 END AS is_new
  FROM ch WINDOW w AS (PARTITION BY video_id ORDER BY start_s, cue_id)),
cn AS (SELECT *, sum(is_new) OVER (PARTITION BY video_id ORDER BY start_s, cue_id ROWS UNBOUNDED PRECEDING) AS island FROM ci),
transcript AS (SELECT 'transcript' AS source, CAST(NULL AS BIGINT) AS frame_id, video_id, arg_max(start_s, (score, -start_s)) AS start_s, string_agg(text, ' ' ORDER BY start_s, cue_id) AS text, max(score) AS score FROM cn GROUP BY video_id, island),
ocr AS (SELECT 'ocr' AS source, id AS frame_id, id AS video_id, CAST(id % 60 AS DOUBLE) AS start_s, text, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id)) AS score
  FROM lm JOIN line_rows USING (id) JOIN scope ON scope.video_id = id QUALIFY row_number() OVER (ORDER BY lm.score DESC, id) <= 5000),
near AS (SELECT vec_id AS id, {_D} AS d FROM embeddings JOIN scope ON scope.video_id = vec_id WHERE {str(frames).lower()} ORDER BY d, id LIMIT 800),
frame AS (SELECT 'frame' AS source, id AS frame_id, id AS video_id, CAST(id % 60 AS DOUBLE) AS start_s, '' AS text, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY d, id)) AS score
  FROM near WHERE d <= 0.9 AND d <= (SELECT min(d) FROM near) + 0.9),
{pool('transcript')}, {pool('ocr')}, {pool('frame')},
fused AS (
  SELECT source, frame_id, video_id, start_s, text, score, 1 AS n_legs FROM transcript_p
  UNION ALL SELECT string_agg(source, '+' ORDER BY source DESC), frame_id, video_id, min(start_s), arg_max(text, (length(text), text)), sum(score), count(*)
  FROM (SELECT * FROM ocr_p UNION ALL SELECT * FROM frame_p) GROUP BY frame_id, video_id),
body AS (SELECT * EXCLUDE (score), round(score, 6) AS score, ' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ') || ' ' AS body FROM fused),
worth AS (SELECT b.*, {'contains(body, ' + repr(f' {phrase} ') + ')::INTEGER' if len(words) > 1 else '0'} AS exact, round(({held}) / {len(words)}::DOUBLE, 2) AS coverage,
  source_of.source AS channel, {C.NOW} - b.video_id * 7919 % 1000 * 86400 AS published FROM body b JOIN documents source_of ON doc_id = b.video_id),
kept AS (SELECT * FROM worth QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY {keys}) <= {per_video}),
placed AS (SELECT *, row_number() OVER (ORDER BY {keys}) AS place FROM kept),
counts AS (SELECT (SELECT count(*) FROM scope) AS n_videos, (SELECT count(*) FROM transcript_p) AS n_transcript, (SELECT count(*) FROM ocr_p) AS n_ocr, (SELECT count(*) FROM frame_p) AS n_frame, (SELECT count(*) FROM kept) AS n_total),
page AS (SELECT * FROM placed WHERE place > {offset} AND place <= {offset + limit})
SELECT 'page' AS state, CAST(place AS INTEGER) AS place, source, video_id, channel, start_s, score, CAST(n_legs AS BIGINT) AS n_legs, n_total > {offset + limit} AS has_more, counts.* FROM page, counts
UNION ALL SELECT CASE WHEN n_total > 0 THEN 'past_end' ELSE 'nothing_matched' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false, counts.* FROM counts WHERE NOT EXISTS (FROM page)"""


def _register(name: str, oracle: str, request: Callable[[SparkSession, str], S.Request], narrowed: Callable[[S.Corpus], S.Corpus] = lambda c: c) -> None:
    @core.query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rows(spark, S.search(spark, narrowed(corpus(spark, sf_dir)), request(spark, sf_dir)))


def _state(state: str, videos: str = "0") -> str:
    """Nothing was found, and no leg had a hit."""
    return f"""SELECT '{state}' AS state, CAST(NULL AS INTEGER) AS place, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS BIGINT) AS video_id, CAST(NULL AS VARCHAR) AS channel, CAST(NULL AS DOUBLE) AS start_s,
 CAST(NULL AS DOUBLE) AS score, CAST(NULL AS BIGINT) AS n_legs, false AS has_more, CAST({videos} AS BIGINT) AS n_videos, 0::BIGINT AS n_transcript, 0::BIGINT AS n_ocr, 0::BIGINT AS n_frame, 0::BIGINT AS n_total"""


_ALL = "(SELECT count(DISTINCT doc_id) FROM documents)"
_register("search_page", _search_sql(("the", "and"), limit=20), lambda s, d: S.Request(("the", "and"), _vector(s, d), limit=20, **_FRAME))
_register(
    "search_second_page",
    _search_sql(("the",), channel="src3", limit=5, offset=5, per_video=2),
    lambda s, d: S.Request(("the",), _vector(s, d), channels=("src3",), limit=5, offset=5, per_video=2, **_FRAME),
)
_register("search_recent", _search_sql(("of",), order="recency", limit=25, frames=False), lambda s, d: S.Request(("of",), order="recency", limit=25))
_register("search_past_end", _search_sql(("the",), offset=100_000, frames=False), lambda s, d: S.Request(("the",), offset=100_000))
_register("search_nothing_matched", _state("nothing_matched", _ALL), lambda s, d: S.Request(("the",), content="transcript", min_chars=10**8))
_register("search_no_footing", _state("no_footing", _ALL), lambda s, d: S.Request(("zzyzzx",), _vector(s, d), **_FRAME))
_register("search_no_video", _state("no_video"), lambda s, d: S.Request(("the",), channels=("nobody's",)))
_register(
    "search_empty_corpus",
    _state("empty_corpus"),
    lambda s, d: S.Request(("the",)),
    lambda c: S.Corpus(c.videos.where("video_id < 0"), c.cues, c.cue_index, c.lines, c.line_index, c.frames),
)
