"""Caption tracks and metadata: tracks are written from the tables, parsed, and held against the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import captions as K
from loomspark.registry import core
from loomspark.sources.tables import read

_MS = "CAST(turn * 7250 + conv_id % 5 * 1000 AS BIGINT)"


def _stamp(ms: Column) -> Column:
    hours, rest = F.floor(ms / 3_600_000), F.format_string("%02d:%02d", F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60)
    head = F.when((F.col("conv_id") % 2 == 0) | (hours > 0), F.concat(F.format_string("%02d", hours), F.lit(":"), rest)).otherwise(rest)
    return F.concat(head, F.when(F.col("conv_id") % 3 == 0, ",").otherwise("."), F.format_string("%03d", ms % 1000))


def _joined(turns: DataFrame, block: Column, head: str) -> DataFrame:
    """(conv_id, track): a conversation's turns in order; a conversation is a document, and its size a track's."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"])
    return turns.groupBy("conv_id").agg(F.concat(F.lit(head), F.array_join(parts, "\n\n")).alias("track"))


@core.query(
    "vtt_cues",
    rf"""WITH c AS (SELECT conv_id, turn, {_MS} / 1000.0 AS start_s,
  array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' ') AS text
  FROM conversations)
SELECT conv_id, CAST(start_s AS DOUBLE) AS start_s, CAST(start_s + 6.5 AS DOUBLE) AS end_s, text FROM c WHERE text <> ''""",
)
def vtt_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    ms = F.expr(_MS)
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r"\n\s*\n", "\n")
    block = F.concat(_stamp(ms), F.lit(" --> "), _stamp(ms + 6500), F.lit(" align:start\n<v someone>"), said, F.lit("</v>"))
    return K.vtt_cues(_joined(turns, block, "WEBVTT\n\n"), "conv_id", "track")


@core.query(
    "json3_words",
    rf"""WITH c AS (SELECT conv_id, {_MS} AS t, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM conversations)
SELECT conv_id, t / CAST(1000 AS DOUBLE) AS start_s, (t + len(w) * 200) / CAST(1000 AS DOUBLE) AS end_s, array_to_string(w, ' ') AS text,
  CAST(len(w) AS INTEGER) AS n_words, (t + (len(w) - 1) * 200) / CAST(1000 AS DOUBLE) AS last_word_s FROM c WHERE len(w) > 0""",
)
def json3_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").withColumn("ms", F.expr(_MS).cast("double"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    seg = lambda text, offset: F.struct(text.alias("utf8"), offset.cast("double").alias("tOffsetMs"))
    # Every third word has no offset; line breaks stand between words.
    segs = F.transform("w", lambda x, i: F.array(seg(F.concat(F.lit(" "), x), F.when((i > 0) & (i % 3 != 2), i * 200)), seg(F.lit("\n"), F.lit(None))))
    length = F.size("w") * 200.0
    event = lambda append, s: F.struct(F.col("ms").alias("tStartMs"), length.alias("dDurationMs"), F.lit(append).alias("aAppend"), s.alias("segs"))
    none = F.array().cast("array<struct<utf8:string,tOffsetMs:double>>")
    events = turns.withColumn("w", words).select("conv_id", F.array(event(0, none), event(0, F.flatten(segs)), event(1, F.flatten(segs))).alias("e"))
    tracks = events.groupBy("conv_id").agg(F.to_json(F.struct(F.flatten(F.collect_list("e")).alias("events"))).alias("track"))
    cues = K.json3_cues(tracks, "conv_id", "track")
    return cues.select("conv_id", "start_s", "end_s", "text", F.size("words").alias("n_words"), F.element_at("words", -1)["start_s"].alias("last_word_s"))


def infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, info): metadata as a site would give it, written as JSON and parsed again."""
    k = F.col("doc_id") % 4
    stamp = F.lit(1_700_000_000) + F.col("doc_id") * 60
    chapter = lambda start, end, title: F.struct(start.alias("start_time"), end.alias("end_time"), title.alias("title"))
    number, none = lambda x: F.lit(x).cast("double"), F.lit(None)
    track = lambda ext: F.struct(F.lit(ext).alias("ext"), F.concat(F.lit("https://example.org/"), F.lit(ext)).alias("url"))
    catalogue = lambda *pairs: F.map_from_arrays(F.array(*[p[0] for p in pairs]), F.array(*[F.array(*map(track, p[1])) for p in pairs]))
    lang = F.coalesce("lang", F.lit("xx"))
    made = F.struct(
        F.when(k == 0, stamp).cast("double").alias("timestamp"),
        F.when(k == 1, stamp).when(k == 0, 1).cast("double").alias("release_timestamp"),
        F.when(k == 2, "20240229").when(k == 3, "2024-02").alias("upload_date"),
        F.col("n_chars").cast("double").alias("duration"),
        F.array(
            chapter(number(0), number(10), F.lit("opening")), chapter(number(20), number(5), F.lit("")), chapter(number(30), none.cast("double"), F.lit("end"))
        ).alias("chapters"),
        F.when(k != 3, catalogue((lang, ("ttml", "vtt")))).alias("subtitles"),
        F.when(k == 1, catalogue((F.lit("zz"), ("json3",)), (F.lit("en"), ("srt", "srv3")))).alias("automatic_captions"),
    )
    return read(spark, sf_dir, "documents").select("doc_id", F.from_json(F.to_json(made), K.INFO).alias("info"))


@core.query(
    "published_at",
    "SELECT doc_id, CAST(CASE WHEN doc_id % 4 IN (0, 1) THEN 1700000000 + doc_id * 60 WHEN doc_id % 4 = 2 THEN epoch(DATE '2024-02-29') END AS BIGINT) AS at FROM documents",
)
def published_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infos(spark, sf_dir).select("doc_id", K.published_at(F.col("info")).alias("at"))


@core.query(
    "chapters_parse",
    """SELECT doc_id, 0 AS seq, CAST(0 AS DOUBLE) AS start_s, CAST(10 AS DOUBLE) AS end_s, 'opening' AS title FROM documents
UNION ALL SELECT doc_id, 1, 20, 20, 'chapter 2' FROM documents
UNION ALL SELECT doc_id, 2, 30, greatest(30, coalesce(nullif(n_chars, 0), 30)), 'end' FROM documents""",
)
def chapters_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chapters(infos(spark, sf_dir), "doc_id", "info")


@core.query(
    "subtitle_rank",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'en' ELSE coalesce(lang, 'xx') END AS lang,
  CASE WHEN doc_id % 4 = 1 THEN 'srv3' ELSE 'vtt' END AS ext, doc_id % 4 = 1 AS automatic FROM documents WHERE doc_id % 4 <> 3""",
)
def subtitle_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.best_subtitle(infos(spark, sf_dir), "doc_id", "info", ["en", "de"])
