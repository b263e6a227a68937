"""Queries that apply one scalar function to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.plans import corpus as C
from loomspark.registry import core
from loomspark.sources.tables import read

N = C.NOW


@core.query("normalize_text", r"SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM benchmark")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", X.normalize(F.col("text")).alias("norm"))


@core.query("middle_truncate", "SELECT item_id, CASE WHEN length(text) <= 41 THEN text ELSE left(text, 20) || '…' || right(text, 20) END AS short FROM benchmark")
def middle_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", X.middle_truncate(F.col("text"), 41).alias("short"))


@core.query("keep_match", "SELECT item_id, substr(text, CAST(greatest(1, instr(lower(text), 'the') - 20) AS INTEGER), 60) AS window FROM benchmark WHERE instr(lower(text), 'the') > 0")
def keep_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").where(F.lower("text").contains("the")).select("item_id", X.around(F.col("text"), "the", 20, 60).alias("window"))


@core.query("tag_validate", "SELECT p_partkey, regexp_matches(lower(p_type) || ':' || replace(p_name, ' ', '-'), '^[a-z0-9]+:[a-z0-9][a-z0-9._-]{0,63}$') AS valid, split_part(p_name, ' ', 2) AS name FROM part")
def tag_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.concat(F.lower("p_type"), F.lit(":"), F.replace("p_name", F.lit(" "), F.lit("-")))
    return read(spark, sf_dir, "part").select("p_partkey", X.valid_tag(tag).alias("valid"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name"))


_CUT = r"[\s\p{Z}]+[-–—][\s\p{Z}]+"


@core.query(
    "split_title",
    rf"""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' - ' || p_brand || ', ' || p_type WHEN 1 THEN p_name
  WHEN 2 THEN p_name || ' – ' || p_brand || '?' ELSE p_name || ' - ' || p_type || chr(160) || '—' || chr(160) || p_brand END AS t FROM part),
c AS (SELECT *, string_split_regex(t, '{_CUT}')[-1] AS tail FROM t),
h AS (SELECT *, regexp_replace(left(t, length(t) - length(tail)), '{_CUT}$', '') AS head FROM c),
k AS (SELECT *, head <> '' AND tail <> '' AND length(tail) <= 70 AND right(tail, 1) <> '?' AS ok, instr(tail, ',') AS comma FROM h)
SELECT p_partkey, CASE WHEN ok THEN head ELSE t END AS title,
  CASE WHEN NOT ok THEN '' WHEN comma > 0 THEN trim(left(tail, comma - 1)) ELSE tail END AS speaker,
  CASE WHEN ok AND comma > 0 THEN trim(substr(tail, comma + 1)) ELSE '' END AS org FROM k""",
)
def split_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, said = F.col("p_partkey") % 4, lambda *parts: F.concat(*[F.col(x) if x.startswith("p_") else F.lit(x) for x in parts])
    t = F.when(k == 0, said("p_name", " - ", "p_brand", ", ", "p_type")).when(k == 1, F.col("p_name"))
    t = t.when(k == 2, said("p_name", " – ", "p_brand", "?")).otherwise(said("p_name", " - ", "p_type", " — ", "p_brand"))
    title, speaker, org = X.split_title(t)
    return read(spark, sf_dir, "part").select("p_partkey", title.alias("title"), speaker.alias("speaker"), org.alias("org"))


@core.query("extract_links", """WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS link FROM pages) SELECT page_id, count(*) AS n_links, min(link) AS first_link FROM l GROUP BY page_id""")
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    found = read(spark, sf_dir, "pages").select("page_id", links.alias("l")).where(F.size("l") > 0)
    return found.select("page_id", F.size("l").cast("long").alias("n_links"), F.array_min("l").alias("first_link"))


@core.query("lang_primary", "SELECT page_id, CASE WHEN regexp_matches(split_part(tag, '-', 1), '^[a-z]{2,3}$') THEN split_part(tag, '-', 1) END AS lang FROM (SELECT page_id, lower(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1)) AS tag FROM pages)")
def lang_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.lower(F.regexp_extract("html", '<html lang="([^"]*)"', 1))
    return read(spark, sf_dir, "pages").select("page_id", X.primary_language(tag).alias("lang"))


@core.query("url_source_ref", r"SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '[?&]page=(\d+)', 1) AS page, regexp_matches(url, '^https://') AS secure FROM pages")
def url_source_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(
        "page_id",
        F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1)).alias("host"),
        F.regexp_extract("url", r"[?&]page=(\d+)", 1).alias("page"),
        F.col("url").rlike("^https://").alias("secure"),
    )


@core.query("deeplink", f"WITH {C.CUES} SELECT cue_id, 'https://youtu.be/' || video_id || '?t=' || CAST(greatest(0, floor(start_s) - 2) AS BIGINT) AS link FROM cues")
def deeplink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cues(spark, sf_dir).select("cue_id", X.deeplink(F.col("video_id"), F.col("start_s")).alias("link"))


@core.query("clock_format", f"WITH {C.CUES}, s AS (SELECT cue_id, CAST(floor(start_s * 10) AS BIGINT) AS s FROM cues) SELECT cue_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') ELSE (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS clock FROM s")
def clock_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cues(spark, sf_dir).select("cue_id", X.clock(F.floor(F.col("start_s") * 10)).alias("clock"))


@core.query("parse_offset", r"WITH t AS (SELECT l_orderkey AS job_id, l_linenumber AS seq, l_partkey AS part, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ':' || lpad(CAST(l_suppkey % 60 AS VARCHAR), 2, '0') AS o FROM lineitem) SELECT job_id, seq, part, CAST(split_part(o, ':', 1) AS BIGINT) * 60 + CAST(split_part(o, ':', 2) AS BIGINT) AS seconds FROM t")
def parse_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(":"), F.lpad((F.col("l_suppkey") % 60).cast("string"), 2, "0"))
    lines = read(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"), X.offset_seconds(o).alias("seconds"))


@core.query("parse_corpus_time", f"SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN {N} WHEN 1 THEN {N} - p_size * 86400 WHEN 2 THEN {N} - p_size * 2592000 WHEN 3 THEN epoch(DATE '2024-01-01' + p_size::INTEGER) END AS BIGINT) AS at FROM part")
def parse_corpus_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).cast("string")
    said = F.when(k == 0, "now").when(k == 1, F.concat("p_size", F.lit("d ago"))).when(k == 2, F.concat("p_size", F.lit(" mo ago"))).when(k == 3, day).otherwise("sometime")
    return read(spark, sf_dir, "part").select("p_partkey", X.corpus_time(said, N).alias("at"))


@core.query("day_snap", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % 86400 AS day_start, 86400 - CAST(floor(epoch(ts)) AS BIGINT) % 86400 AS left_s FROM events")
def day_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = C.epoch(F.col("ts"))
    return read(spark, sf_dir, "events").select("event_id", (t - F.pmod(t, F.lit(86400))).alias("day_start"), (F.lit(86400) - F.pmod(t, F.lit(86400))).alias("left_s"))


@core.query("snap_variant", "SELECT p_partkey, CASE WHEN p_size <= 15 THEN 10 WHEN p_size <= 30 THEN 20 ELSE 40 END AS snapped FROM part")
def snap_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", X.snap(F.col("p_size"), [10, 20, 40]).alias("snapped"))  # ties go down


@core.query("error_class", "SELECT event_id, CASE WHEN event_type = 'error' AND value > 20 THEN 'E_RATE_LIMIT' WHEN event_type = 'error' THEN 'E_FETCH' ELSE 'ok' END AS class FROM events")
def error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("event_type") == "error"
    return read(spark, sf_dir, "events").select("event_id", F.when(bad & (F.col("value") > 20), "E_RATE_LIMIT").when(bad, "E_FETCH").otherwise("ok").alias("class"))


@core.query("tsv_render", r"SELECT item_id, CAST(item_id AS VARCHAR) || chr(9) || regexp_replace(text, '[\t\n\r]', ' ', 'g') || chr(9) || '1' AS line FROM benchmark")
def tsv_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = read(spark, sf_dir, "benchmark").withColumn("ok", F.lit(True))
    return row.select("item_id", X.tsv(row, ["item_id", "text", "ok"]).alias("line"))


@core.query("char_budget", f"WITH {C.CUES}, r AS (SELECT video_id, cue_id, sum(length(text)) OVER (PARTITION BY video_id ORDER BY start_s, cue_id) AS used FROM cues) SELECT video_id, cue_id, CAST(used AS BIGINT) AS used FROM r WHERE used <= 2000")
def char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("video_id").orderBy("start_s", "cue_id").rowsBetween(W.unboundedPreceding, 0)
    return C.cues(spark, sf_dir).select("video_id", "cue_id", F.sum(F.length("text")).over(w).alias("used")).where("used <= 2000")


@core.query("response_cap", f"WITH {C.CUES}, r AS (SELECT video_id, cue_id, row_number() OVER w AS r, sum(length(text)) OVER w AS used FROM cues WINDOW w AS (PARTITION BY video_id ORDER BY start_s, cue_id)) SELECT video_id, cue_id FROM r WHERE r = 1 OR used <= 1000")
def response_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("video_id").orderBy("start_s", "cue_id")
    run = C.cues(spark, sf_dir).select("video_id", "cue_id", F.row_number().over(w).alias("r"), F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("used"))
    return run.where("r = 1 OR used <= 1000").select("video_id", "cue_id")  # the first block always stays


@core.query("needs_remote", f"WITH {C.STAGES} SELECT video_id, bool_or(stage = 'stt' AND state <> 'done') AS needs_remote FROM stages GROUP BY video_id")
def needs_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stages(spark, sf_dir).groupBy("video_id").agg(F.bool_or((F.col("stage") == "stt") & (F.col("state") != "done")).alias("needs_remote"))
