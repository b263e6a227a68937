"""Pages, state tables and small reads: what a caller asks of the corpus and of its queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.operators import pages as P
from loomspark.plans import corpus as C
from loomspark.registry import core
from loomspark.sources.tables import read


@core.query(
    "capped_page",
    f"""WITH {C.FRAMES}, pool AS (SELECT * FROM frames ORDER BY sharpness DESC NULLS LAST, frame_id LIMIT 400),
c AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY sharpness DESC NULLS LAST, frame_id) AS n FROM pool),
r AS (SELECT *, row_number() OVER (ORDER BY sharpness DESC NULLS LAST, frame_id) AS place FROM c WHERE n <= 2)
SELECT frame_id, video_id, CAST(place AS INTEGER) AS place, (SELECT count(*) FROM r) > 30 AS has_more, c_name AS owner
FROM r LEFT JOIN customer ON c_custkey = video_id WHERE place > 10 AND place <= 30""",
)
def capped_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc_nulls_last("sharpness"), F.asc("frame_id")]
    page = P.page(P.capped(C.frames(spark, sf_dir).orderBy(*order).limit(400), "video_id", 2, order), order, offset=10, limit=20)
    owner = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id"), F.col("c_name").alias("owner"))
    return page.join(owner, "video_id", "left").select("frame_id", "video_id", "place", "has_more", "owner")


@core.query(
    "list_videos",
    f"""WITH {C.VIDEOS}, {C.STAGES}, f AS (SELECT video_id, bool_or(stage = 'stt' AND state = 'done') AS transcript, bool_or(stage = 'ocr' AND state = 'done') AS ocr
  FROM stages GROUP BY video_id), r AS (SELECT v.video_id, channel, duration_s, row_number() OVER (ORDER BY duration_s DESC NULLS LAST, v.video_id) AS place
  FROM videos v JOIN f USING (video_id) WHERE transcript AND ocr)
SELECT video_id, channel, duration_s, CAST(place AS INTEGER) AS place, (SELECT count(*) FROM r) > 50 AS has_more FROM r WHERE place <= 50""",
)
def list_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lambda stage: F.bool_or((F.col("stage") == stage) & (F.col("state") == "done")).alias(stage)
    has = C.stages(spark, sf_dir).groupBy("video_id").agg(done("stt"), done("ocr")).where("stt AND ocr").select("video_id")
    order = [F.desc_nulls_last("duration_s"), F.asc("video_id")]
    rows = C.videos(spark, sf_dir).select("video_id", "channel", "duration_s").join(has, "video_id")
    return P.page(rows.orderBy(*order).limit(51), order, offset=0, limit=50)


@core.query(
    "page_arithmetic",
    "SELECT source AS channel, count(*) AS total, CAST((count(*) - 1) // 20 * 20 AS BIGINT) AS last_offset, count(*) <= 40 AS past_end FROM documents GROUP BY source",
)
def page_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("channel")).agg(F.count("*").alias("total"))
    return totals.select("channel", "total", P.last_offset(F.col("total"), 20).alias("last_offset"), (F.col("total") <= 40).alias("past_end"))


@core.query(
    "tri_state_filter",
    f"WITH {C.CUES} SELECT 'any' AS mode, count(*) AS n FROM cues UNION ALL SELECT 'none', 0 UNION ALL SELECT 'some', count(*) FROM cues WHERE speaker IN ('user', 'system')",
)
def tri_state_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = C.cues(spark, sf_dir)
    modes = {"any": None, "none": [], "some": ["user", "system"]}
    kept = lambda v: F.count_if(F.coalesce(P.listed(F.col("speaker"), v), F.lit(False)))
    counts = cues.agg(*[kept(v).alias(m) for m, v in modes.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("n")) for m in modes])).alias("x")).select("x.*")


@core.query(
    "stage_order",
    f"WITH {C.STAGES} SELECT video_id, string_agg(stage || '=' || state, ' > ' ORDER BY CASE stage WHEN 'stt' THEN 1 WHEN 'ocr' THEN 2 ELSE 3 END, state) AS line FROM stages GROUP BY video_id",
)
def stage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.array_position(F.array(F.lit("stt"), F.lit("ocr")), F.col("stage"))
    item = F.struct(F.when(place > 0, place).otherwise(3), "state", F.concat("stage", F.lit("="), "state").alias("s"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), " > ")
    return C.stages(spark, sf_dir).groupBy("video_id").agg(line.alias("line"))


@core.query(
    "frame_ids",
    "SELECT event_id, user_id || '-' || lpad(CAST(event_id % 100000 AS VARCHAR), 5, '0') AS frame, CAST(user_id AS VARCHAR) AS video, CAST(event_id % 100000 AS INTEGER) AS ord FROM events",
)
def frame_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = F.format_string("%d-%05d", F.col("user_id"), F.col("event_id") % 100_000)
    pattern = r"^(.+)-(\d{5})$"
    parsed = lambda k: F.regexp_extract("frame", pattern, k)
    return read(spark, sf_dir, "events").select("event_id", frame.alias("frame")).select("event_id", "frame", parsed(1).alias("video"), parsed(2).cast("int").alias("ord"))


@core.query(
    "clip_end",
    r"""WITH t AS (SELECT item_id, regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^ | $', '', 'g') AS t FROM benchmark)
SELECT item_id, CASE WHEN length(t) <= 40 THEN t ELSE rtrim(left(t, 39)) || '…' END AS label FROM t""",
)
def clip_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", P.clip(F.col("text"), 40).alias("label"))


@core.query(
    "csv_split",
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN [p_type, p_name] ELSE [p_name] END AS parts FROM part",
)
def csv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_type", F.lit(" , ,"), "p_name", F.lit(","))).otherwise(F.concat(F.lit(",, "), "p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", P.csv(said, 20).alias("parts"))


@core.query(
    "slug_unique",
    """WITH s AS (SELECT s_suppkey, coalesce(nullif(left(trim(regexp_replace(lower(trim(left(s_name, 16))), '[^a-z0-9]+', '-', 'g'), '-'), 48), ''), 'follow') AS base FROM supplier),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY s_suppkey) AS n FROM s)
SELECT s_suppkey, CASE WHEN n = 1 THEN base ELSE left(base, 44) || '-' || n END AS slug FROM n""",
)
def slug_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names' first 16 characters collide, which is what the numbering is for."""
    return P.unique_slugs(read(spark, sf_dir, "supplier"), "s_suppkey", F.substring("s_name", 1, 16), "follow")


@core.query(
    "iso_forms",
    "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H:%M') AS minute, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS z FROM events",
)
def iso_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.date_format(t, "yyyy-MM-dd").alias("day"),
        F.date_format(t, "yyyy-MM-dd HH:mm").alias("minute"),
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("z"),
    )


@core.query(
    "polygon_box",
    """WITH p AS (SELECT vec_id, [embedding[1], embedding[3], embedding[5], embedding[7]] AS x, [embedding[2], embedding[4], embedding[6], embedding[8]] AS y FROM embeddings)
SELECT vec_id, CAST(greatest(0, least(1, list_min(x))) AS DOUBLE) AS x0, CAST(greatest(0, least(1, list_min(y))) AS DOUBLE) AS y0,
  CAST(greatest(0, least(1, list_max(x))) AS DOUBLE) AS x1, CAST(greatest(0, least(1, list_max(y))) AS DOUBLE) AS y1 FROM p""",
)
def polygon_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.slice(F.col("embedding").cast("array<double>"), 1, 8)
    box = read(spark, sf_dir, "embeddings").select("vec_id", P.box(points).alias("b"))
    return box.select("vec_id", "b.x0", "b.y0", "b.x1", "b.y1")


@core.query(
    "screen_tokens",
    r"""WITH t AS (SELECT page_id, list_filter(string_split_regex(lower(url), '[^\p{L}\p{N}_\-./]+'), lambda x: x <> '') AS t FROM pages)
SELECT page_id, CAST(len(t) AS INTEGER) AS n_tokens, t[1] AS first, t[-1] AS last FROM t WHERE len(t) > 0""",
)
def screen_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = read(spark, sf_dir, "pages").select("page_id", P.screen_tokens(F.col("url")).alias("t")).where(F.size("t") > 0)
    return tokens.select("page_id", F.size("t").alias("n_tokens"), F.get("t", F.lit(0)).alias("first"), F.element_at("t", -1).alias("last"))


@core.query(
    "field_prefix",
    """WITH f AS (SELECT p_partkey AS id, 'name' AS field, unnest(string_split_regex(lower(p_name), '[^a-z0-9]+')) AS term FROM part
UNION ALL SELECT p_partkey, 'brand', unnest(string_split_regex(lower(p_brand), '[^a-z0-9]+')) FROM part
UNION ALL SELECT p_partkey, 'type', unnest(string_split_regex(lower(p_type), '[^a-z0-9]+')) FROM part)
SELECT field, term, count(DISTINCT id) AS n FROM f WHERE starts_with(term, 'br') OR starts_with(term, 'st') GROUP BY field, term""",
)
def field_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"name": "p_name", "brand": "p_brand", "type": "p_type"}
    terms = P.field_postings(read(spark, sf_dir, "part"), "p_partkey", fields)
    return terms.where(F.col("term").startswith("br") | F.col("term").startswith("st")).groupBy("field", "term").agg(F.count("*").alias("n"))


@core.query(
    "replace_children",
    f"""WITH {C.CUES}, n AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_s, cue_id) - 1 AS seq, start_s FROM cues WHERE video_id % 10 = 0 AND text <> '')
SELECT video_id, seq, start_s FROM cues WHERE video_id NOT IN (SELECT video_id FROM n) UNION ALL SELECT video_id, CAST(seq AS BIGINT), start_s FROM n""",
)
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth video comes again, without its empty cues."""
    cues = C.cues(spark, sf_dir).select("video_id", "cue_id", "seq", "start_s", "text")
    new = cues.where("video_id % 10 = 0 AND text <> ''")
    return P.replaced(cues, new, "video_id", "seq", ["start_s", "cue_id"]).select("video_id", "seq", "start_s")


@core.query(
    "ledger_latest",
    "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(event_id) AS last_id FROM events GROUP BY user_id, event_type",
)
def ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = F.max_by("value", F.struct("ts", "event_id")).alias("value")
    return read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(latest, F.max("event_id").alias("last_id"))


@core.query(
    "budget_floor",
    """WITH d AS (SELECT user_id, event_id, CAST(floor(coalesce(value, 0)) AS BIGINT) - 60 AS delta FROM events),
s AS (SELECT *, sum(delta) OVER w AS run FROM d WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, CAST(arg_max(run, event_id) - least(0, min(run)) AS BIGINT) AS balance FROM s GROUP BY user_id""",
)
def budget_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges and refunds in turn, floored at 0 after each: the last running sum less the lowest one below 0."""
    delta = F.floor(F.coalesce("value", F.lit(0.0))).cast("long") - 60
    run = F.sum("delta").over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0))
    runs = read(spark, sf_dir, "events").select("user_id", "event_id", delta.alias("delta")).withColumn("run", run)
    return runs.groupBy("user_id").agg((F.max_by("run", "event_id") - F.least(F.lit(0), F.min("run"))).alias("balance"))


@core.query(
    "bridge_insert",
    f"WITH {C.JOBS} SELECT DISTINCT client, priority FROM jobs WHERE state = 'queued' EXCEPT SELECT client, priority FROM jobs WHERE state = 'done'",
)
def bridge_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = C.jobs(spark, sf_dir)
    pairs = lambda state: jobs.where(F.col("state") == state).select("client", "priority").distinct()
    return pairs("queued").join(pairs("done"), ["client", "priority"], "left_anti")


@core.query(
    "cascade_delete",
    f"WITH {C.JOBS}, {C.ITEMS} SELECT state, count(*) AS n FROM items WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE state = 'done') GROUP BY state",
)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = C.jobs(spark, sf_dir).where("state = 'done'").select("job_id")
    return C.items(spark, sf_dir).join(gone, "job_id", "left_anti").groupBy("state").agg(F.count("*").alias("n"))


@core.query(
    "admit_unique",
    f"WITH {C.JOBS} SELECT client, min(job_id) AS job_id FROM jobs WHERE state = 'queued' AND client NOT IN (SELECT client FROM jobs WHERE state = 'running') GROUP BY client",
)
def admit_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass: a client with a job in flight gets no other, else its first queued one."""
    first = F.min(F.when(F.col("state") == "queued", F.col("job_id")))
    per = C.jobs(spark, sf_dir).groupBy("client").agg(first.alias("job_id"), F.bool_or(F.col("state") == "running").alias("busy"))
    return per.where("NOT busy AND job_id IS NOT NULL").select("client", "job_id")


@core.query(
    "cancel_plan",
    f"WITH {C.ITEMS} SELECT job_id, seq, CASE state WHEN 'queued' THEN 'cancelled' WHEN 'running' THEN 'cancelling' ELSE state END AS state FROM items",
)
def cancel_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.col("state")
    after = F.when(state == "queued", "cancelled").when(state == "running", "cancelling").otherwise(state)
    return C.items(spark, sf_dir).select("job_id", "seq", after.alias("state"))


@core.query(
    "latest_job",
    f"WITH {C.JOBS} SELECT client, arg_max(job_id, (created, job_id)) AS job_id, max(created) AS created, {C.NOW} - max(created) AS quiet_s FROM jobs GROUP BY client",
)
def latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = F.max(F.struct("created", "job_id")).alias("x")
    rows = C.jobs(spark, sf_dir).groupBy("client").agg(latest)
    return rows.select("client", "x.job_id", "x.created", (F.lit(C.NOW) - F.col("x.created")).alias("quiet_s"))


@core.query(
    "first_failure",
    f"WITH {C.ITEMS} SELECT job_id, min(seq) AS seq, arg_min(error_code, (seq, video_id, error_code)) AS error_code, count(*) AS n FROM items WHERE state = 'failed' GROUP BY job_id",
)
def first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.struct("seq", "video_id", "error_code")).alias("x")
    rows = C.items(spark, sf_dir).where("state = 'failed'").groupBy("job_id").agg(first, F.count("*").alias("n"))
    return rows.select("job_id", "x.seq", "x.error_code", "n")


@core.query(
    "open_stages",
    f"WITH {C.STAGES} SELECT video_id, string_agg(stage, ',' ORDER BY stage) AS stages FROM stages WHERE state IN ('failed', 'pending') GROUP BY video_id",
)
def open_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.stages(spark, sf_dir).where(F.col("state").isin("failed", "pending"))
    return rows.groupBy("video_id").agg(F.array_join(F.array_sort(F.collect_list("stage")), ",").alias("stages"))


@core.query(
    "job_filter",
    f"WITH {C.JOBS}, {C.ITEMS} SELECT job_id, client FROM jobs j WHERE state IN ('queued', 'running') AND EXISTS (SELECT 1 FROM items i WHERE i.job_id = j.job_id AND i.state = 'failed' AND error_code = 'E_FETCH')",
)
def job_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    degraded = C.items(spark, sf_dir).where("state = 'failed' AND error_code = 'E_FETCH'").select("job_id")
    return C.jobs(spark, sf_dir).where(F.col("state").isin("queued", "running")).join(degraded, "job_id", "left_semi").select("job_id", "client")


@core.query("max_ordinal", f"WITH {C.FRAMES} SELECT video_id, max(shot_id) AS ord, count(*) AS n FROM frames GROUP BY video_id")
def max_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.frames(spark, sf_dir).groupBy("video_id").agg(F.max("shot_id").alias("ord"), F.count("*").alias("n"))


@core.query(
    "response_alignment",
    """SELECT l_orderkey AS job_id, count(*) AS n, count(*) = max(l_linenumber) AND count(DISTINCT l_linenumber) = count(*) AND min(l_linenumber) = 1 AS aligned
FROM lineitem GROUP BY l_orderkey""",
)
def response_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per asked place, none twice, none out of range; the places are counted per (job, place) first."""
    places = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), "l_linenumber").agg(F.count("*").alias("n"))
    whole = (F.sum("n") == F.max("l_linenumber")) & (F.max("n") == 1) & (F.min("l_linenumber") == 1)
    return places.groupBy("job_id").agg(F.sum("n").alias("n"), whole.alias("aligned"))


@core.query(
    "latency_median",
    "SELECT event_type, quantile_cont(CAST(floor(value * 100) AS BIGINT), 0.5) AS median FROM events WHERE value IS NOT NULL GROUP BY event_type",
)
def latency_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, on hundredths: the aggregate keeps counts of distinct values, not rows."""
    hundredths = F.floor(F.col("value") * 100)
    return read(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("event_type").agg(F.percentile(hundredths, F.lit(0.5)).alias("median"))


def _half(x: Column) -> Column:
    return F.when(x > 0, x)


@core.query(
    "probe_merge",
    "SELECT doc_id AS video_id, coalesce(nullif(greatest(n_chars - 500, 0), 0), nullif(length(text), 0)) AS duration_s FROM documents",
)
def probe_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = F.coalesce(_half(F.col("n_chars") - 500), _half(F.length("text")))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), measured.cast("long").alias("duration_s"))


@core.query(
    "hits_summary",
    f"WITH {C.CUES} SELECT speaker, count(*) AS hits, count(DISTINCT video_id) AS videos FROM cues WHERE contains(lower(text), 'tion') GROUP BY speaker",
)
def hits_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = C.cues(spark, sf_dir).where(F.lower("text").contains("tion"))
    per = hits.groupBy("speaker", "video_id").agg(F.count("*").alias("n"))
    return per.groupBy("speaker").agg(F.sum("n").alias("hits"), F.count("*").alias("videos"))


_RESOURCE = r"""s AS (SELECT video_id, bool_or(stage = 'stt' AND state = 'done') AS t, bool_or(stage = 'ocr' AND state = 'done') AS o FROM stages GROUP BY video_id),
r AS (SELECT v.video_id, regexp_replace(title, '[\t\n\r]', ' ', 'g') AS title, channel, strftime(make_timestamp(({now} - v.video_id * 7919 % 1000 * 86400) * 1000000), '%Y-%m-%d') AS published, duration_s,
  CASE WHEN t THEN 't' ELSE '-' END || CASE WHEN o THEN 'o' ELSE '-' END AS coverage, {tag} AS tags,
  row_number() OVER (ORDER BY {now} - v.video_id * 7919 % 1000 * 86400 DESC, v.video_id) AS place FROM videos v LEFT JOIN s USING (video_id))
SELECT 0 AS place, 'video_id' || chr(9) || 'title' || chr(9) || 'channel' || chr(9) || 'published' || chr(9) || 'duration_s' || chr(9) || 'coverage'{head} AS line
UNION ALL SELECT CAST(place AS INTEGER), concat_ws(chr(9), video_id, coalesce(title, ''), coalesce(channel, ''), published, coalesce(duration_s::VARCHAR, ''), coverage{cell}) FROM r WHERE place <= 200"""


def _resource(spark: SparkSession, sf_dir: str, tag: Column) -> DataFrame:
    done = lambda stage, letter: F.when(F.bool_or((F.col("stage") == stage) & (F.col("state") == "done")), letter).otherwise("-")
    covered = C.stages(spark, sf_dir).groupBy("video_id").agg(F.concat(done("stt", "t"), done("ocr", "o")).alias("coverage"))
    at = F.lit(C.NOW) - F.col("video_id") * 7919 % 1000 * 86400
    rows = C.videos(spark, sf_dir).drop("text").join(covered, "video_id", "left").withColumns(
        {"at": at, "published": F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd"), "coverage": F.coalesce("coverage", F.lit("--")), "tags": tag}
    )
    columns = ["video_id", "title", "channel", "published", "duration_s", "coverage"]
    return P.resource_lines(rows, columns, "tags", [F.desc("at"), F.asc("video_id")], 200)


@core.query("corpus_resource", f"WITH {C.VIDEOS}, {C.STAGES}, " + _RESOURCE.format(now=C.NOW, tag="''", head="", cell=""))
def corpus_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 newest videos as a resource; without tags there is no column for them."""
    return _resource(spark, sf_dir, F.lit(None).cast("string"))


@core.query(
    "corpus_resource_tagged",
    f"WITH {C.VIDEOS}, {C.STAGES}, " + _RESOURCE.format(now=C.NOW, tag="CASE WHEN v.video_id % 9 = 0 THEN 'series:' || channel ELSE '' END", head=" || chr(9) || 'tags'", cell=", tags"),
)
def corpus_resource_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resource(spark, sf_dir, F.when(F.col("video_id") % 9 == 0, F.concat(F.lit("series:"), "channel")))
