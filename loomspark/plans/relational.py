"""Catalogue, coverage, queue and budget queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.operators.retrieval import first_of
from loomspark.plans import corpus as C
from loomspark.registry import core
from loomspark.sources.tables import read

N = C.NOW


@core.query(
    "resolve_scope",
    f"WITH {C.VIDEOS} SELECT video_id FROM videos WHERE lower(channel) LIKE '%src1%' AND language IN ('en', 'de') AND duration_s >= 100 AND duration_s < 5000 AND lower(title) LIKE '%the%'",
)
def resolve_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = C.videos(spark, sf_dir)
    half_open = (F.col("duration_s") >= 100) & (F.col("duration_s") < 5000)
    return v.where(F.lower("channel").like("%src1%") & F.col("language").isin("en", "de") & half_open & F.lower("title").like("%the%")).select("video_id")


@core.query("request_order", f"WITH {C.VIDEOS}, q AS (SELECT * FROM (VALUES (0, 30), (1, 7), (2, -5), (3, 12)) t(pos, id)) SELECT CAST(pos AS INTEGER) AS pos, CAST(id AS BIGINT) AS id, title FROM q LEFT JOIN videos ON video_id = id")
def request_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(0, 30), (1, 7), (2, -5), (3, 12)], "pos int, id long")
    few = C.videos(spark, sf_dir).where(F.col("video_id").isin(30, 7, -5, 12)).select(F.col("video_id").alias("id"), "title")
    return asked.join(few, "id", "left").select("pos", "id", "title")


@core.query(
    "resolve_speakers",
    f"""WITH {C.CUES}, s AS (SELECT DISTINCT video_id, speaker FROM cues), m AS (SELECT DISTINCT video_id, 'user' AS speaker FROM cues WHERE speaker = 'system')
SELECT video_id, speaker FROM s WHERE speaker = 'user' UNION SELECT video_id, speaker FROM m""",
)
def resolve_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = C.cues(spark, sf_dir).select("video_id", "speaker").where(F.col("speaker").isin("user", "system"))
    return who.select("video_id", F.lit("user").alias("speaker")).distinct()  # system turns are merged into the user's


@core.query("coverage_gap", f"WITH {C.STAGES} SELECT DISTINCT video_id FROM stages s WHERE stage = 'stt' AND state = 'done' AND NOT EXISTS (SELECT 1 FROM stages o WHERE o.video_id = s.video_id AND o.stage = 'ocr' AND o.state = 'done')")
def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.stages(spark, sf_dir)
    done = lambda name: s.where((F.col("stage") == name) & (F.col("state") == "done")).select("video_id")
    return done("stt").distinct().join(done("ocr"), "video_id", "left_anti")


@core.query("embed_backlog", f"WITH {C.STAGES} SELECT stage, count(*) AS n FROM stages s WHERE state = 'pending' AND EXISTS (SELECT 1 FROM stages p WHERE p.video_id = s.video_id AND p.stage = 'stt' AND p.state = 'done') GROUP BY stage")
def embed_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.stages(spark, sf_dir)
    ready = s.where("stage = 'stt' AND state = 'done'").select("video_id")
    return s.where("state = 'pending'").join(ready, "video_id", "left_semi").groupBy("stage").agg(F.count("*").alias("n"))


_PIVOT = f"{C.STAGES}, p AS (SELECT video_id, max(CASE WHEN stage = 'stt' AND state = 'done' THEN 1 ELSE 0 END) AS has_stt, max(CASE WHEN stage = 'ocr' AND state = 'done' THEN 1 ELSE 0 END) AS has_ocr FROM stages GROUP BY video_id)"


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda name: F.max(F.when((F.col("stage") == name) & (F.col("state") == "done"), 1).otherwise(0))
    return C.stages(spark, sf_dir).groupBy("video_id").agg(flag("stt").alias("has_stt"), flag("ocr").alias("has_ocr"))


@core.query("coverage_flags", f"WITH {_PIVOT} SELECT video_id, has_stt, has_ocr FROM p")
def coverage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir)


@core.query("coverage_string", f"WITH {_PIVOT} SELECT video_id, CASE has_stt WHEN 1 THEN 't' ELSE '-' END || CASE has_ocr WHEN 1 THEN 'o' ELSE '-' END AS coverage FROM p")
def coverage_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = lambda c, m: F.when(F.col(c) == 1, m).otherwise("-")
    return _flags(spark, sf_dir).select("video_id", F.concat(mark("has_stt", "t"), mark("has_ocr", "o")).alias("coverage"))


@core.query("tag_and", f"WITH {C.STAGES} SELECT video_id FROM stages WHERE state = 'done' GROUP BY video_id HAVING count(DISTINCT stage) = 2")
def tag_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stages(spark, sf_dir).where("state = 'done'").groupBy("video_id").agg(F.countDistinct("stage").alias("n")).where("n = 2").select("video_id")


@core.query("state_tally", f"WITH {C.STAGES}, k AS (SELECT * FROM (VALUES ('done'), ('failed'), ('pending'), ('running'), ('skipped')) t(state)) SELECT k.state, count(s.video_id) AS n FROM k LEFT JOIN stages s ON s.state = k.state GROUP BY k.state")
def state_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(x,) for x in ("done", "failed", "pending", "running", "skipped")], "state string")
    tally = C.stages(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))
    return known.join(tally, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


@core.query("corpus_rollup", f"WITH {C.VIDEOS} SELECT count(*) AS n, count(DISTINCT channel) AS n_channels, CAST(sum(duration_s) AS BIGINT) AS seconds, round(sum(duration_s) / 3600::DOUBLE, 1) AS hours, min(duration_s) AS shortest, max(duration_s) AS longest, count(*) FILTER (WHERE language = 'en') AS n_en FROM videos")
def corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.videos(spark, sf_dir).agg(
        F.count("*").alias("n"),
        F.countDistinct("channel").alias("n_channels"),
        F.sum("duration_s").alias("seconds"),
        F.round(F.sum("duration_s") / 3600, 1).alias("hours"),
        F.min("duration_s").alias("shortest"),
        F.max("duration_s").alias("longest"),
        F.count_if(F.col("language") == "en").alias("n_en"),
    )


@core.query("corpus_ledger", f"WITH {C.JOBS} SELECT state, count(*) AS n, count(DISTINCT client) AS n_clients, max(created) AS last FROM jobs GROUP BY state")
def corpus_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.jobs(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"), F.countDistinct("client").alias("n_clients"), F.max("created").alias("last"))


@core.query("per_video_counts", f"WITH {C.CUES}, c AS (SELECT video_id, count(*) AS n_cues, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM cues GROUP BY 1), {C.STAGES}, s AS (SELECT video_id, count(*) AS n_stages FROM stages GROUP BY 1) SELECT c.video_id, n_cues, n_chars, coalesce(n_stages, 0) AS n_stages FROM c LEFT JOIN s USING (video_id)")
def per_video_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = C.cues(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n_cues"), F.sum(F.length("text")).alias("n_chars"))
    per = C.stages(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n_stages"))
    return cues.join(per, "video_id", "left").withColumn("n_stages", F.coalesce("n_stages", F.lit(0)))


@core.query("channel_rollup", f"WITH {C.VIDEOS} SELECT channel, count(*) AS n, round(avg(duration_s), 4) AS mean_s FROM videos GROUP BY channel ORDER BY n DESC, channel LIMIT 10")
def channel_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.videos(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"), F.round(F.avg("duration_s"), 4).alias("mean_s")).orderBy(F.desc("n"), "channel").limit(10)


@core.query("tag_rollup", f"WITH {C.STAGES} SELECT stage || ':' || state AS tag, count(*) AS n FROM stages GROUP BY 1 ORDER BY n DESC, tag LIMIT 30")
def tag_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.concat("stage", F.lit(":"), "state").alias("tag")
    return C.stages(spark, sf_dir).groupBy(tag).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(30)


@core.query("related_tags", f"WITH {C.STAGES}, t AS (SELECT video_id, stage || ':' || state AS tag FROM stages), v AS (SELECT video_id FROM t WHERE tag = 'stt:done') SELECT tag, count(*) AS n FROM t WHERE video_id IN (SELECT video_id FROM v) AND tag <> 'stt:done' GROUP BY tag ORDER BY n DESC, tag LIMIT 30")
def related_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = C.stages(spark, sf_dir).select("video_id", F.concat("stage", F.lit(":"), "state").alias("tag"))
    chosen = tags.where("tag = 'stt:done'").select("video_id")
    rest = tags.where("tag <> 'stt:done'").join(chosen, "video_id", "left_semi")
    return rest.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(30)


@core.query("text_totals", f"WITH {C.CUES} SELECT video_id, CAST(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS chars FROM cues GROUP BY video_id")
def text_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return C.cues(spark, sf_dir).groupBy("video_id").agg(F.sum(words).alias("words"), F.sum(F.length("text")).alias("chars"))


@core.query("gaps", f"WITH {C.STAGES}, {C.ITEMS} SELECT (SELECT count(*) FROM stages WHERE state = 'failed') AS n_failed_stages, (SELECT count(*) FROM items WHERE state = 'failed') AS n_failed_items, (SELECT count(*) FROM items WHERE state IN ('queued', 'running')) AS n_active")
def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = C.stages(spark, sf_dir).agg(F.count_if(F.col("state") == "failed").alias("n_failed_stages"))
    work = C.items(spark, sf_dir).agg(F.count_if(F.col("state") == "failed").alias("n_failed_items"), F.count_if(F.col("state").isin("queued", "running")).alias("n_active"))
    return failed.crossJoin(work)  # one row each


@core.query("count_probe", f"WITH {C.FRAMES} SELECT count(*) AS n, count(*) >= 500 AS at_least FROM (SELECT 1 FROM frames WHERE kind = 'view' LIMIT 500)")
def count_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.frames(spark, sf_dir).where("kind = 'view'").limit(500).agg(F.count("*").alias("n"), (F.count("*") >= 500).alias("at_least"))


@core.query("follow_totals", f"WITH {C.JOBS} SELECT count(*) AS n, count(*) FILTER (WHERE state = 'queued') AS waiting, count(*) FILTER (WHERE state = 'queued' AND priority = 1) AS urgent, count(*) FILTER (WHERE created <= {N} - 94608000) AS stale FROM jobs")
def follow_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    queued = F.col("state") == "queued"
    return C.jobs(spark, sf_dir).agg(
        F.count("*").alias("n"),
        F.count_if(queued).alias("waiting"),
        F.count_if(queued & (F.col("priority") == 1)).alias("urgent"),
        F.count_if(F.col("created") <= N - 94608000).alias("stale"),
    )


@core.query("stage_times", "SELECT event_type AS stage, count(*) AS n, round(sum(value), 4) AS seconds, round(median(value), 4) AS middle FROM events GROUP BY 1")
def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("seconds"), F.round(F.percentile("value", F.lit(0.5)), 4).alias("middle")
    )


@core.query("job_contents", f"WITH {C.ITEMS} SELECT job_id, count(*) AS n, arg_min(video_id, (seq, video_id)) AS first_video FROM items GROUP BY job_id")
def job_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.items(spark, sf_dir).groupBy("job_id").agg(F.count("*").alias("n"), F.min_by("video_id", F.struct("seq", "video_id")).alias("first_video"))


@core.query("due_follows", f"WITH {C.JOBS} SELECT job_id, created FROM jobs WHERE state = 'queued' AND created <= {N} ORDER BY created, job_id LIMIT 5")
def due_follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.jobs(spark, sf_dir).where(f"state = 'queued' AND created <= {N}").select("job_id", "created").orderBy("created", "job_id").limit(5)


@core.query("first_wins", "SELECT min(doc_id) AS video_id, sha256(text) AS sha256 FROM documents GROUP BY text")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = C.videos(spark, sf_dir).select("video_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return texts.groupBy("sha256").agg(F.min("video_id").alias("video_id"))


@core.query("append_capped", f"WITH {C.ITEMS}, s AS (SELECT DISTINCT video_id FROM items WHERE state = 'done'), c AS (SELECT DISTINCT video_id FROM items WHERE state = 'queued' AND video_id NOT IN (SELECT video_id FROM s)) SELECT video_id FROM c ORDER BY video_id LIMIT 50")
def append_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued videos that no job has done before, as many as there is room for."""
    items = C.items(spark, sf_dir)
    seen = items.where("state = 'done'").select("video_id").distinct()
    return items.where("state = 'queued'").select("video_id").distinct().join(seen, "video_id", "left_anti").orderBy("video_id").limit(50)


@core.query("tag_delta", f"WITH {C.STAGES}, w AS (SELECT DISTINCT video_id FROM stages WHERE stage = 'stt'), h AS (SELECT DISTINCT video_id FROM stages WHERE stage = 'stt' AND state = 'done') SELECT (SELECT count(*) FROM h) AS present, (SELECT count(*) FROM w WHERE video_id NOT IN (SELECT video_id FROM h)) AS new")
def tag_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = C.stages(spark, sf_dir).where("stage = 'stt'").groupBy("video_id").agg(F.max(F.col("state") == "done").alias("has"))
    return has.agg(F.count_if("has").alias("present"), F.count_if(~F.col("has")).alias("new"))


@core.query("link_landed", f"WITH {C.JOBS} SELECT job_id, c_name AS owner FROM jobs LEFT JOIN customer ON client = c_custkey WHERE state = 'running'")
def link_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client"), F.col("c_name").alias("owner"))
    return C.jobs(spark, sf_dir).where("state = 'running'").join(owner, "client", "left").select("job_id", "owner")


@core.query("lookup_ladder", "WITH l AS (SELECT 1 AS step, n_nationkey AS id FROM nation WHERE n_name = '7' UNION ALL SELECT 2, n_nationkey FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 3, n_nationkey FROM nation WHERE n_name LIKE '%7%') SELECT id, CAST(step AS INTEGER) AS step FROM l ORDER BY step, id LIMIT 1")
def lookup_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    rung = lambda step, cond: n.where(cond).select(F.col("n_nationkey").alias("id"), F.lit(step).alias("step"))
    return rung(1, "n_name = '7'").unionByName(rung(2, "n_nationkey = 7")).unionByName(rung(3, "n_name LIKE '%7%'")).orderBy("step", "id").limit(1)


@core.query("upsert_video", f"WITH {C.VIDEOS}, n AS (SELECT video_id, reverse(title) AS title, CASE WHEN video_id % 2 = 0 THEN NULL ELSE 'xx' END AS language FROM videos WHERE video_id % 10 = 0 UNION ALL SELECT -1, 'new', NULL) SELECT coalesce(n.video_id, v.video_id) AS video_id, coalesce(n.title, v.title) AS title, coalesce(n.language, v.language) AS language FROM videos v FULL OUTER JOIN n ON v.video_id = n.video_id")
def upsert_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = C.videos(spark, sf_dir).select("video_id", "title", "language")
    new = old.where("video_id % 10 = 0").select("video_id", F.reverse("title").alias("t"), F.when(F.col("video_id") % 2 != 0, "xx").alias("l"))
    new = new.unionByName(spark.createDataFrame([(-1, "new", None)], "video_id long, t string, l string"))
    both = old.join(new, "video_id", "full")
    return both.select("video_id", F.coalesce("t", "title").alias("title"), F.coalesce("l", "language").alias("language"))  # a null language keeps the old one


@core.query("index_state", f"WITH {C.STAGES} SELECT video_id, CASE WHEN bool_and(state = 'done') THEN 'ready' WHEN bool_or(state = 'failed') THEN 'failed' ELSE 'pending' END AS index_state FROM stages GROUP BY video_id")
def index_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.bool_and(F.col("state") == "done"), "ready").when(F.bool_or(F.col("state") == "failed"), "failed").otherwise("pending")
    return C.stages(spark, sf_dir).groupBy("video_id").agg(state.alias("index_state"))


@core.query("resume_plan", f"WITH {C.STAGES} SELECT video_id, string_agg(stage, ',' ORDER BY stage) AS stages FROM stages WHERE state IN ('failed', 'pending') GROUP BY video_id")
def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_stages = C.stages(spark, sf_dir).where(F.col("state").isin("failed", "pending"))
    return open_stages.groupBy("video_id").agg(F.array_join(F.sort_array(F.collect_list("stage")), ",").alias("stages"))


@core.query("stale_stages", f"WITH {C.STAGES}, d AS (SELECT doc_id AS video_id, unnest(['stt', 'ocr']) AS stage FROM documents) SELECT d.video_id, d.stage FROM d LEFT JOIN stages s ON s.video_id = d.video_id AND s.stage = d.stage AND s.state = 'done' WHERE s.video_id IS NULL")
def stale_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.explode(F.array(F.lit("stt"), F.lit("ocr"))).alias("stage"))
    return wanted.join(C.stages(spark, sf_dir).where("state = 'done'"), ["video_id", "stage"], "left_anti")


@core.query("wire_stages", f"WITH {C.ITEMS} SELECT video_id, CASE WHEN bool_or(state = 'failed') THEN 'failed' WHEN bool_or(state = 'running') THEN 'running' WHEN bool_and(state = 'done') THEN 'done' ELSE 'pending' END AS wire FROM items GROUP BY video_id")
def wire_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    any_of = lambda x: F.bool_or(F.col("state") == x)
    wire = F.when(any_of("failed"), "failed").when(any_of("running"), "running").when(F.bool_and(F.col("state") == "done"), "done").otherwise("pending")
    return C.items(spark, sf_dir).groupBy("video_id").agg(wire.alias("wire"))


@core.query("unwind_state", f"WITH {C.JOBS} SELECT job_id, CASE WHEN created < {N} - 157680000 THEN 'stale' ELSE 'pending' END AS next FROM jobs WHERE state = 'running'")
def unwind_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.when(F.col("created") < N - 157680000, "stale").otherwise("pending").alias("next")
    return C.jobs(spark, sf_dir).where("state = 'running'").select("job_id", after)


@core.query("first_success", f"WITH {C.ITEMS}, r AS (SELECT job_id, video_id, row_number() OVER (PARTITION BY job_id ORDER BY seq, video_id) AS r FROM items WHERE state = 'done') SELECT job_id, video_id FROM r WHERE r = 1")
def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.items(spark, sf_dir).where("state = 'done'").groupBy("job_id").agg(F.min_by("video_id", F.struct("seq", "video_id")).alias("video_id"))


@core.query("claim_next", f"WITH {C.JOBS} SELECT job_id, priority FROM jobs WHERE state = 'queued' AND created <= {N} ORDER BY priority, job_id LIMIT 1")
def claim_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.jobs(spark, sf_dir).where(f"state = 'queued' AND created <= {N}").select("job_id", "priority").orderBy("priority", "job_id").limit(1)


@core.query("stale_claims", f"WITH {C.ITEMS} SELECT job_id, max(beat) AS beat FROM items WHERE state = 'running' GROUP BY job_id HAVING max(beat) < {N} - 189216000")
def stale_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.items(spark, sf_dir).where("state = 'running'").groupBy("job_id").agg(F.max("beat").alias("beat")).where(F.col("beat") < N - 189216000)


@core.query("reclaim_plan", f"WITH {C.ITEMS} SELECT job_id, seq, video_id, attempts, CASE WHEN attempts >= 40 THEN 'failed' ELSE 'queued' END AS next FROM items WHERE state = 'running' AND beat < {N} - 189216000")
def reclaim_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = C.items(spark, sf_dir).where(f"state = 'running' AND beat < {N} - 189216000")
    return lost.select("job_id", "seq", "video_id", "attempts", F.when(F.col("attempts") >= 40, "failed").otherwise("queued").alias("next"))


@core.query("retry_policy", f"WITH {C.ITEMS} SELECT job_id, seq, video_id, CASE WHEN attempts >= 6 THEN NULL ELSE CAST({N} + 60 * (CAST(2 AS BIGINT) ** attempts) AS BIGINT) END AS not_before FROM items WHERE state = 'failed' AND error_code = 'E_RATE_LIMIT'")
def retry_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = C.items(spark, sf_dir).where("state = 'failed' AND error_code = 'E_RATE_LIMIT'")
    later = (F.lit(N) + 60 * F.pow(F.lit(2), F.col("attempts"))).cast("long")
    return failed.select("job_id", "seq", "video_id", F.when(F.col("attempts") < 6, later).alias("not_before"))


@core.query("settle_jobs", f"WITH {C.ITEMS} SELECT job_id, CASE WHEN bool_and(state = 'done') THEN 'done' ELSE 'failed' END AS state, arg_min(error_code, (CASE error_code WHEN 'E_RATE_LIMIT' THEN 0 ELSE 1 END, seq, error_code)) FILTER (WHERE state = 'failed') AS error_code FROM items GROUP BY job_id HAVING bool_and(state IN ('done', 'failed'))")
def settle_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.struct(F.when(F.col("error_code") == "E_RATE_LIMIT", 0).otherwise(1), "seq", "error_code")
    code = F.min_by("error_code", F.when(F.col("state") == "failed", first))
    over = F.bool_and(F.col("state").isin("done", "failed")).alias("over")
    done = F.when(F.bool_and(F.col("state") == "done"), "done").otherwise("failed").alias("state")
    return C.items(spark, sf_dir).groupBy("job_id").agg(over, done, code.alias("error_code")).where("over").drop("over")


@core.query("event_tail", "SELECT event_id, event_type FROM events WHERE user_id = 7 ORDER BY event_id DESC LIMIT 20")
def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where("user_id = 7").select("event_id", "event_type").orderBy(F.desc("event_id")).limit(20)


@core.query("queue_state", f"WITH {C.JOBS} SELECT count(*) FILTER (WHERE state = 'running') AS running, count(*) FILTER (WHERE state = 'queued' AND created <= 946684800) AS ready, count(*) FILTER (WHERE state = 'queued' AND created > 946684800) AS deferred, min(created) FILTER (WHERE state = 'queued' AND created > 946684800) AS next_at FROM jobs")
def queue_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    queued, later = F.col("state") == "queued", F.col("created") > 946684800
    return C.jobs(spark, sf_dir).agg(
        F.count_if(F.col("state") == "running").alias("running"),
        F.count_if(queued & ~later).alias("ready"),
        F.count_if(queued & later).alias("deferred"),
        F.min(F.when(queued & later, F.col("created"))).alias("next_at"),
    )


@core.query("data_status", f"WITH {C.STAGES}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE state = 'failed') AS f, count(*) FILTER (WHERE state = 'pending') AS p FROM stages) SELECT CASE WHEN n = 0 THEN 'empty' WHEN p > n / 2 THEN 'indexing' WHEN f > 0 THEN 'degraded' WHEN p > 0 THEN 'partial' ELSE 'ok' END AS status FROM c")
def data_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.stages(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("state") == "failed").alias("f"), F.count_if(F.col("state") == "pending").alias("p"))
    status = F.when(F.col("n") == 0, "empty").when(F.col("p") > F.col("n") / 2, "indexing").when(F.col("f") > 0, "degraded").when(F.col("p") > 0, "partial")
    return c.select(status.otherwise("ok").alias("status"))


@core.query("job_health", f"WITH {C.ITEMS} SELECT state, error_code, count(*) AS n, count(*) FILTER (WHERE beat > 946684800) AS late FROM items GROUP BY ALL")
def job_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.items(spark, sf_dir).groupBy("state", "error_code").agg(F.count("*").alias("n"), F.count_if(F.col("beat") > 946684800).alias("late"))


@core.query("job_history", f"WITH {C.ITEMS} SELECT video_id, count(DISTINCT job_id) AS n_jobs, string_agg(DISTINCT state, ',' ORDER BY state) AS states FROM items GROUP BY video_id")
def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.items(spark, sf_dir).groupBy("video_id").agg(F.countDistinct("job_id").alias("n_jobs"), F.array_join(F.sort_array(F.collect_set("state")), ",").alias("states"))


@core.query("job_progress", f"WITH {C.ITEMS} SELECT job_id, round(least(sum(CASE WHEN state IN ('done', 'failed') THEN 1 WHEN state = 'running' THEN least(attempts / 50::DOUBLE, 1) ELSE 0 END) / count(*)::DOUBLE, 1), 3) AS progress FROM items GROUP BY job_id")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("state").isin("done", "failed"), 1.0).when(F.col("state") == "running", F.least(F.col("attempts") / 50, F.lit(1.0))).otherwise(0.0)
    return C.items(spark, sf_dir).groupBy("job_id").agg(F.round(F.least(F.sum(part) / F.count("*"), F.lit(1.0)), 3).alias("progress"))


@core.query("degraded_items", f"WITH {C.ITEMS}, {C.STAGES} SELECT i.job_id, i.video_id, s.stage FROM items i JOIN stages s ON s.video_id = i.video_id WHERE i.state = 'done' AND s.state = 'failed'")
def degraded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = C.stages(spark, sf_dir).where("state = 'failed'").select("video_id", "stage")
    return C.items(spark, sf_dir).where("state = 'done'").select("job_id", "video_id").join(failed, "video_id").select("job_id", "video_id", "stage")


@core.query("retry_batches", f"WITH {C.ITEMS}, f AS (SELECT job_id, video_id, row_number() OVER (PARTITION BY job_id ORDER BY video_id, seq) - 1 AS r FROM items WHERE state = 'failed') SELECT job_id, CAST(r // 2 AS BIGINT) AS batch, count(*) AS n, min(video_id) AS first_video FROM f GROUP BY ALL")
def retry_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("job_id").orderBy("video_id", "seq")) - 1
    failed = C.items(spark, sf_dir).where("state = 'failed'").withColumn("batch", F.floor(rank / 2))
    return failed.groupBy("job_id", "batch").agg(F.count("*").alias("n"), F.min("video_id").alias("first_video"))


@core.query("prune_events", f"SELECT count(*) AS kept, min(event_id) AS first FROM events WHERE epoch(ts) >= {N} - 1296000")
def prune_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where(C.epoch(F.col("ts")) >= N - 1296000).agg(F.count("*").alias("kept"), F.min("event_id").alias("first"))


@core.query("lru_survivors", f"WITH {C.ITEMS}, s AS (SELECT job_id, seq, video_id, round(sum(bytes) OVER (PARTITION BY job_id ORDER BY beat DESC, seq, video_id), 2) AS used, row_number() OVER (PARTITION BY job_id ORDER BY beat DESC, seq, video_id) AS r FROM items) SELECT job_id, seq, video_id FROM s WHERE used <= 100000 OR r = 1")
def lru_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("job_id").orderBy(F.desc("beat"), "seq", "video_id")
    used = F.round(F.sum("bytes").over(w.rangeBetween(W.unboundedPreceding, W.currentRow)), 2)
    rows = C.items(spark, sf_dir).withColumn("used", used).withColumn("r", F.row_number().over(w))
    return rows.where("used <= 100000 OR r = 1").select("job_id", "seq", "video_id")  # the newest stays whatever its size


@core.query("rule_verdicts", "SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%red%' THEN 'skipped_title' WHEN NOT (lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%bolt%') THEN 'skipped_title' WHEN p_size < 10 OR p_size > 40 THEN 'skipped_duration' ELSE 'accepted' END AS verdict FROM part")
def rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, size = F.lower("p_name"), F.col("p_size")
    wanted = name.contains("ring") | name.contains("bolt")
    verdict = F.when(name.contains("red") | ~wanted, "skipped_title").when((size < 10) | (size > 40), "skipped_duration").otherwise("accepted")
    return read(spark, sf_dir, "part").select("p_partkey", verdict.alias("verdict"))


@core.query("horizon", f"WITH {C.JOBS}, r AS (SELECT job_id, client, created, row_number() OVER (PARTITION BY client ORDER BY created DESC, job_id) - 1 AS r FROM jobs) SELECT job_id FROM r WHERE created >= 978307200 OR r < 2")
def horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("client").orderBy(F.desc("created"), "job_id")) - 1
    return C.jobs(spark, sf_dir).withColumn("r", rank).where("created >= 978307200 OR r < 2").select("job_id")


@core.query("near_miss", "SELECT p_brand, count(*) FILTER (WHERE p_size BETWEEN 8 AND 9) AS near_min, count(*) FILTER (WHERE p_size BETWEEN 41 AND 42) AS near_max FROM part GROUP BY p_brand")
def near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(size.between(8, 9)).alias("near_min"), F.count_if(size.between(41, 42)).alias("near_max"))


@core.query(
    "greedy_budget",
    f"""WITH RECURSIVE {C.JOBS}, o AS (SELECT client, job_id, cost, row_number() OVER (PARTITION BY client ORDER BY created, job_id) AS r FROM jobs),
g AS (SELECT client, job_id, r, cost <= 500000 AS ok, CASE WHEN cost <= 500000 THEN cost ELSE 0 END AS spent FROM o WHERE r = 1
 UNION ALL SELECT o.client, o.job_id, o.r, g.spent + o.cost <= 500000, CASE WHEN g.spent + o.cost <= 500000 THEN g.spent + o.cost ELSE g.spent END FROM g JOIN o ON o.client = g.client AND o.r = g.r + 1)
SELECT client, count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE NOT ok) AS held, round(max(spent), 2) AS spent FROM g GROUP BY client""",
)
def greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oldest first; what doesn't fit is held and later, smaller jobs may still fit: no prefix sum says this."""
    queue = F.sort_array(F.collect_list(F.struct("created", "job_id", "cost")))
    zero = F.struct(F.lit(0.0).alias("spent"), F.lit(0).cast("long").alias("n"))
    fits = lambda a, x: a["spent"] + x["cost"] <= 500000
    step = lambda a, x: F.when(fits(a, x), F.struct((a["spent"] + x["cost"]).alias("spent"), (a["n"] + 1).alias("n"))).otherwise(a)
    done = C.jobs(spark, sf_dir).groupBy("client").agg(queue.alias("q")).select("client", F.size("q").alias("all"), F.aggregate("q", zero, step).alias("a"))
    return done.select("client", F.col("a.n").alias("accepted"), (F.col("all") - F.col("a.n")).alias("held"), F.round("a.spent", 2).alias("spent"))


@core.query("playlist_expand", f"WITH {C.ITEMS}, e AS (SELECT video_id, job_id, seq, row_number() OVER (PARTITION BY video_id ORDER BY job_id, seq) AS r FROM items) SELECT video_id, job_id, seq FROM e WHERE r = 1 ORDER BY job_id, seq, video_id LIMIT 100")
def playlist_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = C.items(spark, sf_dir).select("video_id", "job_id", "seq")
    return first_of(listed, ["video_id"], ["job_id", "seq"]).orderBy("job_id", "seq", "video_id").limit(100)
