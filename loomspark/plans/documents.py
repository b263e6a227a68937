"""Queries of what readers get: citations, highlights, subtitle choice, event lines; and correlated reads."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import answers as A
from loomspark.operators import captions as K
from loomspark.plans import corpus as C
from loomspark.plans.captions import infos
from loomspark.registry import core
from loomspark.sources.recorded import probe, record
from loomspark.sources.tables import read
from loomspark.store import derived, shared_dir
from loomspark.streaming.lines import write_lines


@core.query(
    "citation_rewrite",
    r"""WITH d AS (SELECT doc_id, regexp_replace(trim(left(regexp_replace(text, '[\[\]\s]+', ' ', 'g'), 40)), ' +', ' ', 'g') AS t FROM documents)
SELECT doc_id, trim(t || ' [1] and ' || t || ' shown [3], then ' || t || ' end' || CASE WHEN doc_id % 2 = 0 THEN ' [2]' ELSE '' END) AS answer,
 CASE WHEN doc_id % 2 = 0 THEN '1,2,3' ELSE '1,3' END AS used FROM d WHERE t <> ''""",
)
def citation_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers over the documents' beginnings with markers that name something and markers that don't."""
    t = F.regexp_replace(F.trim(F.left(F.regexp_replace("text", r"[\[\]\s]+", " "), F.lit(40))), " +", " ")
    d = read(spark, sf_dir, "documents").select("doc_id", t.alias("t")).where("t <> ''")
    said = F.concat("t", F.lit(" [1 transcript] and [8][9] "), "t", F.lit(" shown [3, ocr+frame], then [77] "), "t", F.lit(" end [2]"))
    known = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(3)))
    made = d.select("doc_id", A.cite(said, known).alias("a"))
    return made.select("doc_id", "a.answer", F.array_join("a.used", ",").alias("used"))


_QUERY = "the and THING of it's x"
_PATTERN = "(?i)(thing|it''s|and|the|of)"


@core.query(
    "highlight_parts",
    rf"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '{_PATTERN}') AS h, string_split_regex(text, '{_PATTERN.replace("(thing", "(?:thing")}') AS p FROM documents WHERE coalesce(text, '') <> ''),
q AS (SELECT doc_id, least(len(h), 40) AS n, list_transform(range(1, least(len(h), 40) + 1), lambda i: p[i]) AS before, h[1:40] AS hits,
  array_to_string(list_transform(range(41, len(h) + 1), lambda i: p[i] || h[i]), '') || CASE WHEN len(p) > len(h) THEN p[len(h) + 1] ELSE '' END AS rest FROM d)
SELECT doc_id, CAST(n AS INTEGER) AS n_hits, CAST(n + len(list_filter(before, lambda x: x <> '')) + (rest <> '')::INTEGER AS INTEGER) AS n_parts,
 md5(array_to_string(list_transform(range(1, n + 1), lambda i: before[i] || '[' || hits[i] || ']'), '') || rest) AS marked FROM q""",
)
def highlight_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in runs, the words of a query apart."""
    parts = read(spark, sf_dir, "documents").select("doc_id", A.highlight(F.col("text"), _QUERY).alias("p")).where(F.size("p") > 0)
    shown = F.transform("p", lambda x: F.when(x["hit"], F.concat(F.lit("["), x["text"], F.lit("]"))).otherwise(x["text"]))
    n = F.size(F.filter("p", lambda x: x["hit"]))
    return parts.select("doc_id", n.alias("n_hits"), F.size("p").alias("n_parts"), F.md5(F.array_join(shown, "")).alias("marked"))


@core.query(
    "subtitle_choice",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'en' ELSE lang END AS lang, CASE WHEN doc_id % 4 = 1 THEN 'srv3' ELSE 'vtt' END AS ext, doc_id % 4 = 1 AS automatic
FROM documents WHERE doc_id % 4 = 1 OR (doc_id % 4 <> 3 AND lang IN ('en', 'de'))""",
)
def subtitle_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The track of a wanted language; videos without one have none."""
    return K.choose_subtitle(infos(spark, sf_dir), "doc_id", "info", ["en", "de"])


_EVENT = "CAST(to_json({'event': 'seen', 'id': event_id, 'kind': event_type, 'user': user_id}) AS VARCHAR)"


@core.query("ndjson_stream", f"SELECT {_EVENT} AS line FROM events")
def ndjson_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as lines of JSON, by a stream that ends when it has caught up; started twice, it writes nothing twice."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    schema = read(spark, sf_dir, "events").schema
    event = F.struct(F.lit("seen").alias("event"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("user"))
    for _ in range(2):  # a pattern that fits one name: a stream reads a folder or a pattern, and a table may be a single file
        write_lines(spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet"), event, f"{path}/out", f"{path}/state")
    return spark.read.text(f"{path}/out").withColumnRenamed("value", "line")


@core.query(
    "sse_frames",
    f"SELECT event_id, 'event: ' || event_type || chr(10) || 'data: ' || {_EVENT} || chr(10) || chr(10) AS frame FROM events",
)
def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.struct(F.lit("seen").alias("event"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("user"))
    return read(spark, sf_dir, "events").select("event_id", A.sse_frame(F.concat("event_type", F.lit("\n")), event).alias("frame"))


@core.query(
    "exists_failed",
    f"WITH {C.STAGES} SELECT doc_id AS video_id, n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM stages s WHERE s.video_id = d.doc_id AND s.state = 'failed')",
)
def exists_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos of which some stage failed: a correlated EXISTS, which becomes a semi join."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), "n_chars")
    failed = C.stages(spark, sf_dir).where((F.col("video_id") == F.col("d.video_id").outer()) & (F.col("state") == "failed"))
    return docs.alias("d").where(failed.exists()).select("video_id", "n_chars")


@core.query(
    "scalar_last_failure",
    f"""WITH {C.JOBS}, {C.ITEMS} SELECT job_id, client, (SELECT max(beat) FROM items i WHERE i.job_id = j.job_id AND i.state = 'failed') AS last_failure,
 coalesce((SELECT count(*) FROM items i WHERE i.job_id = j.job_id), 0) AS n_items FROM jobs j""",
)
def scalar_last_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each job two correlated scalars: they become outer joins on aggregates by job."""
    items = C.items(spark, sf_dir).where(F.col("job_id") == F.col("j.job_id").outer())
    last = items.where("state = 'failed'").select(F.max("beat")).scalar()
    n = items.select(F.count("*")).scalar()
    return C.jobs(spark, sf_dir).alias("j").select("job_id", "client", last.alias("last_failure"), n.alias("n_items"))


@core.query(
    "lateral_latest",
    f"""WITH {C.JOBS} SELECT c_custkey AS client, l.job_id, l.created FROM customer, LATERAL (SELECT job_id, created FROM jobs WHERE client = c_custkey ORDER BY created DESC, job_id LIMIT 2) l""",
)
def lateral_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two latest jobs of each client, as a lateral join."""
    clients = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client")).alias("c")
    jobs = C.jobs(spark, sf_dir).select("job_id", "created", F.col("client").alias("of"))
    latest = jobs.where(F.col("of") == F.col("c.client").outer()).orderBy(F.desc("created"), "job_id").limit(2)
    return clients.lateralJoin(latest).select("client", "job_id", "created")


def _page(i: Column) -> Column:
    return F.concat(F.lit("https://example.org/watch?v="), i.cast("string"))


@core.query(
    "recorded_probe",
    """SELECT 'https://example.org/watch?v=' || doc_id AS url, CASE WHEN doc_id % 3 <> 0 THEN n_chars END AS duration, CASE WHEN doc_id % 3 <> 0 THEN lang END AS language,
 CASE WHEN doc_id % 3 = 0 THEN 'nothing recorded for https://example.org/watch?v=' || doc_id END AS error FROM documents""",
)
def recorded_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the documents' metadata are recorded and read back through the data source; all pages are asked for."""
    docs = read(spark, sf_dir, "documents").select(_page(F.col("doc_id")).alias("url"), "doc_id", F.struct(F.col("n_chars").alias("duration"), F.col("lang").alias("language")).alias("info"))
    path = derived(spark, f"{sf_dir}/documents.parquet", "recorded-v1")
    record(docs.where("doc_id % 3 <> 0").select("url", "info"), path)
    info = F.from_json("info", "duration long, language string")
    return probe(spark, path, docs).select("url", info["duration"].alias("duration"), info["language"].alias("language"), "error")
