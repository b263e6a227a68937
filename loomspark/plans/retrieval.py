"""Queries of the search path: legs, fusion, bands, caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import answers as A
from loomspark.operators import inverted as I
from loomspark.operators import retrieval as R
from loomspark.plans import corpus as C
from loomspark.registry import core
from loomspark.sources.tables import read

TERMS = ["the", "thea", "queaux"]
_TERM_ROWS = ", ".join(f"('{t}')" for t in TERMS)
#: Query vector: that of vector 0. Known before a search begins, as an embedder's answer would be.
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_DISTANCE = f"round(1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]), 6)"
_BM25 = f"""
w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
tf AS (SELECT doc_id, len(ws) AS dl, t.term, len(list_filter(ws, lambda x: x = t.term)) AS tf FROM w, (VALUES {_TERM_ROWS}) t(term)),
st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM w),
df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, round(sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM tf JOIN df USING (term), st GROUP BY doc_id HAVING sum(tf) > 0)"""


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row["embedding"])


def words_index(spark: SparkSession, sf_dir: str) -> I.Index:
    """Plain words of all documents, stored."""
    return I.open_or_build(spark, f"{sf_dir}/documents.parquet", "doc_id", {"text": F.col("text")}, I.PLAIN)


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k best documents for any of ``TERMS``, from their postings."""
    found = I.match(words_index(spark, sf_dir), TERMS, mode="any", fields=["text"])
    return found.select(F.col("id").alias("doc_id"), "score").orderBy(F.desc("score"), "doc_id").limit(k)


def _knn(spark: SparkSession, sf_dir: str, k: int, scope: str = "true") -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").where(scope)
    return R.knn(rows, _query_vector(spark, sf_dir), k, "vec_id", "embedding")


@core.query("knn_scoped", f"SELECT vec_id, {_DISTANCE} AS distance FROM embeddings WHERE label IN (1, 2, 3) ORDER BY distance, vec_id LIMIT 20")
def knn_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, 20, "label IN (1, 2, 3)")


@core.query(
    "relevance_band",
    f"""WITH k AS (SELECT vec_id, {_DISTANCE} AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 50)
SELECT vec_id, distance FROM k WHERE distance <= 0.85 AND distance <= (SELECT min(distance) FROM k WHERE vec_id <> 0) + 0.2 AND vec_id <> 0""",
)
def relevance_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.relevance_band(_knn(spark, sf_dir, 50).where("vec_id <> 0"), 0.85, 0.2)


@core.query("bm25_topk", f"WITH {_BM25} SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 25")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 25)


@core.query(
    "rrf_fusion",
    f"""WITH {_BM25},
l AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm ORDER BY r LIMIT 200),
k AS (SELECT vec_id AS id, {_DISTANCE} AS d FROM embeddings ORDER BY d, vec_id LIMIT 200),
v AS (SELECT id, row_number() OVER (ORDER BY d, id) AS r FROM k),
f AS (SELECT id, round(sum(1 / (60::DOUBLE + r)), 6) AS score, count(*) AS n_legs FROM (SELECT * FROM l UNION ALL SELECT * FROM v) GROUP BY id)
SELECT * FROM f ORDER BY score DESC, n_legs DESC, id LIMIT 20""",
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical = _bm25(spark, sf_dir, 200).withColumnRenamed("doc_id", "id")
    vector = _knn(spark, sf_dir, 200).withColumnRenamed("vec_id", "id")
    fused = R.rrf([R.ranked(lexical, [F.desc("score"), "id"]), R.ranked(vector, ["distance", "id"])], "id")
    return fused.orderBy(F.desc("score"), F.desc("n_legs"), "id").limit(20)


@core.query(
    "leg_counts",
    f"""WITH {_BM25} SELECT (SELECT count(*) FROM bm) AS n_fts, (SELECT count(*) FROM embeddings WHERE {_DISTANCE} <= 0.7) AS n_vec,
 (SELECT count(*) FROM embeddings) AS n_vec_knn""",
)
def leg_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fts = words_index(spark, sf_dir).postings(TERMS).select("id").distinct().agg(F.count("*").alias("n_fts"))
    q = F.array(*map(F.lit, _query_vector(spark, sf_dir)))
    near = F.round(R.cosine_distance(F.col("embedding"), q), 6) <= 0.7
    vec = read(spark, sf_dir, "embeddings").agg(F.count_if(near).alias("n_vec"), F.count("*").alias("n_vec_knn"))
    return fts.crossJoin(vec)  # one row each


@core.query(
    "leg_unpivot",
    f"""WITH c AS (SELECT (SELECT count(*) FROM documents) AS segments, (SELECT count(*) FROM conversations) AS cues, (SELECT count(*) FROM embeddings) AS chunks)
SELECT * FROM (SELECT 'segments' AS unit, segments AS n FROM c UNION ALL SELECT 'cues', cues FROM c UNION ALL SELECT 'chunks', chunks FROM c)""",
)
def leg_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda table, name: read(spark, sf_dir, table).agg(F.count("*").alias(name))
    one = count("documents", "segments").crossJoin(count("conversations", "cues")).crossJoin(count("embeddings", "chunks"))
    return one.unpivot([], ["segments", "cues", "chunks"], "unit", "n")


@core.query(
    "lexical_footing",
    f"WITH {_BM25} SELECT count(*) > 0 AS has_footing FROM bm",
)
def lexical_footing(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = words_index(spark, sf_dir).vocabulary(TERMS)  # a term in the vocabulary is in some document
    return hits.limit(1).agg((F.count("*") > 0).alias("has_footing"))


@core.query(
    "title_footing",
    f"WITH {C.VIDEOS} SELECT video_id, title FROM videos WHERE list_contains(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}]+'), 'the') ORDER BY video_id LIMIT 3",
)
def title_footing(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.array_contains(R.tokens(F.col("title")), "the")
    return C.videos(spark, sf_dir).where(hit).select("video_id", "title").orderBy("video_id").limit(3)


@core.query(
    "snippet",
    rf"""WITH {_BM25}, top AS (SELECT doc_id FROM bm ORDER BY score DESC, doc_id LIMIT 10),
p AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS words, string_split_regex(text, '[\p{{L}}\p{{N}}]+') AS gaps FROM documents JOIN top USING (doc_id)),
m AS (SELECT r, len(words) AS n, pos, nullif(list_position([{", ".join(f"'{t}'" for t in TERMS)}], lower(words[pos + 1])), 0) AS term, pos = 0 OR regexp_matches(gaps[pos + 1], '[.:][ \t\r\n]+\z') AS begins FROM p, unnest(range(len(words))) u(pos)),
s AS (SELECT *, count(term) OVER ahead + 999 * count(DISTINCT term) OVER ahead AS worth, max(pos) FILTER (term IS NOT NULL) OVER ahead AS last_pos FROM m
  WINDOW ahead AS (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 63 FOLLOWING)),
b AS (SELECT *, max(pos) FILTER (begins) OVER so_far AS sentence, arg_max(worth, pos) FILTER (begins) OVER so_far AS sentence_worth FROM s WINDOW so_far AS (PARTITION BY r ORDER BY pos)),
c AS (SELECT r, n, worth, pos, true AS centred, greatest(0, least(pos - (64 - (last_pos + 1 - pos)) // 2, n - 64)) AS lo FROM b WHERE term IS NOT NULL
  UNION ALL SELECT r, n, sentence_worth + CASE sentence WHEN 0 THEN 120 ELSE 100 END, pos, false, sentence FROM b WHERE term IS NOT NULL AND n > 64 AND sentence < pos),
best AS (SELECT r, n, arg_max(lo, (worth, -pos, centred)) AS lo, least(n, arg_max(lo, (worth, -pos, centred)) + 64) AS hi FROM c GROUP BY r, n)
SELECT doc_id, coalesce(CASE WHEN lo > 0 THEN ' … ' ELSE gaps[1] END || array_to_string(list_transform(range(lo, hi), lambda i: words[i + 1] || CASE WHEN i + 1 < hi THEN gaps[i + 2] ELSE '' END), '')
 || CASE WHEN hi < n THEN ' … ' ELSE gaps[n + 1] END, text) AS snippet FROM p LEFT JOIN best USING (r)""",
)
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document of the page says of the terms."""
    top = [r["doc_id"] for r in _bm25(spark, sf_dir, 10).collect()]  # a page of ids, which the scan can prune by
    docs = read(spark, sf_dir, "documents").where(F.col("doc_id").isin(*top))
    return docs.select("doc_id", A.snippet(F.col("text"), TERMS).alias("snippet"))


@core.query(
    "highlight_runs",
    r"""WITH d AS (SELECT doc_id, text AS t FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(lower(t), 'the|and')) AS INTEGER) AS n_hits,
 regexp_replace(t, '(?i)(the|and)', '[\1]', 'g') AS marked FROM d WHERE len(regexp_extract_all(lower(t), 'the|and')) > 0""",
)
def highlight_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    n = F.regexp_count("t", F.lit("(?i)(the|and)"))
    return d.select("doc_id", n.alias("n_hits"), F.regexp_replace("t", "(?i)(the|and)", "[$1]").alias("marked")).where("n_hits > 0")


@core.query(
    "diversity_cap",
    """WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS r FROM embeddings)
SELECT vec_id, label FROM r WHERE r <= 3""",
)
def diversity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].alias("s"))
    return R.diversity_cap(rows, "label", [F.desc("s"), "vec_id"], 3).drop("s")


@core.query(
    "phash_dedup",
    f"""WITH {C.FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id, phash ORDER BY sharpness DESC, t_s, frame_id) AS r FROM frames)
SELECT video_id, phash, frame_id FROM r WHERE r = 1""",
)
def phash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_of(C.frames(spark, sf_dir), ["video_id", "phash"], [F.desc("sharpness"), "t_s", "frame_id"]).select("video_id", "phash", "frame_id")


@core.query(
    "phash_hamming",
    f"WITH {C.FRAMES} SELECT frame_id, CAST(bit_count(xor(phash, 341)) AS INTEGER) AS distance FROM frames WHERE bit_count(xor(phash, 341)) <= 2",
)
def phash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.bit_count(F.col("phash").bitwiseXOR(F.lit(341)))
    return C.frames(spark, sf_dir).select("frame_id", d.alias("distance")).where("distance <= 2")


@core.query(
    "pool_sentinel",
    f"""WITH k AS (SELECT vec_id, {_DISTANCE} AS d FROM embeddings ORDER BY d, vec_id LIMIT 401), n AS (SELECT count(*) AS n FROM k)
SELECT vec_id, d AS distance, n > 400 AS pool_full FROM k, n ORDER BY d, vec_id LIMIT 400""",
)
def pool_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _knn(spark, sf_dir, 401)
    full = pool.agg((F.count("*") > 400).alias("pool_full"))
    return pool.crossJoin(F.broadcast(full)).orderBy("distance", "vec_id").limit(400)


@core.query(
    "total_order",
    f"""WITH d AS (SELECT vec_id, label, {_DISTANCE} AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 100)
SELECT vec_id, CAST(row_number() OVER (ORDER BY floor(distance * 20), label, vec_id) AS INTEGER) AS place FROM d""",
)
def total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _knn(spark, sf_dir, 100).join(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return R.ranked(pool, [F.floor(F.col("distance") * 20), "label", "vec_id"], "place").select("vec_id", "place")


@core.query(
    "evidence_ids",
    f"""WITH {C.FRAMES}, p AS (SELECT video_id, t_s, row_number() OVER (ORDER BY sharpness DESC NULLS LAST, frame_id) AS place FROM frames),
f AS (SELECT video_id, t_s, min(place) AS first FROM p WHERE place <= 200 GROUP BY ALL)
SELECT video_id, t_s, CAST(dense_rank() OVER (ORDER BY first) AS INTEGER) AS n FROM f""",
)
def evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 200 frames' moments, numbered as they are first seen on that page."""
    order = [F.desc_nulls_last("sharpness"), F.asc("frame_id")]
    page = R.ranked(C.frames(spark, sf_dir).orderBy(*order).limit(200), order, "place")
    first = page.groupBy("video_id", "t_s").agg(F.min("place").alias("first"))
    return R.ranked(first, ["first"], "n").select("video_id", "t_s", "n")


@core.query(
    "vector_dim_audit",
    "SELECT CAST(len(embedding) AS INTEGER) AS dim, count(*) AS n, CAST(len(embedding) = 64 AS BOOLEAN) AS ok FROM embeddings GROUP BY 1, 3",
)
def vector_dim_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).withColumn("ok", F.col("dim") == 64)


@core.query(
    "mrl_truncate",
    """WITH t AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS v1, round(v[16] / sqrt(list_dot_product(v, v)), 6) AS v16 FROM t""",
)
def mrl_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 16).cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return v.select("vec_id", F.round(F.col("v")[0] / norm, 6).alias("v1"), F.round(F.col("v")[15] / norm, 6).alias("v16"))


@core.query(
    "l2_normalize",
    """WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS v1 FROM t""",
)
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.select("vec_id", F.round(F.col("v")[0] / F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("v1"))


@core.query(
    "mrr",
    f"""WITH k AS (SELECT vec_id, label, row_number() OVER (ORDER BY {_DISTANCE}, vec_id) AS r FROM embeddings WHERE vec_id <> 0
  QUALIFY r <= 200), f AS (SELECT label, min(r) AS first FROM k GROUP BY label)
SELECT round(avg(1 / first::DOUBLE), 6) AS mrr, count(*) AS n FROM f""",
)
def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _knn(spark, sf_dir, 200, "vec_id <> 0").join(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    first = R.ranked(pool, ["distance", "vec_id"]).groupBy("label").agg(F.min("r").alias("first"))
    return first.agg(F.round(F.avg(1 / F.col("first")), 6).alias("mrr"), F.count("*").alias("n"))


@core.query(
    "trigram_jaccard",
    """WITH t AS (SELECT p_partkey, '  ' || p_name || ' ' AS s FROM part), g AS (
 SELECT p_partkey, list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS a FROM t), q AS (
 SELECT a AS b FROM g WHERE p_partkey = 0)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 4) AS similarity FROM g, q
WHERE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE >= 0.5""",
)
def trigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("s")).withColumn("a", grams(F.col("s")))
    q = part.where("p_partkey = 0").select(F.col("a").alias("b"))
    ratio = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    return part.crossJoin(F.broadcast(q)).where(ratio >= 0.5).select("p_partkey", F.round(ratio, 4).alias("similarity"))  # one query row


@core.query(
    "match_coverage",
    r"""WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents)
SELECT doc_id, contains(t, ' of the ') AS exact, round(len(list_filter(['of', 'the', 'zzz'], lambda w: contains(t, ' ' || w || ' '))) / 3::DOUBLE, 2) AS coverage
FROM d WHERE contains(t, ' of ') OR contains(t, ' the ')""",
)
def match_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    d = read(spark, sf_dir, "documents").select("doc_id", body.alias("t"))
    has = lambda w: F.contains("t", F.lit(f" {w} "))
    n = sum((has(w).cast("int") for w in ("the", "zzz")), has("of").cast("int"))
    return d.where(has("of") | has("the")).select("doc_id", has("of the").alias("exact"), F.round(n / 3, 2).alias("coverage"))


@core.query(
    "frame_collapse",
    f"""WITH {C.FRAMES} SELECT video_id, phash, min(frame_id) AS frame_id, round(sum(sharpness), 4) AS score, count(*) AS n_legs,
 string_agg(DISTINCT kind, '+' ORDER BY kind) AS sources FROM frames GROUP BY video_id, phash""",
)
def frame_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.frames(spark, sf_dir).groupBy("video_id", "phash").agg(
        F.min("frame_id").alias("frame_id"),
        F.round(F.sum("sharpness"), 4).alias("score"),
        F.count("*").alias("n_legs"),
        F.array_join(F.sort_array(F.collect_set("kind")), "+").alias("sources"),  # a handful of kinds
    )
