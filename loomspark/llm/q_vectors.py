"""op12: codes of all embeddings, their errors, and the codebooks behind them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.store import Scratch
from loomspark.llm.vectors import encode
from loomspark.registry import Registry
from loomspark.sources.tables import read

_PARTS, _ENTRIES, _ROUNDS = 4, 256, 4


def _steps() -> str:
    """The rounds as one table expression after another: c is a codebook, a its assignment of every part."""
    out = []
    for k in range(_ROUNDS + 1):
        out.append(
            f"""a{k} AS (SELECT r.id, r.p, min(struct_pack(d := CAST(list_dot_product(r.x, r.x) + list_dot_product(c.x, c.x) - 2 * list_dot_product(r.x, c.x) AS BIGINT), e := c.e)) AS near
  FROM part r JOIN c{k} c ON r.p = c.p GROUP BY r.id, r.p)"""
        )
        if k < _ROUNDS:
            out.append(
                f"""m{k} AS (SELECT p, e, list(x ORDER BY i) AS x FROM (
  SELECT p, e, i, floor(sum(x[i]) / count(*)) AS x FROM (
    SELECT r.p, a.near.e AS e, r.x, unnest(range(1, len(r.x) + 1)) AS i FROM part r JOIN a{k} a ON r.id = a.id AND r.p = a.p) GROUP BY p, e, i) GROUP BY p, e),
c{k + 1} AS (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (p, e))"""
            )
    return ",\n".join(out)


_ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) AS id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS (
  SELECT id, p, list_slice(v, p * len(v) // {_PARTS} + 1, (p + 1) * len(v) // {_PARTS}) AS x FROM kept, range({_PARTS}) t(p)
), c0 AS (SELECT p, id - 1 AS e, x FROM part WHERE id <= {_ENTRIES}),
{_steps()},
done AS (SELECT id, string_agg(lower(printf('%02x', near.e)), '' ORDER BY p) AS code, CAST(sum(near.d) AS BIGINT) AS error FROM a{_ROUNDS} GROUP BY id),
books AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM (
    SELECT p, e, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x FROM c{_ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM books) AS codebooks_sha256
FROM done JOIN kept USING (id)
"""


def register(llm: Registry) -> None:
    @llm.query("op12_vector_codes", _ORACLE)
    def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
        scratch = Scratch(spark, "codes")
        codes = encode(scratch, read(spark, sf_dir, "embeddings"), keep=["label"], parts=_PARTS, entries=_ENTRIES, rounds=_ROUNDS)
        coded = scratch.keep(codes.rows, "coded")
        numbers = (str(x) for book in codes.books for x in book.ravel().tolist())
        books = hashlib.sha256(",".join(numbers).encode()).hexdigest()
        by_label = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
        digits = F.transform("entries", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0"))
        return coded.join(by_label, F.col("label").eqNullSafe(F.col("l"))).select(
            F.col("id").alias("vec_id"), F.array_join(digits, "").alias("code"), "error", "label_error", F.lit(books).alias("codebooks_sha256")
        )
