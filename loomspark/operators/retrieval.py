"""Scoped top-k legs and their fusion.

A scope is always applied before a cap: a cap first would lose candidates to
rows outside the scope. Ranks are taken over capped candidates only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Candidates of a leg, and the constant of reciprocal rank fusion.
CANDIDATES = 5000
RRF = 60
#: Fixed values of BM25 and the floor of its inverse document frequency.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def cosine_distance(v: Column, query: Column) -> Column:
    """1 - cosine in double precision; 0 to 2."""
    dot = lambda a, b: F.aggregate(
        F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )
    return F.lit(1.0) - dot(v, query) / F.sqrt(dot(v, v) * dot(query, query))


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, distance) of the k nearest rows of an already scoped table; the query is a literal, so no join."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, F.round(cosine_distance(F.col(vector_col), q), 6).alias("distance")).orderBy("distance", id_col).limit(k)


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, tf, dl): one row per term of a document."""
    spread = docs.select(id_col, F.size(tokens(F.col(text_col))).cast("long").alias("dl"), F.explode(tokens(F.col(text_col))).alias("term"))
    return spread.groupBy("term", id_col).agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def bm25(docs: DataFrame, terms: list[str], k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, score) of the k best documents for any of the terms; larger is better.

    Only the query's terms are counted, inside a row: no posting leaves a task.
    The statistics are one row, whatever the corpus.
    """
    words = docs.select(id_col, tokens(F.col(text_col)).alias("w"))
    count = lambda term: F.size(F.filter("w", lambda x: x == F.lit(term)))
    tf = [count(t) for t in terms]
    counted = words.select(id_col, F.size("w").alias("dl"), *[n.alias(f"tf{i}") for i, n in enumerate(tf)])
    stats = counted.agg(
        F.count("*").alias("n"),
        F.avg("dl").alias("avgdl"),
        *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))],
    )
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    part = lambda i: (
        F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(LEAST_IDF))
        * F.col(f"tf{i}")
        * (K1 + 1)
        / (F.col(f"tf{i}") + norm)
    )
    score = reduce(lambda a, b: a + b, [part(i) for i in range(len(terms))])
    hit = reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(terms))])
    scored = counted.where(hit).crossJoin(F.broadcast(stats))  # one row
    return scored.select(id_col, F.round(score, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def ranked(leg: DataFrame, order: list, out: str = "r") -> DataFrame:
    """Adds a global rank to a leg that is capped already."""
    return leg.withColumn(out, F.row_number().over(W.orderBy(*order)))


def rrf(legs: list[DataFrame], id_col: str) -> DataFrame:
    """(id, score, n_legs) from legs with (id, r): a row's ranks are summed over the legs."""
    every = reduce(DataFrame.unionByName, [leg.select(id_col, "r") for leg in legs])
    return every.groupBy(id_col).agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(RRF) + F.col("r"))), 6).alias("score"), F.count("*").alias("n_legs")
    )


def relevance_band(leg: DataFrame, ceiling: float, band: float) -> DataFrame:
    """Rows of a capped leg within the ceiling and within a band of the nearest."""
    nearest = leg.agg(F.min("distance").alias("nearest"))
    return leg.crossJoin(F.broadcast(nearest)).where((F.col("distance") <= ceiling) & (F.col("distance") <= F.col("nearest") + band)).drop("nearest")


def diversity_cap(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """At most n rows of a group, the first in order; the limit works before the shuffle as well."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in order."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__r") == 1).drop("__r")
