"""A training corpus from raw documents: clean, distinct, mixed and packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. All but the last return the columns of ``documents``; the last returns the
pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.mixing import mix
from loomspark.llm.neardup import near_duplicates
from loomspark.llm.packing import pack_documents
from loomspark.llm.passages import dedup_passages, kept_text
from loomspark.llm.store import Scratch
from loomspark.llm.toxicity import score, train
from loomspark.registry import Registry
from loomspark.sources.tables import read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Refused from this probability on.
TOXIC = 0.5
#: Wanted tokens of low quality, as part of those there are; of high quality all are.
LOW_QUALITY = 0.5
END_ID = 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression distance speaks of toxic text go."""
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).where(F.col("toxicity") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id, once."""
    found = near_duplicates(spark, docs)
    kept = found.where("kept").select("doc_id").distinct()
    # Rows that share an id are one document to the operator: the least of their texts stays. Rows without an id are kept apart.
    alone = docs.where("doc_id IS NULL")
    least = F.min_by(F.struct(*COLUMNS), F.struct("text", "source", "lang")).alias("row")
    one = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(least).select("row.*")
    return one.unionByName(alone.select(*COLUMNS))


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[str, int, bool]:
    text = kept_text(raw, spans)
    return text, len(text), bool(spans)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand in an earlier document go; a document without words left goes with them."""
    schema = [("text", pa.string(), "string"), ("n_chars", pa.int64(), "long"), ("__cut", pa.bool_(), "boolean")]
    out = dedup_passages(spark, docs, _cut, schema)
    return out.where(~F.col("__cut") | (F.col("n_chars") > 0)).select(*COLUMNS)


def mix_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All of high quality and part of the rest: rates are at most 1, so no document comes twice.

    Without labels of two kinds there is nothing to weigh: each kind that is known, or else the whole table, stays whole.
    """
    quality = read(spark, sf_dir, "labels").where("doc_id IS NOT NULL").select(  # a label without an id is no document's
        "doc_id", F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("domain")
    )
    known = {r["domain"] for r in quality.where("domain IS NOT NULL").select("domain").distinct().collect()}  # two values at most
    weights = {d: w for d, w in (("high", 1.0), ("low", LOW_QUALITY if len(known) == 2 else 1.0)) if d in known}
    if not weights:
        return docs.select(*COLUMNS)
    mixed = mix(spark, docs.select("doc_id", "text"), quality, weights, total=None, max_rate=1.0)
    kept = mixed.where("copies > 0").select("doc_id")
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("passages", drop_repeated_passages),
    ("mixing", mix_quality),
    ("packing", pack),
]
#: SQL has no compression, fitted rates or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


registry = Registry()
registry.query("pipeline", ORACLE_SQL)(run)
