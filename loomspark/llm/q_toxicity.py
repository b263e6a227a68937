"""op4: toxicity of every whole document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.toxicity import id_bucket, score, train
from loomspark.registry import Registry
from loomspark.sources.tables import read


def register(llm: Registry) -> None:
    @llm.query("op4_toxicity")
    def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = read(spark, sf_dir, "documents").select("doc_id", "text")
        labels = read(spark, sf_dir, "labels").where(id_bucket(F.col("doc_id"), 5) != 0)
        scored = score(docs, train(docs, labels))
        return scored.select(
            "doc_id",
            (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out"),
            F.col("toxicity").alias("score"),
            (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        )
