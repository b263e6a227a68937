"""op5: language of every whole document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.language import identify, train
from loomspark.llm.toxicity import id_bucket
from loomspark.registry import Registry
from loomspark.sources.tables import read


def register(llm: Registry) -> None:
    @llm.query("op5_language")
    def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
        profiles = train(docs.where(id_bucket(F.col("doc_id"), 3) != 1))
        return identify(docs.select("doc_id", "text"), profiles).select(
            "doc_id",
            (id_bucket(F.col("doc_id"), 3) == 1).alias("held_out"),
            F.col("language.lang").alias("lang_pred"),
            F.col("language.score").alias("score"),
        )
