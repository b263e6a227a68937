"""op7: rates that mix clean, junk and toxic text to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.mixing import mix
from loomspark.registry import Registry
from loomspark.sources.tables import read

WEIGHTS = {"clean": 0.9, "junk": 0.08, "toxic": 0.02}


def domains(labels: DataFrame) -> DataFrame:
    """labels -> (doc_id, domain)."""
    toxic, clean = F.col("toxic") == 1, F.col("quality") == 1
    return labels.select("doc_id", F.when(toxic, "toxic").when(clean, "clean").when(F.col("quality") == 0, "junk").alias("domain"))


def register(llm: Registry) -> None:
    @llm.query("op7_mixing")
    def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = read(spark, sf_dir, "documents").select("doc_id", "text")
        mixed = mix(spark, docs, domains(read(spark, sf_dir, "labels")), WEIGHTS)
        return mixed.select(
            "doc_id",
            "tokens",
            *[F.col("posterior")[d].alias(f"p_{d}") for d in WEIGHTS],
            "rate",
            "copies",
            *[F.col("residual")[d].alias(f"residual_{d}") for d in WEIGHTS],
            "met",
            "converged",
        )
