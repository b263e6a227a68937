"""op11: spans of secrets in every whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.secrets import listed, scan
from loomspark.registry import Registry
from loomspark.sources.tables import read

_BASE = ("assign", "access", "hex")


def register(llm: Registry) -> None:
    @llm.query("op11_secrets")
    def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
        of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
        return found.select(
            "doc_id",
            *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in _BASE],
            F.sha2(listed(of(*_BASE)), 256).alias("base_sha256"),
            listed(F.col("secrets")).alias("spans"),
        )
