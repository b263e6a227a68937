"""op3: five nearest vectors of every fiftieth vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm.neighbours import nearest_neighbours
from loomspark.registry import Registry
from loomspark.sources.tables import read


def register(llm: Registry) -> None:
    @llm.query("op3_neighbours")
    def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nearest_neighbours(spark, read(spark, sf_dir, "embeddings"), "id % 50 = 0")
