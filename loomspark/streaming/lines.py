"""Events as lines of JSON, in one go or as they come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from loomspark.functions.answers import json_line


def write_lines(rows: DataFrame, event: Column, path: str, checkpoint: str) -> None:
    """Appends what a stream has not written yet to ``path`` as text and ends; the checkpoint keeps a line from coming twice."""
    lines = rows.select(json_line(event).alias("value"))
    query = lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
