"""op9: stores every text as a transport stream and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.mpegts import CLOCK_HZ, read_streams, with_streams
from loomspark.registry import Registry
from loomspark.sources.tables import read

_BLOCK = 64


def stored_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): texts as bytes, padded to whole blocks, as transport streams."""
    raw = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    size = F.octet_length("raw")
    blocks = F.greatest(F.lit(1), F.ceil(size / _BLOCK).cast("int"))
    padded = F.concat("raw", F.unhex(F.repeat(F.lit("00"), blocks * _BLOCK - size)))
    payload = raw.select("doc_id", size.cast("long").alias("n_bytes"), padded.alias("payload"))
    return with_streams(payload, "payload").drop("payload")


def register(llm: Registry) -> None:
    @llm.query("op9_mpegts")
    def op9_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
        back = read_streams(stored_texts(read(spark, sf_dir, "documents")), "media")
        s, part = F.col("stream"), lambda name: F.col(f"stream.{name}")
        seconds = F.format_string("%.2f", (F.element_at(part("pts"), -1) - F.element_at(part("pts"), 1)) / CLOCK_HZ)
        points = F.array_join(F.transform(part("access_points"), lambda a: F.concat_ws("@", a["packet"], a["pts"])), ",")
        fact = lambda name, value: F.concat(F.lit(f"{name}="), value.cast("string"))
        feature = F.concat_ws(
            ";",
            fact("pid", s["pid"]),
            fact("type", s["stream_type"]),
            fact("packets", s["packets"]),
            fact("pes", F.size(part("pts"))),
            fact("seconds", seconds),
            fact("access", points),
            fact("lost", s["counter_errors"]),
            fact("damaged", s["damaged"]),
        )
        payload = part("payload")
        return back.select(
            "doc_id",
            "n_bytes",
            F.octet_length(payload).cast("long").alias("payload_bytes"),
            F.sha2(payload, 256).alias("payload_sha256"),
            F.crc32(F.substring(payload, -_BLOCK, _BLOCK)).alias("tail_crc32"),
            F.octet_length("media").cast("long").alias("media_bytes"),
            F.sha2("media", 256).alias("media_sha256"),
            feature.alias("feature"),
        )
