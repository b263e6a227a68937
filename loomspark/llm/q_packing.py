"""op2: packs every document into sequences of 4096 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomspark.llm.packing import pack_documents
from loomspark.registry import Registry
from loomspark.sources.tables import read

END_ID = 2


def register(llm: Registry) -> None:
    @llm.query("op2_packing")
    def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = public_tokenizers.path("word_bpe_49k.json")
        return pack_documents(spark, read(spark, sf_dir, "documents"), path, END_ID).select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
        )
