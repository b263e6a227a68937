"""op10: license detections in every whole text, with places of three plain phrases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.licenses import fold, scan
from loomspark.registry import Registry
from loomspark.sources.tables import read

#: Phrases and their labels.
_BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def _phrase(words: str) -> str:
    return f"(?<!{_WORD})" + f"{_GAP}+".join(words.split()) + f"(?!{_WORD})"


def _pieces(text: Column, words: str) -> Column:
    """The text between places of a phrase; a single piece where it has none. No phrase overlaps itself."""
    held = reduce(lambda a, b: a & b, [F.contains(text, F.lit(w)) for w in words.split()])
    return F.when(held, F.split(text, _phrase(words))).otherwise(F.array(text))


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{_WORD}+"))


def register(llm: Registry) -> None:
    @llm.query("op10_licenses")
    def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        body = docs.withColumn("body", fold(F.col("text"))).withColumn("n_words", _words(F.col("body")).cast("long"))
        cut = body.select(
            "doc_id", "text", "n_words", *[_pieces(F.col("body"), p).alias(f"p{i}") for i, (p, _) in enumerate(_BASE)]
        )
        places = [F.size(f"p{i}") - 1 for i in range(len(_BASE))]
        first = [F.when(n > 0, _words(F.element_at(f"p{i}", 1))) for i, n in enumerate(places)]
        last = [
            F.when(n > 0, F.col("n_words") - _words(F.element_at(f"p{i}", -1)) - len(_BASE[i][0].split()))
            for i, n in enumerate(places)
        ]
        base = F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for n, (_, label) in zip(places, _BASE, strict=True)]))
        found = scan(
            cut.select(
                "doc_id",
                "text",
                "n_words",
                sum(places[1:], places[0]).cast("long").alias("n_base"),
                F.least(*first).cast("long").alias("first_word"),
                F.greatest(*last).cast("long").alias("last_word"),
                base.alias("base"),
            )
        )
        both = F.array_union("base", F.transform("licenses", lambda s: s["label"]))
        sure = F.array_max(F.transform("licenses", lambda s: s["confidence"]))
        return found.select(
            "doc_id",
            "n_words",
            "n_base",
            "first_word",
            "last_word",
            F.array_join(F.array_sort("base"), ",").alias("base_labels"),
            F.array_join(F.array_sort(both), ",").alias("labels"),
            F.coalesce(F.greatest(sure, F.when(F.col("n_base") > 0, F.lit(0.9))), F.lit(0.0)).alias("score"),
        )
