"""Time and title rules on tables of inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import text as X

NOW = 1_706_659_200 + 3600


def test_corpus_time(spark):
    want = {
        "now": NOW, " Today ": NOW - 3600, "yesterday": NOW - 90000, "5m ago": NOW - 300, "3 d ago": NOW - 3 * 86400,
        "2mo ago": NOW - 60 * 86400, "1 Y AGO": NOW - 365 * 86400, "123456789": 123456789, "12345678": None,
        "2024-01-31": NOW - 3600, "2024-01-31T01:00": NOW, "2024-01-31 01:00:00Z": NOW, "2024-01-31T03:00:00+02:00": NOW,
        "2024-01-31T01:00Z": NOW, "2024-02-31": None, "5 minutes ago": None, "": None, "2024": None, "x" * 65: None, None: None,
    }
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", X.corpus_time(F.col("t"), NOW).alias("at")).collect()
    assert {r["t"]: r["at"] for r in rows} == want


def test_split_title(spark):
    want = {
        "Talk — Ann, Org, Inc": ("Talk", "Ann", "Org, Inc"), "Talk - Ann": ("Talk", "Ann", ""), "Talk": ("Talk", "", ""),
        "A - B – Ann,Org": ("A - B", "Ann", "Org"), "So - what?": ("So - what?", "", ""), "a-b": ("a-b", "", ""),
        "Talk\u00a0—\u00a0Ann": ("Talk", "Ann", ""), "T - " + "x" * 71: ("T - " + "x" * 71, "", ""), " - ": ("-", "", ""),
        "a - - b": ("a", "- b", ""), "": ("", "", ""), None: ("", "", ""),
    }
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", F.array(*X.split_title(F.col("t"))).alias("s")).collect()
    assert {r["t"]: tuple(r["s"]) for r in rows} == want
