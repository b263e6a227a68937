from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomspark.sources.recorded import probe, record, recorded


def test_a_recording_is_read_as_a_table(spark, tmp_path):
    path = f"{tmp_path}/infos"
    rows = [(f"https://e.org/{k}?a=é&b=\"{k}\"", (k, "x\ny")) for k in range(50)]
    record(spark.createDataFrame(rows, "url string, info struct<duration:long,title:string>").repartition(3), path)
    with open(f"{path}/torn.jsonl", "w") as f:
        f.write('{"url": "https://e.org/torn", "info": {"dur\n[1]\n{"info": 1}\n\n{"url": "https://e.org/none"}\n')
    got = {r["url"]: r["info"] for r in recorded(spark, path).collect()}
    assert set(got) == {u for u, _ in rows} | {"https://e.org/none"} and got["https://e.org/none"] is None
    assert json.loads(got[rows[7][0]]) == {"duration": 7, "title": "x\ny"}
    assert recorded(spark, path).rdd.getNumPartitions() == 4  # a file each

    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    for pushed in ("true", "false"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
        one = recorded(spark, path).where(F.col("url") == rows[3][0]).collect()
        some = recorded(spark, path).where(F.col("url").isin(rows[3][0], rows[4][0], "else") & F.col("info").contains("4")).collect()
        assert [r["url"] for r in one] == [rows[3][0]] and [r["url"] for r in some] == [rows[4][0]]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", before)

    asked = spark.createDataFrame([(rows[1][0],), (rows[1][0],), ("https://e.org/unknown",)], "url string")
    answers = {r["url"]: (r["info"] is not None, r["error"]) for r in probe(spark, path, asked).collect()}
    assert answers == {rows[1][0]: (True, None), "https://e.org/unknown": (False, "nothing recorded for https://e.org/unknown")}
    tracks = f"{tmp_path}/tracks"
    record(spark.createDataFrame([("u", "WEBVTT\n")], "url string, body string"), tracks)
    assert [tuple(r) for r in recorded(spark, tracks, "body").collect()] == [("u", "WEBVTT\n")]
