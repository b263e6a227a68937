"""Stored tables with upserts, and the vector store on top of them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators.keyed import KeyedTable, keep_old_if_null
from loomspark.operators.vector_store import VectorStore

SHAPE = "video_id long, stage string, state string, model string, at int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    rows = [(v, s, "done", f"m{v}", 1) for v in range(40) for s in ("stt", "ocr")] + [(None, "stt", "done", None, 1)]
    return KeyedTable(spark, f"{tmp_path}/stages", ("video_id",), 8).write(spark.createDataFrame(rows, SHAPE))


def test_upserts_by_key(spark, table):
    before = {(r["video_id"], r["stage"]): tuple(r) for r in table.read().collect()}
    change = [(3, "stt", "failed", None, 2), (3, "stt", "running", "x", 1), (99, "ocr", "new", None, 5), (None, "stt", "again", None, 2)]
    new = spark.createDataFrame(change, SHAPE)
    for _ in range(2):  # a retry changes nothing
        table.upsert(new, ["video_id", "stage"], order=[F.col("at")], merge={"model": keep_old_if_null})
        want = before | {(3, "stt"): (3, "stt", "failed", "m3", 2), (99, "ocr"): change[2], (None, "stt"): change[3]}
        assert rows_of(table.read().select(*SHAPE.replace(",", "").split()[::2])) == sorted(want.values(), key=str)
    table.insert_missing(spark.createDataFrame([(3, "stt", "lost", "y", 9), (7, "frames", "kept", "z", 9)], SHAPE), ["video_id", "stage"])
    got = {(r["video_id"], r["stage"]): r["state"] for r in table.read().collect()}
    assert got[3, "stt"] == "failed" and got[7, "frames"] == "kept" and len(got) == len(want) + 1
    table.upsert(new.where("false"), ["video_id", "stage"])
    assert table.read().count() == len(got)


def test_only_touched_folders_are_written(spark, table, tmp_path):
    def times():
        return {p.name: max(f.stat().st_mtime_ns for f in p.iterdir()) for p in (tmp_path / "stages").glob("folder=*")}

    before = times()
    table.upsert(spark.createDataFrame([(3, "stt", "failed", None, 2)], SHAPE), ["video_id", "stage"])
    changed = {k for k, t in times().items() if before.get(k) != t}
    assert len(changed) == 1 and len(before) > 4


def test_owners_are_replaced_and_deleted(spark, table):
    table.replace(spark.createDataFrame([(5, "only", "done", None, 2)], SHAPE), spark.createDataFrame([(5,), (6,)], "video_id long"))
    got = rows_of(table.read().select("video_id", "stage"))
    assert (5, "only") in got and not [x for x in got if x[0] == 6] and len([x for x in got if x[0] == 5]) == 1
    table.delete(table.read().select("video_id").distinct())
    assert table.read().count() == 0


def brute(rows, q, k, keep=lambda r: True):
    q = np.array(q)
    near = []
    for i, owner, t, v in rows:
        if keep((i, owner, t)) and len(v) == len(q) and np.linalg.norm(v):
            near.append((round(1 - float(np.dot(v, q) / (np.linalg.norm(v) * np.linalg.norm(q))), 6), i))
    return [(i, d) for d, i in sorted(near)[:k]]


def test_nearest_are_those_of_a_full_search(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, i % 9, float(i % 50), rng.normal(size=16).tolist()) for i in range(600)]
    base = rng.normal(size=16)
    rows += [(1000 + i, 3, float(i), (base + rng.normal(size=16) * 1e-3).tolist()) for i in range(300)]  # near-equal: codes can't tell them apart
    rows += [(2000 + i, 4, 1.0, rows[0][3]) for i in range(20)] + [(3000, 1, 1.0, [0.0] * 16), (3001, 1, 1.0, [1.0] * 8)]
    frame = spark.createDataFrame(rows, "id long, owner long, t_s double, vector array<float>")
    store = VectorStore.at(spark, f"{tmp_path}/v", 8).write(frame)
    rows = [(i, o, t, np.float32(v).astype(float)) for i, o, t, v in rows]
    got = lambda *a, **kw: [(r["id"], r["distance"]) for r in store.knn(*a, **kw).collect()]
    for q in (base.tolist(), rows[0][3].tolist(), rng.normal(size=16).tolist()):
        assert got(q, 10) == brute(rows, q, 10)
        some = spark.createDataFrame([(3,), (4,)], "owner long")
        assert got(q, 25, some, 2.0, 30.0) == brute(rows, q, 25, lambda r: r[1] in (3, 4) and 2 <= r[2] <= 30)
    assert got([1.0] * 8, 3) == [(3001, 0.0)] and got([1.0] * 5, 3) == []

    new = [(5000, 3, 0.0, base.tolist()), (5001, 77, 0.0, base.tolist())]
    for _ in range(2):
        store.replace(spark.createDataFrame(new, "id long, owner long, t_s double, vector array<float>"))
    left = [r for r in rows if r[1] != 3] + [(i, o, t, np.float32(v).astype(float)) for i, o, t, v in new]
    assert got(base.tolist(), 10) == brute(left, base, 10)
    store.delete(spark.createDataFrame([(3,)], "owner long"))
    assert got(base.tolist(), 10) == brute([r for r in left if r[1] != 3], base, 10)


def test_a_scope_reads_its_own_folders(spark, tmp_path):
    rows = [(i, i, 0.0, [1.0, float(i)]) for i in range(100)]
    store = VectorStore.at(spark, f"{tmp_path}/v", 16).write(spark.createDataFrame(rows, "id long, owner long, t_s double, vector array<float>"))
    plan = store.knn([1.0, 0.0], 3, spark.createDataFrame([(5,)], "owner long"))._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert scans and all("folder" in x.split("PartitionFilters: ")[1].split("]")[0] for x in scans)
    assert not any("vector" in x.split("ReadSchema")[1] for x in scans if "/codes" in x)
