from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from loomspark.llm.q_vectors import register
from loomspark.llm.store import Scratch
from loomspark.llm.vectors import Book, encode, nearest
from loomspark.registry import Registry


def full_search(x, entries):
    d = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


@pytest.mark.parametrize("width", [1, 3, 16, 33])
def test_bounds_never_lose_the_nearest_entry(width):
    rng = np.random.default_rng(width)
    spread = rng.integers(-1000, 1000, (40, width))
    cases = {
        "far": (rng.integers(-1000, 1000, (500, width)), rng.integers(-1000, 1000, (256, width))),
        "groups": (spread[rng.integers(0, 40, 500)] + rng.integers(-2, 3, (500, width)), spread[rng.integers(0, 40, 256)] + rng.integers(-2, 3, (256, width))),
        "ties": (rng.integers(-1, 2, (500, width)), rng.integers(-1, 2, (256, width))),
        "equal": (np.full((50, width), 7), np.full((256, width), 7)),
        "large": (rng.integers(-(2**26), 2**26, (200, width)), rng.integers(-(2**26), 2**26, (64, width))),
        "one entry": (rng.integers(-9, 9, (20, width)), rng.integers(-9, 9, (1, width))),
    }
    for name, (x, entries) in cases.items():
        at, d, exact = nearest(x, Book.of(entries))
        want_at, want_d = full_search(x, entries)
        assert (at == want_at).all() and (d == want_d).all(), name
        assert exact <= x.shape[0] * len(entries)
    if width == 16:  # groups are told apart by their means
        assert nearest(*[f(y) for f, y in zip((np.asarray, Book.of), cases["groups"], strict=True)])[2] < 0.2 * 500 * 256
    assert [len(y) for y in nearest(np.zeros((0, width), np.int64), Book.of(np.zeros((0, width), np.int64)))[:2]] == [0, 0]


def by_hand(rows, parts=4, entries=256, rounds=4):
    """rows: (id, label, vector) in order -> [(id, code, error, label error)], hash of the codebooks."""
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, lab, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][2]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((dist(c[p], y), e) for e, y in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at, strict=True) if a[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign()
    error = [sum(d for d, _ in a) for a in at]
    labels = [lab for _, lab, _ in kept]
    out = [
        (i, "".join(f"{e:02x}" for _, e in a), err, sum(x for x, y in zip(error, labels, strict=True) if y == lab))
        for (i, lab, _), a, err in zip(kept, at, error, strict=True)
    ]
    line = ",".join(str(x) for b in books for y in b for x in y)
    return sorted(out), hashlib.sha256(line.encode()).hexdigest()


def some_rows(n):
    rng = np.random.default_rng(4)
    rows = [(i, [None, 1, 2][i % 3], [float(np.float32(x)) for x in rng.normal(size=8) / 3]) for i in range(n)]
    rows += [(n, 1, None), (n + 1, 1, []), (n + 2, 1, [1.0] * 7 + [None]), (n + 3, 2, [math.nan] * 8), (n + 4, 2, [math.inf] + [0.0] * 7)]
    return rows + [(n + 5, 9, rows[0][2]), (n + 6, 9, rows[0][2]), (-3, None, [0.0] * 8)]


@pytest.mark.parametrize("n", [300, 12])
def test_query_against_full_search(spark, tmp_path, n):
    rows = some_rows(n)
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    llm = Registry()
    register(llm)
    got = llm.functions()["op12_vector_codes"](spark, str(tmp_path)).collect()
    want, books = by_hand(sorted(rows, key=lambda r: r[0]))
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == want
    assert {r["codebooks_sha256"] for r in got} == {books}


def test_other_lengths_and_empty_tables(spark):
    rows = [(1, "x", [1.0] * 4), (None, "y", [2.0] * 4), (2, "z", [1.0] * 8), (3, "w", [1.0] * 3), (4, None, [1.5] * 4)]
    frame = spark.createDataFrame(rows, "id long, entries string, v array<double>")
    codes = encode(Scratch(spark, "test"), frame, "id", "v")
    got = {r["id"]: (list(r["entries"]), r["error"]) for r in codes.rows.collect()}
    assert got == {1: ([0] * 4, 0), 4: ([1] * 4, 0), None: ([2] * 4, 0)}
    assert encode(Scratch(spark, "test"), frame.limit(0), "id", "v").rows.count() == 0
    with pytest.raises(Exception, match="beyond"):
        encode(Scratch(spark, "test"), spark.createDataFrame([(1, [1e30] * 4)], "id long, v array<double>"), "id", "v")
