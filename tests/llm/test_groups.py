"""Operators that compare documents, against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loomspark.llm import mixing, neardup, neighbours, passages, words


def corpus(rng, n=150):
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choices(words, k=rng.choice([0, 1, 3, 19, 20, 40, 120])) for _ in range(n)]
    shared = rng.choices(words, k=60)
    out = []
    for i, w in enumerate(base):
        if i % 7 == 0 and len(w) > 30:
            w = w[:20] + shared + w[20:]
        out.append(w)
    for _ in range(n):
        w = list(rng.choice(out))
        for _ in range(rng.choice([0, 1, 1, 2, 6])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
        out.append(w)
    return [(i, rng.choice([" ", "\n", " \t "]).join(w) or None, "x") for i, w in enumerate(out)]


def test_near_duplicates(spark):
    rows = corpus(random.Random(3))
    docs = spark.createDataFrame([*rows, (900, "", "x")], "doc_id long, text string, component_id string")
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark, docs, words=4).collect()}
    sets = {}
    for i, t, _ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {i: got[i]["component_id"] for i in sets} == {i: find(i) for i in sets}
    assert all(got[i]["n_shingles"] == len(s) for i, s in sets.items())
    assert got[900]["component_id"] == 900 and got[900]["kept"]


def brute_components(rows, size=4):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and find(a) != find(b):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in sets}


def test_large_group_of_near_copies(spark, monkeypatch):
    """700 copies of one text, 0.6 to 0.95 alike, in blocks of 64: more than one block, and several components."""
    monkeypatch.setattr(neardup, "BLOCK", 64)
    monkeypatch.setattr(neardup, "GROUP", 10_000)
    rng = random.Random(11)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for i in range(700):
        w = list(base)
        for k in rng.sample(range(100), rng.choice([1, 2, 3, 5])):
            w[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    want = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) > 5


def test_near_duplicates_with_repeated_and_null_ids(spark):
    text = " ".join(f"a{i}" for i in range(50))
    docs = spark.createDataFrame([(5, text), (5, text), (5, "other words here now and then"), (9, text), (None, text)], "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(spark, docs).collect()]
    assert sorted(got, key=str) == sorted([(5, 5)] * 3 + [(9, 5), (None, None)], key=str)
    assert neardup.near_duplicates(spark, docs.limit(0)).count() == 0


def digest(raw, spans):
    words = raw.split()
    gone = {k for a, b in spans for k in range(a, b)}
    return len(words), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest(), passages.kept_text(raw, spans)


SCHEMA = [("n", pa.int64(), "long"), ("gone", pa.int64(), "long"), ("sha", pa.string(), "string"), ("kept", pa.string(), "string")]


def without_repeats(rows):
    """id -> (words, removed, digest), by brute force."""
    seen, out = set(), {}
    for i, t, *_ in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        cut = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                cut[k : k + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, c in zip(w, cut, strict=True) if not c)
        out[i] = (len(w), sum(cut), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("bits", [64, 6])
def test_equal_hashes_remove_nothing(spark, bits):
    """With 6 bits nearly every hash is shared by windows of other words."""
    rows = corpus(random.Random(8), 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    got = passages.dedup_passages(spark, docs, digest, SCHEMA, hash_bits=bits).collect()
    assert {r["doc_id"]: (r["n"], r["gone"], r["sha"]) for r in got} == without_repeats(rows)


def test_words_whose_polynomials_are_equal_modulo_powers_of_two(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{k}" for k in range(19))
    docs = spark.createDataFrame([(1, f"{word} {tail}"), (2, f"{word.translate(str.maketrans('ab', 'ba'))} {tail}")], "doc_id long, text string")
    assert [r["gone"] for r in passages.dedup_passages(spark, docs, digest, SCHEMA).collect()] == [0, 0]


def test_fingerprints_are_polynomials_modulo_a_prime():
    h = np.random.default_rng(1).integers(0, 2**64, 40, dtype=np.uint64)
    h[:3] = [words.PRIME - 1, words.PRIME, 2**64 - 1]
    for size in (1, 2, 3, 4, 5, 20):
        base = words.BASES[0]
        want = [sum(int(h[k + j]) * pow(base, size - 1 - j, words.PRIME) for j in range(size)) % words.PRIME for k in range(41 - size)]
        assert (words.fingerprints(h, size, base) == words.mix(np.array(want, np.uint64))).all()


def test_passages_with_clashing_columns(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(1, text, "x", 1, 2), (2, text, None, 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, kind int, row int")
    got = passages.dedup_passages(spark, docs, digest, SCHEMA).collect()
    assert sorted((r["doc_id"], r["id"], r["kind"], r["row"], r["gone"]) for r in got) == [(1, "x", 1, 2, 0), (2, None, 3, None, 30)]


def test_texts_that_share_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b)], "doc_id long, text string")
    got = passages.dedup_passages(spark, docs, digest, SCHEMA).collect()
    assert sorted((r["doc_id"], r["gone"]) for r in got) == [(1, 0), (5, 0), (5, 40), (7, 40)]


def test_passages(spark):
    rows = corpus(random.Random(4))
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {r["doc_id"]: r for r in passages.dedup_passages(spark, docs, digest, SCHEMA).collect()}
    assert {i: (r["n"], r["gone"], r["sha"]) for i, r in got.items()} == without_repeats(rows)
    assert all(hashlib.sha256(" ".join(r["kept"].split()).encode()).hexdigest() == r["sha"] for r in got.values())
    assert passages.dedup_passages(spark, docs.limit(0), digest, SCHEMA).count() == 0


def test_rows_of_one_id_are_no_copies_of_each_other(spark):
    text = " ".join(f"a{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["gone"]) for r in passages.dedup_passages(spark, docs, digest, SCHEMA).collect())
    assert got == [("1", 30), ("1", 30), ("None", 0)]


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 24)).astype(np.float32)
    v[1] = v[0]
    v[300:420] = v[300]  # a common vector
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)]
    rows += [(1000, None, "x"), (1001, [0.0] * 24, "x"), (1002, [float("nan")] * 24, "x"), (1003, [1.0], "x"), (1004, [None] * 24, "x"), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got: dict[int, list] = {}
    for r in neighbours.nearest_neighbours(spark, df, "id % 20 = 0").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 600, 20):
        s = np.round(u @ u[q], 12)
        best = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:5]
        mine = [i for _, i, _ in sorted(got[q])]
        hit += len(set(mine) & set(best))
        assert all(abs(s[i] - x) < 1e-9 for _, i, x in got[q])
    assert hit >= 0.95 * 150 and len(got) == 30
    assert [i for _, i, _ in sorted(got[320])] == [300, 301, 302, 303, 304]
    few = neighbours.nearest_neighbours(spark, df.where("vec_id IN (3, 20, 9)"), "id % 20 = 0")
    assert few.count() == 2
    assert neighbours.nearest_neighbours(spark, df.limit(0), "true").count() == 0


def test_mixing(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        kind = "ab"[i % 3 == 0]
        rows.append((i, " ".join(rng.choices(["red", "green", "blue"] if kind == "a" else ["one", "two", "three"], k=rng.randint(5, 60))), 1.0))
        if i % 2:
            labels.append((i, kind))
    docs = spark.createDataFrame([*rows, (700, None, 1.0), (701, "", 1.0)], "doc_id long, text string, rate double")
    known = spark.createDataFrame([*labels, (None, "a"), (3, None)], "doc_id long, domain string")
    got = mixing.mix(spark, docs, known, {"a": 0.5, "b": 0.5}).collect()
    total = sum(r["tokens"] for r in got)
    assert len(got) == 602
    for d in "ab":
        assert abs(sum(r["rate"] * r["tokens"] * r["posterior"][d] for r in got) - total / 2) < 0.01 * total
    assert all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1 for r in got)
    sure = {r["doc_id"]: r["posterior"] for r in got}
    assert all(sure[i]["ab"[i % 3 == 0]] > 0.9 for i in range(600))
    assert mixing.mix(spark, docs, known.limit(0), {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(spark, docs, known, {"zzz": 1.0})


def test_rates_against_brute_force_least_squares(spark, tmp_path):
    """Projected gradient in numpy, run to its end, on posteriors of two and three domains; the second goal is out of reach."""
    from loomspark.llm.store import Scratch

    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.3, 0.2], 400)
    t = rng.integers(1, 50, 400)
    judged = spark.createDataFrame([(i, int(n), x.tolist()) for i, (n, x) in enumerate(zip(t, p, strict=True))], "doc_id long, tokens long, posterior array<double>")
    for parts in ([0.6, 0.3, 0.1], [0.995, 0.004, 0.001]):
        goal = np.array(parts) * t.sum()
        fit = mixing.fit_rates(Scratch(spark, "test"), judged, ("a", "b", "c"), dict(zip("abc", goal.tolist(), strict=True)), 2.0)
        got = fit.rated.toPandas()
        r = np.ones(400)
        a = (p * t[:, None] / goal).T
        step = 1 / np.linalg.eigvalsh((a / t) @ a.T)[-1]
        for _ in range(60_000):
            r = np.clip(r - step * ((a @ r - 1) @ (a / t)), 0, 2)
        best = np.square(a @ r - 1).sum()
        mine = np.square(np.array([fit.residuals[d] for d in "abc"])).sum()
        assert mine <= best * 1.02 + 1e-7 and got["rate"].between(0, 2).all()
        assert fit.met == (best < 1e-6)


def test_repeated_rows_leave_posteriors_unchanged(spark):
    rows = [(i, ["red green", "one two"][i % 2] + f" w{i % 5}") for i in range(60)]
    known = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "doc_id long, domain string")
    once = spark.createDataFrame([*rows, (99, "red one")], "doc_id long, text string")
    thrice = spark.createDataFrame([*rows, *[(99, "red one")] * 3], "doc_id long, text string")
    weights = {"a": 0.5, "b": 0.5}
    a, b = ({r["doc_id"]: r["posterior"] for r in mixing.mix(spark, d, known, weights).collect()} for d in (once, thrice))
    assert a == b and len(a) == 61


def test_neighbours_among_near_equal_vectors(spark):
    rng = np.random.default_rng(8)
    far = rng.normal(size=(500, 32))
    base = rng.normal(size=32)
    near = base + rng.normal(size=(2000, 32)) * 1e-3  # all but equal
    v = np.concatenate([far, near]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got: dict[int, set] = {}
    for r in neighbours.nearest_neighbours(spark, df, "id % 25 = 0").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    for group in (range(0, 500, 25), range(500, 2500, 25)):
        hits = 0
        for q in group:
            score = u @ u[q]
            score[q] = -9
            hits += len(got[q] & set(np.argsort(-score)[:5].tolist()))
        assert hits >= 0.9 * 5 * len(group), (hits, 5 * len(group))
