"""The stored index: its stems, its postings, what a query reads of it, and that it follows its source."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from loomspark.functions.stemming import fold_accents, stem, stem_terms
from loomspark.operators import inverted as I
from loomspark.operators import retrieval as R

# Pairs from the published description of the algorithm.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
    "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "conformabli": "conform",
    "radicalli": "radic", "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic",
    "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal",
    "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr",
    "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust",
    "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog",
    "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    "caching": "cach", "cache": "cach", "is": "is", "x": "x", "": "",
}

WORDS = ["cache", "Caching", "cached", "café", "cafe", "naïve", "über", "nvidia-smi", "torch.compile", "the", "缓存", "Ångström", "ship", "ships"]


def test_stems():
    import pyarrow as pa

    assert {w: stem(w) for w in STEMS} == STEMS
    assert stem_terms(pa.array(["cats", "sky", "cats"])).to_pylist() == ["cat", "sky", "cat"]


def test_accents(spark):
    texts = ["Café ÀÉÎÕÜ ñ ç", "plain", "été", "ß æ ø 缓存 κόσμος й"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fold_accents(F.col("t"))).collect()]
    assert got == ["Cafe AEIOU n c", "plain", "ete", "ß æ ø 缓存 κοσμος и"]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(30)))) for i in range(300)]
    return [*rows, (300, None), (301, ""), (302, "the " * 500)]


def index_of(spark, docs, tmp, analyzer, **kw):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return I.build(frame, "doc_id", {"text": F.col("text")}, analyzer, f"{tmp}/{analyzer.name}", folders=8, **kw)


def test_postings_match_plain_counts(spark, docs, tmp_path):
    index = index_of(spark, docs, tmp_path, I.PLAIN, slices=3)
    want = {}
    for i, t in docs:
        words = re.findall(r"[^\W_]+", (t or "").lower())
        for w in words:
            want[w, i] = (words.count(w), len(words))
    got = {(r["term"], r["id"]): (r["tf"], r["dl"]) for r in spark.read.parquet(f"{index.path}/postings").collect()}
    assert got == want
    df = {r["term"]: (r["df"], r["cf"]) for r in index.vocabulary(["the", "cafe"]).collect()}
    for t, counts in df.items():
        assert counts == (sum(w == t for w, _ in want), sum(n for (w, _), (n, _) in want.items() if w == t))
    assert index.stats().first().asDict() == {"field": "text", "n": len(docs), "total": sum(n for n, _ in want.values())}


def test_scores_are_those_of_a_full_scan(spark, docs, tmp_path):
    index = index_of(spark, docs, tmp_path, I.PLAIN)
    frame = spark.createDataFrame([d for d in docs if d[1] is not None], "doc_id long, text string")
    index = I.build(frame, "doc_id", {"text": F.col("text")}, I.PLAIN, f"{tmp_path}/again", folders=8)
    terms = ["the", "cache", "ships", "nothing"]
    want = R.bm25(frame, terms, 1000, "doc_id", "text").collect()
    got = I.match(index, terms, mode="any").orderBy(F.desc("score"), "id").collect()
    assert [(r["id"], r["score"]) for r in got] == [(r["doc_id"], r["score"]) for r in want]
    scope = frame.where("doc_id % 7 = 0").select(F.col("doc_id").alias("id"))
    inside = I.match(index, terms, mode="any", scope=scope).collect()
    assert {(r["id"], r["score"]) for r in inside} == {(r["doc_id"], r["score"]) for r in want if r["doc_id"] % 7 == 0}


def test_stems_prefixes_and_modes(spark, docs, tmp_path):
    prose = index_of(spark, docs, tmp_path, I.PROSE)
    ids = lambda df: {r["id"] for r in df.collect()}
    holding = lambda *ws: {i for i, t in docs if t and all(any(w in re.split(r"[^\w.-]+", t) for w in group) for group in ws)}
    family = ("cache", "Caching", "cached")
    assert ids(I.match(prose, ["CACHES"])) == holding(family)
    assert ids(I.match(prose, ["café"])) == ids(I.match(prose, ["CAFE"])) == holding(("café", "cafe"))
    assert ids(I.match(prose, ["ship", "naive"])) == holding(("ship", "ships"), ("naïve",))
    assert ids(I.match(prose, ["ca"], expand=True)) == set() and ids(I.match(prose, ["caf"], expand=True)) == holding(("café", "cafe"))
    assert ids(I.match(prose, ["ang", "ub"], mode="any", expand=True)) == holding(("Ångström",))
    assert ids(I.match(prose, [])) == ids(I.match(prose, ["!?"])) == set()
    screen = index_of(spark, docs, tmp_path, I.SCREEN)
    assert ids(I.match(screen, ["NVIDIA-smi"])) == holding(("nvidia-smi",)) and not ids(I.match(screen, ["smi"]))
    assert ids(I.match(screen, ["缓"], expand=True)) == set() and I.expands("缓存") and not I.expands("go")
    with pytest.raises(ValueError, match="characters"):
        prose.postings(prefixes=["c"])


def test_a_query_reads_its_own_folders(spark, docs, tmp_path):
    index = index_of(spark, docs, tmp_path, I.PLAIN)
    plan = I.match(index, ["cache", "ship"], mode="any")._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "tf" in x)
    wanted = sorted({I.folder_of("cache", 8), I.folder_of("ship", 8)})
    assert re.search(r"PartitionFilters: \[.*folder#\d+ IN \(" + ",".join(map(str, wanted)) + r"\)", scan), scan
    assert "In(term, [cache,ship])" in scan and "text" not in scan.split("ReadSchema")[1]


def test_an_index_follows_its_source(spark, tmp_path):
    source = f"{tmp_path}/t.parquet"
    put = lambda rows: spark.createDataFrame(rows, "id long, t string").coalesce(1).write.mode("overwrite").parquet(source)
    opened = lambda: I.open_or_build(spark, source, "id", {"t": F.col("t")}, I.PLAIN)
    put([(1, "old words")])
    first = opened()
    assert opened().path == first.path and first.postings(["old"]).count() == 1
    put([(1, "new words"), (2, "more new words")])
    second = opened()
    assert second.path != first.path and second.postings(["new"]).count() == 2 and second.postings(["old"]).count() == 0


def test_a_batch_is_counted_in_runs_of_whole_rows(monkeypatch):
    """However many words a batch of rows holds, a worker counts a few of them at a time; one long text is a run of its own."""
    import pyarrow as pa

    monkeypatch.setattr(I, "WORDS_AT_ONCE", 10)
    texts = [["a", "b", "a"]] * 9 + [["c"] * 25] + [["b"]] * 12
    batch = pa.RecordBatch.from_arrays([pa.array(["t"] * len(texts)), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["field", "id", "w"])
    out = list(I._count_terms(False)(iter([batch.slice(1)])))
    assert [r for b in out for r in b.to_pylist()] == [
        {"field": "t", "term": w, "id": i, "tf": t.count(w), "dl": len(t)} for i, t in enumerate(texts) if i for w in sorted(set(t), key=t.index)
    ]
    assert len(out) == 6 and max(b.num_rows for b in out) == 10


def test_slices_grow_with_the_source(spark, tmp_path, monkeypatch):
    """A task sorts one folder of one slice, and a slice holds so many bytes of source: more source, more slices."""
    spark.createDataFrame([(i, f"the words of {i}") for i in range(4000)], "id long, t string").write.parquet(f"{tmp_path}/t.parquet")
    made = []
    monkeypatch.setattr(I, "build", lambda *args: made.append(args[-1]))
    size = I.Files(spark).size(f"{tmp_path}/t.parquet")
    monkeypatch.setattr(I.Files, "size", lambda self, path: size * 200_000)  # as much as a table of gigabytes
    I.open_or_build(spark, f"{tmp_path}/t.parquet", "id", {"t": F.col("t")}, I.PLAIN)
    assert made[0] >= size * 200_000 // (256 << 20) >= 20
