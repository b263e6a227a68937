"""The pipeline, stage by stage against plain loops, and as a whole on tables with nulls, repeats, and nothing."""

from __future__ import annotations

import random

import corpus_pipeline as P
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.test_groups import corpus

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
STAGES = dict(P.STAGES)


def some_docs():
    """Ordinary, near-duplicate and repeating texts, and some with words that only toxic ones have."""
    rng = random.Random(21)
    rows = [(i, t or "", "en", "web", len(t or "")) for i, t, _ in corpus(rng, 100)]
    slurs = [f"vilewordnumber{k} hatefulphrase{k}" for k in range(3)]
    for i in range(60):
        words = rng.choices([f"w{k}" for k in range(4000)], k=40)
        words[5:5] = [rng.choice(slurs)] * 4
        rows.append((5000 + i, " ".join(words), "en", "web", 0))
    letters = str.maketrans("0123456789", "abcdefghij")  # digits are no words to the toxicity stage
    return [(i, t.translate(letters), lang, source, len(t)) for i, t, lang, source, _ in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    tmp = str(tmp_path_factory.mktemp("pipeline"))
    rows = some_docs()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp}/documents.parquet")
    labels = [(i, int(i % 3 > 0), int(i >= 5000)) for i, *_ in rows if i % 2 == 0]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp}/labels.parquet")
    return tmp


def stage(spark, name, rows, folder):
    out = STAGES[name](spark, spark.createDataFrame(rows, DOCS), folder)
    if name != "packing":
        assert out.columns == list(P.COLUMNS)
    return out.collect()


def test_toxic_documents_go(spark, folder):
    rows = some_docs()
    left = {r["doc_id"] for r in stage(spark, "toxicity", rows, folder)}
    clean, toxic = {r[0] for r in rows if r[0] < 5000}, {r[0] for r in rows if r[0] >= 5000}
    assert len(left & clean) >= 0.95 * len(clean) and len(left & toxic) <= 0.1 * len(toxic)


def test_one_of_each_group_stays(spark, folder):
    rows = some_docs()
    sets = {}
    for i, t, *_ in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    group = {i: i for i in sets}
    order = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in order:
            for b in order:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    want = {i for i in sets if group[i] == i}
    got = stage(spark, "near_duplicates", [*rows, rows[3], (None, "alone", None, None, None)], folder)
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(want) and sum(r["doc_id"] is None for r in got) == 1


def test_repeated_passages_go(spark, folder):
    rows = some_docs()
    seen, want = set(), {}
    for i, t, *_ in sorted(rows):
        w = t.split()
        cut = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                cut[k : k + 20] = [True] * 20
            seen.add(key)
        kept = [x for x, c in zip(w, cut, strict=True) if not c]
        if kept or not any(cut):
            want[i] = kept
    got = {r["doc_id"]: r for r in stage(spark, "passages", rows, folder)}
    assert {i: r["text"].split() for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_good_documents_stay_and_sources_are_weighed(spark, folder):
    rows = some_docs()
    got = [r["doc_id"] for r in stage(spark, "mixing", rows, folder)]
    assert len(got) == len(set(got)) and set(got) <= {r[0] for r in rows}
    assert 0.5 * len(rows) < len(got) <= len(rows)
    none = spark.createDataFrame([], LABELS)
    none.write.mode("overwrite").parquet(f"{folder}/none/labels.parquet")
    assert len(stage(spark, "mixing", rows, f"{folder}/none")) == len(rows)  # without labels there is nothing to weigh


def test_every_token_is_packed_once(spark, folder):
    rows = some_docs()[:60]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got: dict[int, int] = {}
    for r in stage(spark, "packing", rows, folder):
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x, *_ in rows}


def test_whole_run_with_nulls_and_without_rows(spark, folder, tmp_path):
    rows = [*some_docs()[:80], (None, None, None, None, None), (None, "no id", "en", "web", 5), (3, "said twice", None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(0, None, None), (None, 1, 1)], LABELS).write.parquet(f"{tmp_path}/a/labels.parquet")
    out = P.run(spark, f"{tmp_path}/a").collect()
    assert out and all(0 <= r["offset"] and r["offset"] + r["length"] <= 4096 for r in out)
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/b/labels.parquet")
    assert P.run(spark, f"{tmp_path}/b").count() == 0
