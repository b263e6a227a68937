from __future__ import annotations

import zlib
from array import array

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loomspark.llm.packing import best_pattern, cut_documents, generate_patterns, pack_documents, plan
from loomspark.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello  wörld's 42!", None, "", "<|endoftext|>", "日本 İstanbul", "a" * 9000, "the cat " * 7000, "it's x\x1cy\x85z"]


def ids(text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_word_ids_are_the_tokenizers():
    got = WordTokenizer(PATH).encode(TEXTS)
    assert got == [array("I", ids(t)).tobytes() for t in TEXTS]


def test_every_id_once_and_no_gaps(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x")] * 2 + [(100 + i, "word " * (i * 37 % 900), "x") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    got = pack_documents(spark, docs, PATH, 2).toPandas()
    text = dict((r[0], r[1]) for r in rows)
    for d, g in got.groupby("doc_id"):
        want = [*ids(text[d]), 2]
        times = sum(r[0] == d for r in rows)
        assert g["length"].sum() == times * len(want) and set(g["doc_tokens"]) == {len(want)}
        for r in g.itertuples():
            assert r.ids_crc32 == zlib.crc32(array("I", want[r.start : r.start + r.length]).tobytes())
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    full = got.groupby("sequence_id")["length"].sum()
    assert full.max() <= 4096 and full.sum() > 0.93 * 4096 * len(full)
    assert cut_documents(docs, PATH, 2, with_ids=True).where("doc_id = 0").first()["ids"] == [*ids(TEXTS[0]), 2]
    assert pack_documents(spark, docs.limit(0), PATH, 2).count() == 0


def test_program_is_near_its_bound():
    value = np.zeros(11)
    value[[3, 4]] = [0.3, 0.42]
    worth, count = best_pattern(value, 10)
    assert round(worth, 9) == 1.02 and count[3] == 2 and count[4] == 1
    rng = np.random.default_rng(1)
    demand = np.bincount(rng.integers(1, 65, 20_000), minlength=65)
    patterns, used, bound = generate_patterns(demand, 64)
    assert (sum(p * u for p, u in zip(patterns, used, strict=True))[1:] >= demand[1:] - 1e-6).all()
    made = plan(demand, 64)
    assert bound <= made.sequences <= 1.01 * bound + 2
    given = np.zeros(65, int)
    for w, a, b, _, _ in made.slots:
        given[w] += b - a
    assert (given == demand).all()


def packed(spark, rows):
    """Pieces by sequence: every document's tokens once, no gaps; returns the part of the room that is filled."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pack_documents(spark, docs, PATH, 2).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    t = Tokenizer.from_file(PATH)
    size = {x: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in {x for _, x in rows}}
    assert got["length"].sum() == sum(size[x] for _, x in rows) and len(got) >= len(rows)
    full = got.groupby("sequence_id")["length"].sum()
    assert full.max() <= 4096 and sorted(full.index) == list(range(len(full)))
    return len(full), -(-int(full.sum()) // 4096)


def test_short_documents_leave_little_padding(spark):
    tiny = [(i, [None, "", "hello", "a b c"][i % 4]) for i in range(16_000)]
    words = [(i, "w " * (1 + i % 7)) for i in range(9_000)]
    # Long ones leave room that short ones fill.
    mixed = [(i, "word " * (1500 + i % 700)) for i in range(60)] + [(1000 + i, "w " * (i % 60)) for i in range(3000)]
    for rows in (tiny, words, mixed):
        got, least = packed(spark, rows)
        assert got <= 1.02 * least + 1, (got, least)
