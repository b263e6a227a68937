"""Operators that judge one text at a time."""

from __future__ import annotations

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspark.llm import language, licenses, mpegts, toxicity
from loomspark.llm.queries import llm


@pytest.mark.parametrize("n", [0, 1, 100, 161, 162, 163, 345, 346, 347, 32767, 32768, 32769, 99_999])
def test_stream_round_trip(n):
    data = os.urandom(n)
    s = mpegts.demux(mpegts.mux(data))
    assert s.payload == data and s.counter_errors == 0 and len(s.pts) == max(1, -(-n // mpegts.PES_BYTES))
    assert s.access_points[0] == (2, mpegts.CLOCK_HZ)


def test_stream_columns_and_damage(spark):
    rows = spark.createDataFrame([(1, bytearray(b"abc" * 100)), (2, None)], "id long, media binary")
    made = mpegts.read_streams(mpegts.with_streams(rows, "media", "ts"), "ts").orderBy("id").collect()
    assert bytes(made[0]["stream"]["payload"]) == b"abc" * 100 and made[0]["stream"]["error"] is None
    assert made[1]["ts"] is None
    whole = mpegts.mux(os.urandom(200_000))
    lost = whole[: 188 * 50] + whole[188 * 51 :]
    with pytest.raises(mpegts.BadStream):
        mpegts.demux(lost)
    with pytest.raises(mpegts.BadStream):
        mpegts.demux(whole[:188] + bytes([whole[188] ^ 1]) + whole[189:])
    assert mpegts.read_streams(rows.limit(0), "media").count() == 0


def test_damaged_streams_never_raise_anything_else():
    rng = random.Random(5)
    for _ in range(4000):
        b = bytearray(mpegts.mux(rng.randbytes(rng.choice([0, 5, 200, 900]))))
        for _ in range(rng.randrange(1, 6)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        if rng.random() < 0.2:
            at = rng.randrange(len(b) // 188) * 188
            del b[at : at + 188]
        try:
            mpegts.demux(bytes(b), salvage=True)
        except mpegts.BadStream:
            pass


def test_what_is_whole_in_a_damaged_stream_is_returned(spark):
    data = os.urandom(200_000)
    whole = mpegts.mux(data)
    lost = whole[: 188 * 50] + whole[188 * 51 :]  # inside the first of seven elementary packets
    s = mpegts.demux(lost, salvage=True)
    assert s.payload == data[mpegts.PES_BYTES :] and s.counter_errors == 1 and s.damaged == 1 and len(s.pts) == 6
    twice = whole[: 188 * 51] + whole[188 * 50 : 188 * 51] + whole[188 * 51 :]  # a packet may be sent twice
    assert mpegts.demux(twice).payload == data and mpegts.demux(twice).counter_errors == 0
    rows = spark.createDataFrame([(1, bytearray(lost))], "id long, media binary")
    read = mpegts.read_streams(rows, "media").first()["stream"]
    assert read["damaged"] == 1 and read["error"] is None and bytes(read["payload"]) == s.payload


def test_a_table_over_several_packets():
    body = b"".join(n.to_bytes(2, "big") + (0xE000 | mpegts.PMT_PID).to_bytes(2, "big") for n in range(1, 101))
    section = mpegts._section(0x00, 1, body)
    parts = [b"\0" + section[:183], *(section[i : i + 184] for i in range(183, len(section), 184))]
    head = [bytes([mpegts.SYNC, 0x40 if k == 0 else 0, 0, 0x10 | k]) for k in range(len(parts))]
    tables = b"".join((h + p).ljust(188, b"\xff") for h, p in zip(head, parts, strict=True))
    assert mpegts.demux(tables + mpegts.mux(b"abc")[188:]).payload == b"abc"


def test_media_query_on_awkward_texts(spark, tmp_path):
    texts = [None, "", "a", "x" * 64, "ü" * 33, "long " * 60_000, "a"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in llm.functions()["op9_mpegts"](spark, str(tmp_path)).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media, r = mpegts.mux(payload), found[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        assert r["feature"].endswith("lost=0;damaged=0")
    assert found[2]["feature"] == found[6]["feature"]


def test_license_rules_against_plain_matching(spark):
    texts = [
        None,
        "",
        "Released under the MIT License. CC  BY-NC 4.0",
        "licensed under the apache license, version 2.0 and GNU General Public License v3 or any later",
        "SPDX-License-Identifier: BSD-3-Clause\nall rights reserved\x01 Copyright (c) 2020",
        "under the mit license under the mit license " * 30,
        "no words of law",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, licenses string")
    got = {r["id"]: [tuple(s)[:4] for s in r["licenses"]] for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        x = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").replace("\x01", " ")
        found = [
            (m.start(), m.end(), k, r.priority)
            for k, r in enumerate(licenses.RULES)
            if r.keyword in x and licenses._NAME_KEYWORD.get(r.label, r.keyword) in x
            for m in re.finditer(r.pattern, x, re.A)
        ]
        over = lambda o, d: o[0] <= d[0] and o[1] >= d[1] and o[3] >= d[3] and (o[:2] != d[:2] or o[3] > d[3] or o[2] < d[2])
        assert sorted(got[i]) == sorted(d for d in found if not any(over(o, d) for o in found if o is not d)), t
    assert len(licenses.RULES) > 300


def test_sentences_of_licenses(spark):
    told = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files",
        "apache-2": "Licensed under the Apache License, Version 2.0 (the \"License\");\n you may not use this file except in compliance with the License.",
        "bsd-3-clause": "Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software",
        "gpl-3-or-later": "either version 3 of the License, or (at your option) any later version.",
        "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this file",
        "unlicense": "This is free and unencumbered software released into the\npublic domain.",
        "cc-by-nc-sa": "https://creativecommons.org/licenses/by-nc-sa/4.0/",
        "zlib": "This software is provided 'as-is', without any express or implied\nwarranty.",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that",
    }
    df = spark.createDataFrame(list(told.items()), "label string, text string")
    got = {r["label"]: [s["label"] for s in r["licenses"]] for r in licenses.scan(df).collect()}
    assert all(label in found for label, found in got.items()), got
    assert all(re.search(re.escape(r.keyword), r.pattern.replace(r"\.", ".")) for r in licenses.RULES if r.keyword in ("software", "dedicated", "prohibited", "proprietary", "distribut"))


def test_many_detections_in_one_text(spark):
    n = 100_000
    rows = [(1, "mit license; " * n, 7), (2, "x " * n, 8)]
    out = licenses.scan(spark.createDataFrame(rows, "id long, text string, __body int"))
    began = time.monotonic()
    got = {r["id"]: (r["k"], r["last"], r["__body"]) for r in out.selectExpr("id", "size(licenses) k", "try_element_at(licenses, -1).stop last", "__body").where("id > 0").collect()}
    assert got == {1: (n, 13 * n - 2, 7), 2: (0, None, 8)} and time.monotonic() - began < 120


def test_license_gates_lose_no_match(spark):
    names = ["expat", "do what the fuck you want to public license", "bsl-1.0", "creative commons zero", "gnu general public license 2", "lesser general public license 3", "mozilla public license 2", "cc-by", "creative commons attribution-sharealike", "python software foundation"]
    forms = ["licensed under the {}", "SPDX-License-Identifier: {}", "Released\n under  the {}", "distributed  under {}", "available\tunder the {}", "under\n the terms  of the {} license", "License: {}", "{} licensed", "licence ( {} )"]
    texts = [f.format(n) for n in names for f in forms] + [
        "Redistribution and use in source and binary forms, with or without change",
        "Permission is hereby granted, free of charge, to any person",
        "Permission to use, copy, modify, and distribute this software",
        "CC\nBY  NC",
        "dedicated to the public domain",
        "Copyright  (c) 1999, under\tthis license",
    ]
    got = {r["id"]: [tuple(s)[:4] for s in r["licenses"]] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    over = lambda o, d: o[0] <= d[0] and o[1] >= d[1] and o[3] >= d[3] and (o[:2] != d[:2] or o[3] > d[3] or o[2] < d[2])
    for i, t in enumerate(texts):
        found = [(m.start(), m.end(), k, r.priority) for k, r in enumerate(licenses.RULES) for m in re.finditer(r.pattern, t.lower(), re.A)]
        assert found, t
        assert sorted(got[i]) == sorted(d for d in found if not any(over(o, d) for o in found if o is not d)), t


def test_ngram_counts_and_languages(spark):
    text = "Hello, wörld é a 42 zz9a 日本語"
    want = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f" {w} "
        want.update(w)
        want.update(padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1))
    _, gram, n = language.Counter().count([text])
    name = lambda g: "".join(" " if d == 1 else chr(d - 1) for d in (g >> 42 & 0x1FFFFF, g >> 21 & 0x1FFFFF, g & 0x1FFFFF) if d)
    assert {name(int(g)): int(c) for g, c in zip(gram, n, strict=True)} == dict(want)
    rng = random.Random(1)
    say = lambda syl: " ".join("".join(rng.choices(syl, k=rng.randint(1, 3))) for _ in range(60))
    rows = [(i, say(["an", "the", "ing"]), "en") for i in range(40)] + [(100 + i, say(["eau", "que", "oi"]), "fr") for i in range(40)]
    docs = spark.createDataFrame([*rows, (7, None, "en"), (8, "...", None), (9, "x", None)], "doc_id long, text string, lang string")
    told = language.identify(docs, language.train(docs)).collect()
    assert all(r["language"]["lang"] == r["lang"] for r in told if r["lang"] and r["text"])
    assert all(tuple(r["language"]) == ("und", 0.0) for r in told if r["text"] in (None, "..."))
    assert language.identify(docs, {}).first()["language"]["lang"] == "und"
    assert language.train(docs.limit(0)) == {}


def test_toxicity_on_unseen_documents(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices(["an", "the", "ing", "er", "on", "st", "re"], k=rng.randint(1, 4)))
    bad = ["grumpfish", "blortface", "zog"]

    def text(toxic):
        w = [word() for _ in range(120)]
        if toxic:
            for b in bad:
                w[rng.randrange(120)] = b
        return " ".join(w)

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(800)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x")], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where(toxicity.id_bucket(F.col("doc_id"), 5) != 0))
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == y for s, y in held) >= 0.97 * len(held)
    assert got[5000] == got[5001] < 0.5
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, none).agg(F.max("toxicity")).first()[0] < 1e-9


def test_toxicity_learns_rare_short_and_unspaced_segments():
    hot = [(b"   hot   ", 2000, 0)]
    rare = [(b"   rare%03d   " % i, 15, 0) for i in range(300)]
    chance = [(b"   chance   ", 3, 0)]
    counts = toxicity.pd.DataFrame(hot + rare + chance, columns=["segment", "toxic", "ordinary"])
    told = toxicity._content(counts, 2000, 4000).split(b"|")
    assert {s for s, _, _ in hot + rare} == set(told) - {b""}
    assert b"   zog   " in toxicity.segments("a zog here")
    assert "垃圾人".encode() in toxicity.segments("你是垃圾人吗")
    long = "x" * 30 + "y" * 30
    assert b"".join(s for s in (b"   " + b"x" * 24, b"x" * 6 + b"y" * 18, b"y" * 12 + b"   ") if s in toxicity.segments(long)).strip() == long.encode()


def test_toxicity_counts_copies_once(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    copied = [word() for _ in range(60)]
    rows = [(i, " ".join(copied), 1) for i in range(60)] + [(100 + i, " ".join([*(word() for _ in range(9)), "blortface", *(word() for _ in range(9))]), 1) for i in range(60)]
    rows += [(300 + i, " ".join(word() for _ in range(20)), 0) for i in range(240)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert b"blortface" in model.toxic and not any(w.encode() in model.toxic for w in copied)


def test_windows_hold_the_whole_text():
    long = "word " * 3000 + "x" * 5000
    parts = toxicity.windows(long)
    joined = parts[0] + b"".join(p[len(toxicity.GAP) :] if p.startswith(toxicity.GAP) else p for p in parts[1:])
    assert joined.replace(b" ", b"") == long.replace(" ", "").encode()
