from __future__ import annotations

import hashlib
import random
import zlib

from loomspark.llm.q_trie import register
from loomspark.llm.store import Scratch
from loomspark.llm.trie import build, number
from loomspark.registry import Registry

SHAPE = "conv_id long, turn long, role string, text string, band int, depth string"


def in_order(rows):
    """Turns by conversation, as (role, text)."""
    convs: dict[int, list] = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(ts)] for c, ts in convs.items()}


def by_hand(convs):
    nodes: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids: dict[tuple, list] = {k: [] for k in nodes}
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    out = {}

    def roll(k):
        below = [roll(x) for x in kids[k]]
        own = (len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0
        saved, leaves = own + sum(x[0] for x in below), sum(x[1] for x in below) or 1
        ends = ",".join(str(c) for c in sorted(nodes[k]) if len(convs[c]) == len(k))
        parent = min(nodes[k[:-1]]) if k else None
        out[min(nodes[k]), len(k)] = (parent, len(nodes[k]), len(kids[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        return saved, leaves

    if nodes:
        roll(())
    return out


def got(df):
    rows = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    out = {(r[0], r[1]): tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


def some_rows(rng, n):
    rows = []
    for c in rng.sample(range(-400, 2000), n):
        shared = rng.random() < 0.3  # a copied conversation
        for t in range(6 if shared else rng.randrange(1, 12)):
            text = f"t{t}" if shared else rng.choice(["", "a", "é", None, "bb"])
            rows.append((c, rng.choice([t, t, None]) if not shared else t, rng.choice(["user", None]) if not shared else "user", text, 1, "x"))
    return rows + rng.sample(rows, 5) + [(None, 1, "user", "nobody's", 1, "x")]


def test_tries_match_plain_prefixes(spark):
    rng = random.Random(7)
    rows = some_rows(rng, 150)
    rows += [(5000, t, "user", f"long {t}", 0, None) for t in range(700)]  # more turns than a partition holds
    rows += [(5001, t, "user", f"long {t}" if t != 20 else "else", 0, None) for t in range(30)]
    rng.shuffle(rows)
    scratch = Scratch(spark, "test")
    turns = scratch.keep(number(scratch, spark.createDataFrame(rows, SHAPE).repartition(5)), "turns")
    convs = in_order(rows)
    places = {(r["conv_id"], r["pos"]): (r["size"], r["before"]) for r in turns.collect()}
    want = {(c, d + 1): (len(t[1].encode()), sum(len(x[1].encode()) for x in ts[:d])) for c, ts in convs.items() for d, t in enumerate(ts)}
    assert places == want
    assert got(build(scratch, turns.select("conv_id"), turns)) == by_hand(convs)


def test_turnless_and_equal_conversations(spark):
    scratch = Scratch(spark, "test")
    ids = spark.createDataFrame([(c,) for c in (3, 1, 2, 1)], "conv_id long")
    none = number(scratch, spark.createDataFrame([], SHAPE))
    assert got(build(scratch, ids, none)) == by_hand({1: [], 2: [], 3: []})
    assert got(build(scratch, ids.limit(0), none)) == {}
    copies = [(c, t, "user", f"turn {t}", 0, None) for c in range(700) for t in range(3)]  # more ids than one block of ends
    turns = number(scratch, spark.createDataFrame(copies + [(9999, 0, "user", "turn 0", 0, None)], SHAPE))
    every = spark.createDataFrame([(c,) for c in [*range(700), 9999, 10000]], "conv_id long")
    convs = {c: [("user", f"turn {t}") for t in range(3)] for c in range(700)} | {9999: [("user", "turn 0")], 10000: []}
    assert got(build(scratch, every, turns)) == by_hand(convs)


def test_query_borrows_beginnings(spark, tmp_path):
    rows = some_rows(random.Random(3), 60)
    spark.createDataFrame(rows, SHAPE).drop("band").write.parquet(f"{tmp_path}/conversations.parquet")
    convs, new = in_order(rows), {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        lender = c - (c % 5 if c >= 0 else -(-c % 5))  # the remainder has the sign of c
        new[c] = convs.get(lender, [])[:h] + turns[h:]
    llm = Registry()
    register(llm)
    assert got(llm.functions()["op13_prefix_trie"](spark, str(tmp_path))) == by_hand(new)
