"""Near-duplicate documents by MinHash bands, odd sketches and a final count on full sets.

1. Tasks make each document's set of word shingles, ``SAMPLES`` MinHash samples
   of it for bands, and an odd sketch: one-permutation MinHash samples, the
   smallest hash of each of ``BINS`` ranges, folded into a bitmap of parities.
   Two sketches' XOR counts the samples that differ, most precisely where few do.
2. Equal sets become one class, of which the smallest id stands for all.
3. A band bucket links its members to its smallest id, a star and not all pairs.
   Stars that the sketches allow are confirmed on the full sets and joined to
   components.
4. Where a bucket still holds several components, tasks compare its members by
   sketch across components and send on a spanning forest of the pairs that are
   near enough: at most one row for each member, and every member that has such a
   pair is in it, together with its partners.
5. The forests' components are groups that hold all open pairs. Tasks compare a
   group's members by sketch, then on full sets, join them as they go and send on
   the confirmed links that joined two components: fewer than there are members.
   No link between different texts that share a bucket is lost.

Buckets and groups over a task's bound (``BLOCK`` members, ``GROUP`` set elements)
are dealt over tasks as pairs of blocks. Two documents at the threshold share no
bucket with probability ``(1 - 0.8**ROWS)**BANDS``, here 5e-6; a sketch underrates
such a pair by the margin with about as small a probability. Sets hold 61-bit
fingerprints of shingles: two sets of a thousand words differ from their true
intersection with probability 4e-13.

Joins of many rows with one key, a bucket or a component, have one row for that
key on the other side and count on Spark's handling of skewed joins.

Defined results
* null text, or a text without words: the empty set, linked with nothing.
* fewer words than a shingle has: all its words are the one shingle.
* rows that share an id are one node with several sets; a null id has no links,
  ``component_id`` null and stays.
* empty table: no rows. The result has a row for each row and no other columns;
  a caller joins it or filters by it.
* components that are not settled after ``STEPS`` rounds, each of which halves
  the longest path or better, raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.store import Scratch
from loomspark.llm.words import blocks, mix

BANDS, ROWS = 40, 6
SAMPLES = BANDS * ROWS
#: One-permutation samples of an odd sketch, and its bits.
BINS, BITS = 1024, 4096
#: How far below the threshold a sketch's estimate may lie, about five standard deviations at 0.8, and samples on top for tiny sets.
MARGIN, SLACK = 0.07, 3
#: Members of a bucket that one task compares with as many others, by sketch.
BLOCK = 8000
#: Set elements of a group that one task compares with as many others.
GROUP = 2_000_000
#: Shingles whose samples are drawn at once.
CHUNK = 100_000
TEXT_BYTES = 1_000_000
STEPS = 60

_U = np.uint64
_RNG = np.random.default_rng(6)
_A = _RNG.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32)


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, hashes, edges): text from + i has the distinct, sorted hashes[edges[i]:edges[i+1]]."""
    for lo, hi, b in blocks(column, TEXT_BYTES, lower=True):
        hashes, _, owner = b.windows(words)
        count = np.diff(b.edges)
        short = np.flatnonzero((count > 0) & (count < words)).tolist()
        if short:
            whole = b"".join(b.digest(b.edges[i], b.edges[i + 1])[:8] for i in short)
            hashes, owner = np.r_[hashes, np.frombuffer(whole, "<u8")], np.r_[owner, short]
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])] if len(hashes) else np.zeros(0, bool)
        hashes, owner = hashes[new], owner[new]
        yield lo, hi, hashes, np.searchsorted(owner, np.arange(hi - lo + 1))


def samples(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """MinHash samples, one row for each nonempty text."""
    full = np.flatnonzero(np.diff(edges))
    out = np.empty((len(full), SAMPLES), np.uint32)
    x = (hashes >> _U(32)).astype(np.uint32)
    starts = edges[full]
    at = 0
    while at < len(full):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK)))
        stop = edges[full[end - 1] + 1]
        part, heads = x[starts[at] : stop], starts[at:end] - starts[at]
        for k in range(SAMPLES):
            out[at:end, k] = np.minimum.reduceat(part * _A[k] + _B[k], heads)
        at = end
    return out


def bands(mins: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each band, telling bands apart."""
    out = np.empty((len(mins), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(mins), b + 1, np.uint64)
        for r in range(ROWS):
            h = mix(h * _U(0x9E3779B97F4A7C15) + mins[:, b * ROWS + r].astype(np.uint64))
        out[:, b] = h
    return out


def odd_sketches(hashes: np.ndarray, edges: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Parity bitmaps, and how many samples each has: bins without a shingle have none."""
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    bins = (hashes >> _U(54)).astype(np.int64)
    # Hashes are sorted inside a text, so the first of a bin is its smallest.
    head = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (bins[1:] != bins[:-1])]) if len(text) else np.zeros(0, np.int64)
    text, bit = text[head], (mix(hashes[head] ^ _U(0xA5A5A5A5)) % _U(BITS)).astype(np.int64)
    out: list[bytes] = []
    for at in range(0, len(edges) - 1, 1024):
        n = min(1024, len(edges) - 1 - at)
        a, b = np.searchsorted(text, [at, at + n])
        flips = np.bincount((text[a:b] - at) * BITS + bit[a:b], minlength=n * BITS)
        out += [r.tobytes() for r in np.packbits((flips & 1).astype(np.uint8).reshape(n, BITS), axis=1)]
    return out, np.bincount(text, minlength=len(edges) - 1)


def near_enough(differ: np.ndarray, size_a, size_b, drawn_a, drawn_b, percent: int) -> np.ndarray:
    """May sets of these sizes, with so many samples of which so many bits differ, be as similar as ``percent``?"""
    low = percent / 100 - MARGIN
    union = (size_a + size_b) / (1 + low)
    bins = BINS * (1 - np.exp(-union / BINS))
    most = drawn_a + drawn_b - 2 * low * bins + SLACK
    apart = -BITS / 2 * np.log(np.maximum(1 - 2 * differ / BITS, 1e-9))
    return (apart <= most) & (100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b))


def _digests(hashes: np.ndarray, edges: np.ndarray) -> list[bytes | None]:
    """128 bits for each set; none for the empty one."""
    pairs = zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)
    return [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in pairs]


def sign(docs: DataFrame, words: int) -> DataFrame:
    """(id, n_shingles, digest, bands, sketch, drawn) for each row of (id, text)."""
    names = ["id", "n_shingles", "digest", "bands", "sketch", "drawn"]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, hashes, edges in shingle_sets(batch.column("text"), words):
                n = np.diff(edges)
                keys = bands(samples(hashes, edges)).view(np.int64)
                sketch, drawn = odd_sketches(hashes, edges)
                digest = _digests(hashes, edges)
                has = np.zeros(hi - lo + 1, np.int32)
                has[1:] = np.cumsum(n > 0) * BANDS
                held = pa.ListArray.from_arrays(pa.array(has), pa.array(keys.reshape(-1)), mask=pa.array(n == 0))
                columns = [batch.column("id")[lo:hi], pa.array(n), pa.array(digest, pa.binary()), held, pa.array(sketch, pa.binary()), pa.array(drawn)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(signed, "id long, n_shingles long, digest binary, bands array<long>, sketch binary, drawn long")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, digest, shingles) for each row of (id, text)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, hashes, edges in shingle_sets(batch.column("text"), words):
                held = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(hashes.view(np.int64)))
                digest = pa.array(_digests(hashes, edges), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id")[lo:hi], digest, held], names=["id", "digest", "shingles"])

    return docs.mapInArrow(made, "id long, digest binary, shingles array<long>")


def near_by_sketch(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches allow the similarity."""
    side = lambda c: signed.select(
        F.col("id").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n_shingles").alias(f"n{c}"), F.col("drawn").alias(f"d{c}")
    )

    def close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                a, b = (np.frombuffer(b"".join(f[c]), np.uint64).reshape(len(f), -1) for c in ("sa", "sb"))
                differ = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
                n = [f[c].to_numpy(float) for c in ("na", "nb", "da", "db")]
                yield f.loc[near_enough(differ, *n, percent), ["a", "b"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(close, "a long, b long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on full sets."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"__{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    small, large = F.least(F.size("__a"), F.size("__b")), F.greatest(F.size("__a"), F.size("__b"))
    same = F.size(F.array_intersect("__a", "__b"))
    return (
        both.where(100 * small >= percent * large)  # sizes alone rule out the rest
        .where(100 * same >= percent * (F.size("__a") + F.size("__b") - same))
        .select("a", "b")
        .distinct()
    )


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(id, root): each node of ``edges`` (a, b) with the smallest id it reaches.

    Stars are rewritten towards smaller ids until nothing changes; every round is
    a written table.
    """
    now = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0"
    )
    for k in range(1, STEPS):
        # Large star: all larger neighbours of a node to its smallest one.
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: all smaller neighbours of a node, and itself, to the smallest one.
        large = scratch.keep(large.where("a <> b").distinct(), f"{name}-{k}l")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        after = (
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        after = scratch.keep(after, f"{name}-{k}")
        same = after.join(now, ["a", "b"], "left_anti").isEmpty() and now.join(after, ["a", "b"], "left_anti").isEmpty()
        scratch.drop(f"{name}-{k}l")
        if same:
            break
        scratch.drop(f"{name}-{k - 1}")
        now = after
    else:
        raise RuntimeError(f"components are not settled after {STEPS} rounds")
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def dealt(rows: DataFrame, key: str, size: Column, seed: int, tasks: int) -> DataFrame:
    """Rows of a key in blocks, so many as ``size`` says; a row goes to each pair (i, j) of its own block and another."""
    out = rows.withColumn("blocks", F.greatest(F.ceil(size), F.lit(1)).cast("int"))
    out = out.withColumn("mine", F.pmod(F.xxhash64("id", F.lit(seed)), "blocks").cast("int"))
    out = out.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    out = out.withColumn("i", F.least("mine", "theirs")).withColumn("j", F.greatest("mine", "theirs"))
    return out.drop("blocks", "theirs").repartition(tasks, key, "i", "j").sortWithinPartitions(key, "i", "j")


def _keyed(frames: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of one key after another; the last of a frame may go on in the next."""
    rest: list[pd.DataFrame] = []
    for f in frames:
        if not len(f):
            continue
        k = f[key].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(f)], strict=True):
            part = f.iloc[a:b]
            if rest and (rest[0][key].iloc[0].to_numpy() != k[a]).any():
                yield pd.concat(rest) if len(rest) > 1 else rest[0]
                rest = []
            rest.append(part)
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


class _Block:
    """Members of a key's blocks i and j: which others may x be linked with?"""

    def __init__(self, g: pd.DataFrame, percent: int) -> None:
        self.ids, self.label = g["id"].to_numpy(), g["root"].to_numpy().copy()
        self.sketch = np.frombuffer(b"".join(g["sketch"]), np.uint64).reshape(len(g), -1)
        self.size, self.drawn = g["n_shingles"].to_numpy(float), g["drawn"].to_numpy(float)
        self.percent = percent
        mine = g["mine"].to_numpy()
        self.left, self.right = np.flatnonzero(mine == g["i"].iloc[0]), np.flatnonzero(mine == g["j"].iloc[0])

    def near(self, x: int, others: np.ndarray) -> np.ndarray:
        differ = np.bitwise_count(self.sketch[others] ^ self.sketch[x]).sum(1, dtype=np.int64)
        return others[near_enough(differ, self.size[others], self.size[x], self.drawn[others], self.drawn[x], self.percent)]

    def join(self, x: int, y: int) -> tuple[int, int]:
        self.label[self.label == self.label[y]] = self.label[x]
        return min(self.ids[x], self.ids[y]), max(self.ids[x], self.ids[y])


def open_pairs(spark: SparkSession, members: DataFrame, roots: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Of pairs that share a bucket, are of different components and near by sketch: a spanning forest for each pair of blocks."""
    placed = (
        members.join(roots, "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
        .join(roots.select(F.col("id").alias("leader"), F.col("root").alias("top")), "leader", "left")
        .withColumn("top", F.coalesce("top", "leader"))
    )
    apart = placed.where("root <> top").select("bucket").distinct()
    rows = placed.join(apart, "bucket", "left_semi").join(signed.select("id", "sketch", "n_shingles", "drawn"), "id")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = dealt(rows.drop("leader"), "bucket", F.col("n") / BLOCK, 0, tasks)

    def forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _keyed(frames, ["bucket", "i", "j"]):
            b = _Block(g, percent)
            root, minor = g["root"].to_numpy(), (g["root"] != g["top"]).to_numpy()
            b.label = np.arange(len(g))  # of the forest so far
            out = []
            # Each pair has a member outside the leader's component; from there it is looked at.
            for x in np.flatnonzero(minor).tolist():
                side = b.right if g["mine"].iloc[x] == g["i"].iloc[0] else b.left
                for y in b.near(x, side[(root[side] != root[x]) & (b.label[side] != b.label[x])]).tolist():
                    if b.label[x] != b.label[y]:
                        out.append(b.join(x, y))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return spread.mapInPandas(forest, "a long, b long").distinct()


def linked_in_groups(spark: SparkSession, groups: DataFrame, roots: DataFrame, signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), confirmed on full sets, that join the components of each group (id, root as ``group``)."""
    rows = (
        groups.join(roots, "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
        .join(signed.select("id", "sketch", "n_shingles", "drawn", "digest"), "id")
        .join(sets, ["id", "digest"])
    )
    sizes = groups.join(signed.groupBy("id").agg(F.sum("n_shingles").alias("n")), "id").groupBy("group").agg(F.sum("n").alias("total"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = dealt(rows.join(sizes, "group").drop("digest"), "group", F.col("total") / GROUP, 1, tasks)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _keyed(frames, ["group", "i", "j"]):
            b = _Block(g, percent)
            held = [np.asarray(s) for s in g["shingles"]]
            out = []
            for x in b.left.tolist():
                for y in b.near(x, b.right[b.label[b.right] != b.label[x]]).tolist():
                    if b.label[x] == b.label[y]:
                        continue
                    both = len(np.intersect1d(held[x], held[y], assume_unique=True))
                    if 100 * both >= percent * (len(held[x]) + len(held[y]) - both):
                        out.append(b.join(x, y))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return spread.mapInPandas(compare, "a long, b long").distinct()


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: its id, n_shingles, component_id and kept."""
    scratch = Scratch(spark, "neardup")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = scratch.keep(sign(texts, words), "signed")
    some = signed.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
    classes = scratch.keep(some.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    heads = scratch.keep(
        some.join(classes, (some["digest"] == classes["digest"]) & (some["id"] == classes["rep"]), "left_semi")
        .select("id", "digest", "n_shingles", "bands", "sketch", "drawn")
        .dropDuplicates(["id", "digest"]),
        "heads",
    )
    spread = heads.select(F.explode("bands").alias("bucket"), "id")
    shared = spread.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    shared = scratch.keep(shared, "shared")
    members = scratch.keep(spread.join(shared, "bucket"), "members")
    stars = members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    near = scratch.keep(near_by_sketch(stars, heads, percent), "near")
    met = members.select("id").distinct()
    sets = scratch.keep(full_sets(texts.join(met, "id", "left_semi"), words), "sets")
    linked = scratch.keep(confirmed(near, sets, percent), "linked")
    roots = scratch.keep(components(scratch, linked, "first"), "roots")
    pairs = scratch.keep(open_pairs(spark, members, roots, heads, percent), "pairs")
    groups = scratch.keep(components(scratch, pairs, "groups").withColumnRenamed("root", "group"), "groups")
    more = scratch.keep(linked_in_groups(spark, groups, roots, heads, sets, percent), "more")
    copies = some.join(classes, "digest").select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    everything = reduce(DataFrame.unionByName, [linked, more, copies.distinct()])
    final = scratch.keep(components(scratch, everything, "final"), "final")
    result = signed.select("id", "n_shingles").join(final, "id", "left").withColumn("component_id", F.coalesce("root", "id"))
    kept = F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    told = scratch.keep(result.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept), "result")
    scratch.drop_all_but("result")
    return told
