"""Prefix tries over conversations, built and rolled up level by level.

``number`` gives every turn its place in its conversation: one range partitioning
by conversation and turn, places counted inside each partition, and for the few
conversations that reach over a partition's edge the rows of the partitions before
it are added. A conversation of any length is spread over tasks, never gathered.

``build`` makes the trie. Equal conversations are one member with a weight, so a
copied one is one row. Then, depth by depth, the live members are grouped by
(parent node, next turn); the smallest conversation id of a group names the node. A
member that is alone in its node is no longer live: the rest of its turns is a
path, written down at once. So there are as many levels as the deepest prefix that two
different conversations share has turns. Levels are then joined from the deepest up: a
node's children sum up its leaves and savings.

Turns are compared by SHA-256 of role and text, whole conversations by 128 bits over
the digests of their turns. The list of a node's ends is hashed in blocks of ids:
a common conversation's blocks are streamed through one hash in order, as SHA-256
can't be put together from parts; what streams there is ids, never held at once.

Defined results
* null role or text: empty; null turn: first; ties in turn go by role, then text;
  repeated rows are repeated turns. Rows without a conversation id take no part.
* a conversation without turns (``build`` gets all ids by themselves) ends at the root.
* empty table: no nodes, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.llm.store import Scratch

#: Leading characters of a text that deal turns of one place and role to partitions.
_HEAD = 32
#: Ids of one block of ends: 2**8.
_BLOCK_BITS = 8


def number(scratch: Scratch, turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, pos, key, size, before): places from 1, digests, UTF-8 bytes, bytes before."""
    empty = F.lit("")
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role"]
    dealt = rows.withColumn("head", F.left("text", F.lit(_HEAD))).repartitionByRange(*order, "head").sortWithinPartitions(*order, "text")
    # The length of the role keeps (ab, c) apart from (a, bc).
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    placed = dealt.select(
        "conv_id",
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("seq"),
        digest.alias("key"),
        F.octet_length("text").cast("long").alias("size"),
    )
    placed = scratch.keep(placed, "trie-placed")  # a second run might draw other bounds
    runs = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    # At most one conversation crosses each edge of two partitions: a bounded list, and a bounded broadcast.
    cut = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n", "bytes"))).alias("runs")).where(F.size("runs") > 1)
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut.select("conv_id", F.inline("runs")).select(
        "conv_id",
        "part",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("more"),
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("more_bytes"),
    )
    here = W.partitionBy("conv_id", "part").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    local = placed.withColumns({"r": F.count("*").over(here), "through": F.sum("size").over(here)})
    return local.join(F.broadcast(offsets), ["conv_id", "part"], "left").select(
        "conv_id",
        (F.col("r") + F.coalesce("more", F.lit(0))).alias("pos"),
        "key",
        "size",
        (F.col("through") - F.col("size") + F.coalesce("more_bytes", F.lit(0))).alias("before"),
    )


def _stream_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rep, len, ids) in order -> (rep, len, ends_sha256): one running hash, whatever the number of rows."""
    now, length, running = None, None, hashlib.sha256()

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int64()), pa.array([length], pa.int64()), pa.array([running.hexdigest()])], names=["rep", "len", "ends_sha256"]
        )

    for batch in batches:
        for rep, n, ids in zip(*(batch.column(c) for c in ("rep", "len", "ids")), strict=True):
            rep, n, ids = rep.as_py(), n.as_py(), ids.as_py()
            if rep == now:
                running.update(b"," + ids.encode())
                continue
            if now is not None:
                yield done()
            now, length, running = rep, n, hashlib.sha256(ids.encode())
    if now is not None:
        yield done()


def _ends(members: DataFrame, classes: DataFrame, same: list[str]) -> DataFrame:
    """(rep, len, ends_sha256): hashed lists of the members of each class."""
    block = F.shiftright("conv_id", _BLOCK_BITS)
    listed = members.withColumn("block", block).groupBy(*same, "block").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    chunks = listed.join(classes.select(*same, "rep"), same).select(
        "rep", "len", "block", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids")
    )
    counted = chunks.groupBy("rep").agg(F.count("*").alias("n"), F.min("block").alias("block"))
    single = chunks.join(counted.where("n = 1"), ["rep", "block"]).select("rep", "len", F.sha2("ids", 256).alias("ends_sha256"))
    many = chunks.join(counted.where("n > 1").select("rep"), "rep").select("rep", "len", "ids", "block")
    streamed = many.repartition("rep").sortWithinPartitions("rep", "block").select("rep", "len", "ids")
    return single.unionByName(streamed.mapInArrow(_stream_hashes, "rep long, len long, ends_sha256 string"))


def build(scratch: Scratch, ids: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of the trie over conversations ``ids`` (conv_id) with turns as ``number`` returns them.

    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256): ids are the smallest member's; savings are bytes.
    """
    # Equal sets of (place, digest) are equal sequences; an exclusive or of hashes doesn't ask for their order.
    sums = turns.groupBy("conv_id").agg(
        F.count("*").alias("len"),
        F.bit_xor(F.xxhash64("pos", "key")).alias("a"),
        F.bit_xor(F.xxhash64("key", "pos")).alias("b"),
        F.sum("size").alias("total"),
    )
    none = F.lit(0).cast("long")
    all_sums = ids.distinct().join(sums, "conv_id", "left").select("conv_id", *[F.coalesce(c, none).alias(c) for c in ("len", "a", "b", "total")])
    members = scratch.keep(all_sums, "trie-members")
    same = ["len", "a", "b"]
    classes = scratch.keep(members.groupBy(*same).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.max("total").alias("total")), "trie-classes")
    head = classes.agg(F.min("rep").alias("rep"), F.count("*").alias("k")).first()
    shape = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not head["k"]:
        return scratch.spark.createDataFrame([], shape)
    # Places 1, 2-3, 4-7, ...: a level reads one folder.
    shared = turns.join(classes.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi").select(
        F.col("conv_id").alias("rep"), "pos", "key", "size", "before", F.floor(F.log2("pos")).cast("int").alias("band")
    )
    shared = scratch.keep(shared.sortWithinPartitions("band", "pos"), "trie-turns", by="band")

    level = classes.select(
        "rep",
        "n",
        "len",
        "total",
        none.alias("depth"),
        F.lit(None).cast("long").alias("parent"),
        F.lit(head["rep"]).cast("long").alias("node"),
        none.alias("size"),
        none.alias("through"),
        F.lit(head["k"]).cast("long").alias("k"),
    )
    levels = [level]
    for depth in count(1):
        live = levels[-1].where((F.col("k") > 1) & (F.col("len") >= depth)).select("rep", "n", "len", "total", F.col("node").alias("parent"))
        if live.isEmpty():
            break
        turn = shared.where((F.col("band") == depth.bit_length() - 1) & (F.col("pos") == depth))
        step = live.join(turn.select("rep", "key", "size", (F.col("before") + F.col("size")).alias("through")), "rep")
        nodes = step.groupBy("parent", "key").agg(F.min("rep").alias("node"), F.count("*").alias("k"))
        named = step.join(nodes, ["parent", "key"])
        level = named.select("rep", "n", "len", "total", F.lit(depth).cast("long").alias("depth"), "parent", "node", "size", "through", "k")
        levels.append(scratch.keep(level, f"trie-level-{depth}"))

    # From the deepest level up. A node of one member holds its path: one leaf, and the bytes after it in each further copy.
    rolled: list[DataFrame] = []
    for depth in range(len(levels) - 1, -1, -1):
        node = levels[depth].groupBy("node").agg(
            F.min("parent").alias("parent"),
            F.sum("n").alias("n"),
            F.max("size").alias("size"),
            F.max("k").alias("k"),
            F.max("len").alias("len"),
            F.max(F.col("total") - F.col("through")).alias("after"),
        )
        saved = (F.col("n") - 1) * F.col("size")
        alone = F.col("k") == 1
        if rolled:
            up = rolled[-1].groupBy(F.col("parent").alias("node")).agg(
                F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("s")
            )
            node = node.join(up, "node", "left")
        else:
            node = node.withColumns({"c": none, "l": none, "s": none})
        done = node.select(
            "node",
            F.lit(depth).cast("long").alias("depth"),
            "parent",
            "n",
            F.when(alone, (F.col("len") > depth).cast("long")).otherwise(F.coalesce("c", none)).alias("n_children"),
            F.when(alone, F.lit(1)).otherwise(F.coalesce("l", none)).cast("long").alias("n_leaves"),
            (saved + F.when(alone, (F.col("n") - 1) * F.col("after")).otherwise(F.coalesce("s", none))).cast("long").alias("saved"),
        )
        rolled.append(scratch.keep(done, f"trie-nodes-{depth}"))

    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    alone = every.where("k = 1").select("rep", "n", "len", "total", "depth")
    path = shared.join(alone, "rep").where("pos > depth").select(
        F.col("rep").alias("node"),
        F.col("pos").alias("depth"),
        F.col("rep").alias("parent"),
        "n",
        (F.col("pos") < F.col("len")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * (F.col("total") - F.col("before"))).cast("long").alias("saved"),
    )
    out = path
    for x in rolled:
        out = out.unionByName(x)
    # Where members end: at the node of their last turn, which an alone member's own id names.
    last = every.where("k = 1 OR len = depth").select("rep", F.when(F.col("k") == 1, F.col("rep")).otherwise(F.col("node")).alias("node"))
    ends = _ends(members.select("conv_id", *same), classes, same).join(last, "rep").select("node", F.col("len").alias("depth"), "ends_sha256")
    return out.join(ends, ["node", "depth"], "left").select(
        F.col("node").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
