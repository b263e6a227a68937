"""Approximate nearest neighbours by NN-descent, then greedy search in the graph.

1. Equal vectors become one node that keeps its smallest ids, as many as an
   answer can hold; so a vector that a third of all rows share is one node.
2. Random projections sort the nodes; each block of that order links its members:
   the first graph, ``DEGREE`` neighbours a node.
3. Rounds of NN-descent: a node's neighbours and some nodes that have it as a
   neighbour meet (joins on node ids), and those of a meeting that are nearer
   than their farthest neighbour so far propose themselves. Only meetings with a
   new edge count.
4. A query walks the graph from its own node and that one's neighbours: the
   nearest ``BEAM`` nodes so far, and those as near as the last of them, are expanded
   until none of them is new. What it ends with is scored on the original vectors.

Rounds compare directions as 16-bit numbers by their squared distance, worked out in double
precision and kept in single: unlike a cosine, it tells vectors apart that are all but equal.
Scores are double precision cosines. Meetings are bounded by ``DEGREE + REVERSE``, walks by ``BEAM * DEGREE``.

Defined results
* vectors that are null, zero, hold a null or non-finite component, or differ in
  size from the commonest size, take no part, as queries or answers.
* ties in score go to the smaller id; a row is no answer to a query of its id.
* repeated rows count once; ids that repeat with different vectors are answers
  for each of them.
* fewer candidates than asked for: all of them; empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.llm.store import Scratch

DEGREE = 40
REVERSE = 40
#: Proposals of one meeting for one node.
PROPOSALS = 8
ROUNDS = 4
#: Orders by random projections, and members of a block of one.
ORDERS = 4
BLOCK = 200
BEAM = 100

_EDGES = "a long, b long, near float"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows that take part, v as doubles."""
    v = F.col("v")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL").where(fine)
    size = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size(v) == (size["n"] if size else 0)).distinct()


def _bytes(v: np.ndarray) -> np.ndarray:
    """Directions as 16-bit numbers; the length is lost, as cosine doesn't need it."""
    return np.rint(v / np.abs(v).max(1, keepdims=True) * 32767).astype("<i2")


def _unit(b: np.ndarray) -> np.ndarray:
    x = b.astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _near(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distances of unit vectors, negative, so that more is nearer."""
    return (2 * (u @ v.T) - 2).astype(np.float32)


def _column(a: pa.Array, width: int) -> np.ndarray:
    """A binary column of equal lengths as rows of 16-bit numbers."""
    ends = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])), "<i2").reshape(-1, width)


def _lists(a: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    ends = a.offsets.to_numpy()
    return ends - ends[0], a.values.slice(ends[0], ends[-1] - ends[0])


def nodes(rows: DataFrame, keep_ids: int) -> DataFrame:
    """(node, v, ids): distinct vectors with their smallest ids."""
    # The rank filter works before the shuffle too: a common vector sends few rows from each task.
    rank = F.row_number().over(W.partitionBy("v").orderBy("id"))
    few = rows.withColumn("r", rank).where(F.col("r") <= keep_ids)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("node0"), "v", "ids")


def compact(distinct: DataFrame, dim: int, bits: int, seed: int) -> DataFrame:
    """(node, code, keys): 16-bit vectors, and a sort key for each order."""
    rng = np.random.default_rng(seed)
    planes, lines = rng.normal(size=(ORDERS, dim, bits)), rng.normal(size=(ORDERS, dim))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, values = b.column("v").offsets.to_numpy(), b.column("v").values.to_numpy()
            v = values[ends[0] : ends[-1]].reshape(-1, dim)
            u = v / np.linalg.norm(v, axis=1, keepdims=True)
            # Vectors of one side of every plane lie together, near ones along a line next to each other.
            keys = np.column_stack([((u @ p) > 0) @ (4.0 ** np.arange(bits)) * 4 + u @ q for p, q in zip(planes, lines, strict=True)])
            codes = pa.array([r.tobytes() for r in _bytes(v)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("node"), codes, pa.array(list(keys), pa.list_(pa.float64()))], names=["node", "code", "keys"])

    return distinct.select("node", "v").mapInArrow(made, "node long, code binary, keys array<double>")


def _edge_batch(a: np.ndarray, b: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(near, pa.float32())], names=["a", "b", "near"])


def _best(a: np.ndarray, b: np.ndarray, near: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each a's nearest, each b once."""
    order = np.lexsort((b, a))
    a, b, near = a[order], b[order], near[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    a, b, near = a[new], b[new], near[new]
    order = np.lexsort((b, -near, a))
    a, b, near = a[order], b[order], near[order]
    head = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
    rank = np.arange(len(a)) - np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))
    return a[rank < most], b[rank < most], near[rank < most]


def first_edges(points: DataFrame, order: int, parts: int, dim: int) -> DataFrame:
    """All nearest inside each block of one order."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes = np.zeros(0, np.int64), np.zeros((0, dim), np.int16)

        def linked(ids: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
            u = _unit(codes)
            near = _near(u, u)
            np.fill_diagonal(near, -9)
            k = min(DEGREE // 2, len(ids) - 1)
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            return _edge_batch(np.repeat(ids, k), ids[top].ravel(), np.take_along_axis(near, top, 1).ravel())

        for batch in batches:
            ids = np.r_[ids, batch.column("node").to_numpy()]
            codes = np.r_[codes, _column(batch.column("code"), dim)]
            while len(ids) >= 2 * BLOCK:  # what is left is never a sliver
                yield linked(ids[:BLOCK], codes[:BLOCK])
                ids, codes = ids[BLOCK:], codes[BLOCK:]
        if len(ids) > 1:
            yield linked(ids, codes)

    key = F.col("keys")[order]
    ordered = points.select("node", "code", key.alias("key")).repartitionByRange(parts, "key").sortWithinPartitions("key")
    return ordered.select("node", "code").mapInArrow(link, _EDGES)


def _nearest(edges: DataFrame, most: int) -> DataFrame:
    """(a, b, near, new): each a's nearest; an edge known before is not new."""
    # Dealt by a once: the aggregate and the rank after it need no shuffle of their own.
    one = edges.repartition("a").groupBy("a", "b").agg(F.max("near").alias("near"), F.bool_and("new").alias("new"))
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("near"), "b"))
    return one.withColumn("r", rank).where(F.col("r") <= most).drop("r")


def descend(graph: DataFrame, points: DataFrame, dim: int, number: int) -> DataFrame:
    """Proposals (a, b, near) of one round."""
    reverse = F.row_number().over(W.partitionBy("b").orderBy(F.xxhash64("a", "b", F.lit(number))))
    back = graph.withColumn("r", reverse).where(F.col("r") <= REVERSE)
    meet = graph.select(F.col("a").alias("g"), F.col("b").alias("node"), "new").unionByName(
        back.select(F.col("b").alias("g"), F.col("a").alias("node"), "new")
    )
    far = graph.groupBy("a").agg(F.min("near").alias("far"), F.count("*").alias("n"))
    known = points.select("node", "code").join(
        far.select(F.col("a").alias("node"), F.when(F.col("n") < DEGREE, F.lit(-5.0)).otherwise(F.col("far")).cast("float").alias("far")), "node"
    )
    met = (
        meet.join(known, "node")
        .groupBy("g")
        .agg(F.collect_list(F.struct("node", "new", "far", "code")).alias("m"), F.max("new").alias("any"))
        .where("any")
        .select("m")
    )

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, m = _lists(batch.column("m"))
            node, new, far = m.field("node").to_numpy(), m.field("new").to_numpy(zero_copy_only=False), m.field("far").to_numpy()
            unit = _unit(_column(m.field("code"), dim))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                ids, at = np.unique(node[s:e], return_index=True)
                at += s
                if len(ids) < 2:
                    continue
                near = _near(unit[at], unit[at])
                fresh = new[at]
                near[~(fresh[:, None] | fresh[None, :])] = -9
                np.fill_diagonal(near, -9)
                k = min(PROPOSALS, len(ids) - 1)
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                value = np.take_along_axis(near, top, 1)
                ok = value > far[at][:, None]
                out.append((np.broadcast_to(ids[:, None], top.shape)[ok], ids[top[ok]], value[ok]))
            if out:  # a node of many meetings proposes no more than it can use
                yield _edge_batch(*_best(*(np.concatenate(x) for x in zip(*out, strict=True)), DEGREE))

    return met.mapInArrow(propose, _EDGES)


def build_graph(scratch: Scratch, points: DataFrame, n: int, dim: int) -> DataFrame:
    spark = scratch.spark
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (4 * BLOCK)))
    begun = first_edges(points, 0, parts, dim)
    for k in range(1, ORDERS):
        begun = begun.unionByName(first_edges(points, k, parts, dim))
    graph = scratch.keep(_nearest(begun.withColumn("new", F.lit(True)), DEGREE), "graph-0")
    for k in range(1, ROUNDS + 1):
        found = descend(graph, points, dim, k).withColumn("new", F.lit(True))
        after = scratch.keep(_nearest(graph.withColumn("new", F.lit(False)).unionByName(found), DEGREE), f"graph-{k}")
        scratch.drop(f"graph-{k - 1}")
        graph = after
        if graph.where("new").count() < 0.001 * DEGREE * n:
            break
    return graph


def walk(scratch: Scratch, graph: DataFrame, points: DataFrame, starts: DataFrame, dim: int) -> DataFrame:
    """``starts`` (q, code, node) -> (q, node): the beam that each query ends with."""
    seen = "q long, code binary, beam array<struct<node:long,near:float,done:boolean>>"

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("node", pa.int64()), ("near", pa.float32()), ("done", pa.bool_())]))
        for batch in batches:
            unit = _unit(_column(batch.column("code"), dim))
            ends, m = _lists(batch.column("met"))
            node, met = m.field("node").to_numpy(), _unit(_column(m.field("code"), dim)) if len(m) else np.zeros((0, dim))
            beams = []
            for i, old in enumerate(batch.column("beam").to_pylist()):
                ids = node[ends[i] : ends[i + 1]]
                near = _near(met[ends[i] : ends[i + 1]], unit[i])
                had = {x["node"]: x["near"] for x in old or []}  # all of them were expanded by now
                every = had | {int(a): float(b) for a, b in zip(ids, near, strict=True) if int(a) not in had}
                top = sorted(every.items(), key=lambda x: (-x[1], x[0]))
                edge = top[BEAM - 1][1] if len(top) > BEAM else -9.0
                top = [x for x in top if x[1] >= edge]
                beams.append([{"node": a, "near": b, "done": a in had} for a, b in top])
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("code"), pa.array(beams, shape)], names=["q", "code", "beam"])

    queries = starts.select("q", "code").distinct()
    fresh = starts.select("q", "node")
    beam = None
    for k in count():
        met = (
            fresh.distinct()
            .join(points.select("node", F.col("code").alias("c")), "node")
            .groupBy("q")
            .agg(F.collect_list(F.struct("node", F.col("c").alias("code"))).alias("met"))
        )
        state = queries.withColumn("beam", F.lit(None).cast("array<struct<node:long,near:float,done:boolean>>")) if beam is None else beam
        joined = state.join(met, "q", "left").withColumn("met", F.coalesce("met", F.array().cast("array<struct<node:long,code:binary>>")))
        beam = scratch.keep(joined.select("q", "code", "beam", "met").mapInArrow(advance, seen), f"beam-{k}")
        front = beam.select("q", F.explode("beam").alias("x")).where("NOT x.done").select("q", F.col("x.node").alias("node"))
        scratch.drop(f"beam-{k - 1}")
        if front.isEmpty():  # every round expands each open node of a beam, and no node twice: this comes
            break
        fresh = front.join(graph.select(F.col("a").alias("node"), "b"), "node").select("q", F.col("b").alias("node"))
    return beam.select("q", F.explode("beam").alias("x")).select("q", F.col("x.node").alias("node"))


def nearest_neighbours(
    spark: SparkSession, vectors: DataFrame, is_query: F.Column | str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` that ``is_query``, a condition on ``id``, picks."""
    scratch = Scratch(spark, "neighbours")
    rows = scratch.keep(usable(vectors, id_col, vector_col), "rows")
    head = rows.select(F.size("v").alias("n")).first()
    shape = "query_id long, rank int, vec_id long, score double"
    if head is None:
        return spark.createDataFrame([], shape)
    dim = head["n"]
    # A node's number is a hash of its vector's smallest id and the vector: ids may repeat.
    distinct = nodes(rows, k + 1).withColumn("node", F.xxhash64("node0", "v")).drop("node0")
    distinct = scratch.keep(distinct, "nodes")
    n = distinct.count()
    bits = max(0, int(np.ceil(np.log2(max(1.0, n / (2 * BLOCK))))))
    points = scratch.keep(compact(distinct, dim, bits, seed=3), "points")
    graph = build_graph(scratch, points, n, dim)
    asked = rows.where(is_query).select(F.col("id").alias("query_id"), "v")
    queries = asked.select("query_id", "v", F.xxhash64("query_id", "v").alias("q"))
    own = queries.join(distinct.select("v", "node"), "v").select("q", "node")
    begin = own.unionByName(own.join(graph.select(F.col("a").alias("node"), "b"), "node").select("q", F.col("b").alias("node")))
    starts = own.join(points.select("node", "code"), "node").select("q", "code").join(begin, "q")
    ends = walk(scratch, graph, points, starts, dim)
    # The exact measure, on the vectors as they came.
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = (
        ends.join(queries, "q")
        .join(distinct.select("node", F.col("v").alias("w"), "ids"), "node")
        .select("q", "query_id", "ids", (dot("v", "w") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("w", "w")))).alias("score"))
    )
    each = scored.select("q", "query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    order = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
