"""Packing documents into fixed-length sequences by cutting-stock column generation.

1. Tasks turn texts into token ids and cut them: whole sequences, then a rest.
2. The lengths of all pieces are counted in ``QUANTUM`` steps: a histogram of a
   fixed number of classes, however many documents there are.
3. The driver solves the cutting-stock linear program on the histogram. A column
   is a pattern, a multiset of classes that fits a sequence; knapsack dynamic
   programming prices columns with the dual values until no pattern gains.
4. Patterns are rounded down to whole repeats; what is left, at most a few
   pieces per class, is packed best fit, longest first.
5. Pieces are ranked inside their class in Spark and take the places that the
   patterns have for their class, by rank.
6. Pieces of at most ``SAND`` tokens, for which rounding would cost most, are left out
   of the program and poured into the room that it leaves, and then into sequences of
   their own. Laid end to end, they are dealt to rooms by where each begins; a room counts
   for its size less the longest such piece but one token, so the last piece
   always fits, and a room is left with fewer free tokens than that piece has.

Only histograms (of classes, of short lengths, of rooms) and the table of patterns pass through the driver; all are
bounded by the number of classes or the sequence length. A class is ranked in salted parts, so a length
that a third of all pieces share is many tasks' work.

Defined results
* null text: the empty text, one piece that holds the end token alone.
* repeated rows are packed each for itself; equal pieces are interchangeable.
* empty table: no pieces. Columns besides id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.store import Scratch
from loomspark.llm.tokens import word_tokenizer

LENGTH = 4096
#: Lengths are rounded up to a multiple of this for planning only.
QUANTUM = 8
#: Pieces up to this length are poured.
SAND = 64
#: Texts that are tokenized together, in characters.
BLOCK = 1_000_000
#: Column generation ends when the bound proves it this near the optimum.
NEAR = 0.9995

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(
    docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, with_ids: bool = False
) -> DataFrame:
    """(doc_id, text) -> pieces: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, their ids."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_tokenizer(tokenizer)
        for f in frames:
            size = f["text"].str.len().fillna(0).cumsum() // BLOCK
            for _, part in f.groupby(size, sort=False):
                rows = []
                for i, ids in zip(part["doc_id"], words.encode(part["text"], end_id), strict=True):
                    n = len(ids) // 4
                    for at in range(0, n, length):
                        piece = ids[4 * at : 4 * (at + length)]
                        row = (i, at, len(piece) // 4, zlib.crc32(piece), n)
                        rows.append((*row, np.frombuffer(piece, "<u4").astype(np.int32)) if with_ids else row)
                columns = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
                yield pd.DataFrame(rows, columns=columns)

    return docs.select("doc_id", "text").mapInPandas(cut, PIECES + ", ids array<int>" * with_ids)


@dataclass
class Plan:
    """``slots``: rows (class, first rank, end rank, first sequence, slot): rank r of the class goes to sequence first + r - first rank."""

    slots: list[tuple[int, int, int, int, int]]
    sequences: int
    bound: float


def best_pattern(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the multiset of classes 1..capacity of largest value. ``value[w]`` is that of class w."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = best[c - 1 :: -1] + value[1 : c + 1] if c > 1 else best[:1] + value[1:2]
        k = int(gain.argmax())
        if gain[k] > best[c - 1] + 1e-12:
            best[c], last[c] = gain[k], k + 1
        else:
            best[c] = best[c - 1]
    count, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        if last[c]:
            count[last[c]] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[capacity]), count


def generate_patterns(demand: np.ndarray, capacity: int) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Patterns, how often the linear program uses each, and a lower bound on sequences. ``demand[w]``: pieces of class w."""
    classes = np.flatnonzero(demand)
    m = len(classes)
    if not m:
        return [], np.zeros(0), 0.0
    need = demand[classes].astype(float)
    columns = np.diag((capacity // classes).astype(float))
    inverse, x = np.diag(1 / columns.diagonal()), need / columns.diagonal()
    bound = need @ classes / capacity
    for _ in range(20 * m + 200):
        dual = inverse.sum(0)
        value = np.zeros(capacity + 1)
        value[classes] = np.maximum(dual, 0)
        worth, count = best_pattern(value, capacity)
        bound = max(bound, dual @ need / max(worth, 1.0))
        if worth <= 1 + 1e-9 or bound >= NEAR * x.sum():
            break
        new = count[classes].astype(float)
        way = inverse @ new
        ok = way > 1e-9
        ratio = np.full(m, np.inf)
        ratio[ok] = x[ok] / way[ok]
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * way, 0)
        x[out] = step
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        columns[:, out] = new
    patterns = []
    for j in range(m):
        p = np.zeros(capacity + 1, np.int64)
        p[classes] = columns[:, j].astype(np.int64)
        patterns.append(p)
    return patterns, x, float(bound)


def plan(demand: np.ndarray, capacity: int) -> Plan:
    patterns, used, bound = generate_patterns(demand, capacity)
    given = np.zeros(capacity + 1, np.int64)
    slots: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    for p, u in sorted(zip(patterns, used, strict=True), key=lambda pu: -pu[1]):
        at = np.flatnonzero(p)
        # A pattern may hold more of a class than is left, where the program covers more than the demand.
        times = min([int(u + 1e-6), *((demand[at] - given[at]) // p[at]).tolist()]) if len(at) else 0
        if times <= 0:
            continue
        slot = 0
        for w in at[::-1].tolist():
            for _ in range(int(p[w])):
                slots.append((w, int(given[w]), int(given[w]) + times, sequences, slot))
                given[w] += times
                slot += 1
        sequences += times
    # Rounding leaves less than a pattern's worth for each column: best fit, longest first.
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled: dict[int, int] = {}
    for w in range(capacity, 0, -1):
        for rank in range(int(given[w]), int(demand[w])):
            free = next((r for r in range(w, capacity + 1) if room[r]), None)
            if free is None:
                free, seq = capacity, sequences
                sequences += 1
            else:
                seq = room[free].pop()
            slots.append((w, rank, rank + 1, seq, filled.get(seq, 0)))
            filled[seq] = filled.get(seq, 0) + 1
            room[free - w].append(seq)
    return Plan(slots, sequences, bound)


def _salted(rows: DataFrame, of: str, salts: int, order: list[str]) -> tuple[DataFrame, np.ndarray]:
    """``rows`` with ``__rank`` among those of equal ``of`` (a small whole number), and how many there are of each.

    ``__salt`` deals equal ones to many tasks; ranks go on from one salt to the next.
    """
    parts = rows.groupBy(of, "__salt").agg(F.count("*").alias("__n"))
    totals = {r[0]: r[1] for r in parts.groupBy(of).agg(F.sum("__n")).collect()}  # one row for each class
    counts = np.zeros(max(totals, default=0) + 1, np.int64)
    for k, n in totals.items():
        counts[k] = n
    before = W.partitionBy(of).orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(of, "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = W.partitionBy(of, "__salt").orderBy(*order)
    ranked = rows.withColumn("__row", F.row_number().over(within) - 1).join(starts, [of, "__salt"])
    return ranked.withColumn("__rank", F.col("__before") + F.col("__row")).drop("__row", "__before"), counts


_PLACES = ["doc_id", "start", "ids_crc32", "doc_tokens"]


def _planned(spark: SparkSession, pieces: DataFrame, salts: int, length: int, quantum: int) -> tuple[DataFrame, int]:
    """Pieces placed by the program's patterns, and the number of sequences."""
    capacity = length // quantum
    ranked, counts = _salted(pieces.withColumn("__class", F.ceil(F.col("length") / quantum).cast("int")), "__class", salts, _PLACES)
    demand = np.zeros(capacity + 1, np.int64)
    demand[: len(counts)] = counts
    made = plan(demand, capacity)
    slots = spark.createDataFrame(made.slots, "__of int, __from long, __to long, __sequence long, __slot int")
    # The table of patterns has a few rows per class, whatever the number of pieces.
    placed = ranked.join(
        F.broadcast(slots),
        (F.col("__class") == F.col("__of")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")),
    ).withColumn("sequence_id", F.col("__sequence") + F.col("__rank") - F.col("__from"))
    left = W.partitionBy("sequence_id").orderBy("__slot").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(left), F.lit(0)).cast("long").alias("offset")
    return placed.select(*pieces.columns, "sequence_id", offset), made.sequences


@dataclass(frozen=True)
class Line:
    """Rooms laid end to end, equal ones together: where those of each size begin, their size, and how many there are."""

    base: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, total: int, own: int) -> Line:
        """``counts`` of rooms by size, the largest first; sequences of the size ``own``, as many as it takes, come last."""
        size = np.flatnonzero(counts)[::-1].astype(np.int64)
        ends = np.cumsum(size * counts[size]) if len(size) else np.zeros(0, np.int64)
        base = np.r_[0, ends].astype(np.int64)
        return cls(base, np.r_[size, own].astype(np.int64))

    def at(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(size of the room, its rank among those of that size, whether it is a new sequence)."""
        k = np.searchsorted(self.base, x, side="right") - 1
        return self.size[k], (x - self.base[k]) // self.size[k], k == len(self.size) - 1


def _poured(sand: DataFrame, planned: DataFrame, sequences: int, salts: int, length: int) -> DataFrame:
    """Short pieces in the rooms that the planned ones leave, then in sequences of their own."""
    ranked, by_length = _salted(sand.withColumn("__length", F.col("length").cast("int")), "__length", salts, _PLACES)
    spare = max(len(by_length) - 2, 0)  # the longest of them less a token
    rooms = planned.groupBy("sequence_id").agg((F.lit(length) - F.sum("length")).alias("__free")).where(F.col("__free") > spare)
    rooms = rooms.withColumn("__size", (F.col("__free") - spare).cast("int")).withColumn("__salt", F.pmod(F.xxhash64("sequence_id"), F.lit(salts)).cast("int"))
    rooms, by_size = _salted(rooms, "__size", salts, ["sequence_id"])
    lengths = np.arange(len(by_length))
    begins = np.r_[0, np.cumsum(lengths * by_length)][:-1]  # equal lengths lie together
    line = Line.of(by_size, int((lengths * by_length).sum()), length - spare)
    begin = F.element_at(F.array(*[F.lit(int(x)) for x in begins]), F.col("__length") + 1) + F.col("__rank") * F.col("__length")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank, new = line.at(b.column("__x").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size.astype(np.int32)), pa.array(rank), pa.array(new)], names=[*b.schema.names, "__size", "__rank", "__new"])

    columns = sand.drop("__salt").columns
    laid = ranked.select(*columns, begin.cast("long").alias("__x"))
    more = [T.StructField("__size", T.IntegerType()), T.StructField("__rank", T.LongType()), T.StructField("__new", T.BooleanType())]
    dealt_out = laid.mapInArrow(dealt, T.StructType([*laid.schema.fields, *more]))
    own = dealt_out.where("__new").select(*columns, "__x", (F.lit(sequences) + F.col("__rank")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("__used"))
    # A room takes at most its size in pieces, so no key of this join is hot.
    found = dealt_out.where("NOT __new").join(rooms.select("__size", "__rank", "sequence_id", (F.lit(length) - F.col("__free")).alias("__used")), ["__size", "__rank"])
    every = own.unionByName(found.select(*own.columns))
    left = W.partitionBy("sequence_id").orderBy("__x").rowsBetween(W.unboundedPreceding, -1)
    return every.select(*columns, "sequence_id", (F.col("__used") + F.coalesce(F.sum("length").over(left), F.lit(0))).cast("long").alias("offset"))


def pack(spark: SparkSession, pieces: DataFrame, length: int = LENGTH, quantum: int = QUANTUM) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to written pieces; a sequence has no gaps."""
    salts = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*_PLACES[:3]), F.lit(salts)).cast("int"))
    placed, sequences = _planned(spark, salted.where(F.col("length") > SAND), salts, length, quantum)
    placed = Scratch(spark, "packing").keep(placed.select(*pieces.columns, "sequence_id", "offset"), "planned")
    poured = _poured(salted.where(F.col("length") <= SAND), placed, sequences, salts, length)
    return placed.unionByName(poured.select(*placed.columns))


def pack_documents(
    spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, with_ids: bool = False
) -> DataFrame:
    """Whole documents -> placed pieces. Pieces are written once: their lengths are needed before their places."""
    pieces = Scratch(spark, "packing").keep(cut_documents(docs, tokenizer, end_id, length, with_ids), "pieces")
    return pack(spark, pieces, length)
