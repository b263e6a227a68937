"""Vector codes from small integer codebooks, with entries ruled out by segment means.

A vector's components become integers, floor(scale * x); it is cut into equal
consecutive parts, and each part position has a codebook of integer entries. The first
codebook is taken from the smallest ids; rounds assign every part to its nearest
entry and replace an entry by the componentwise floor of its parts' mean.

Finding the nearest entry goes from coarse to fine. A part is cut into blocks; by
blocks, the squared differences of means times their sizes, and the squared
difference of the residual norms, add up to no more than the squared distance. With
one block this bounds all entries at once; entries whose bound is above the exact
distance of the best-looking one go. What is left is bounded by more blocks, and what
is left then receives exact distances in 64-bit integers. A margin above the rounding
of floating point keeps every bound conservative, so the nearest entry always
survives, and the answer is that of a full search.

Only codebooks reach the driver: ``parts * entries`` rows, whatever the table.

Defined results
* rows whose vector is null, empty, holds null or non-finite components, or has a
  length that ``parts`` doesn't divide take no part; nor do those of another length
  than the kept row that comes first by id (null ids last, then by the vector).
* equal distances go to the lower entry; repeated rows count as often as they stand there.
* fewer rows than entries: as many entries; none: no rows.
* a component beyond ``LARGEST`` after scaling is refused, as distances would not fit 64 bits.
* the columns named in ``keep`` pass through; others are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.store import Scratch

LARGEST = 2**26
#: Blocks of the bounds, from coarse to fine.
BLOCKS = (1, 4)
#: Numbers of one intermediate array, which bound a step's rows.
STEP = 1 << 22
#: Far above the rounding of a bound, as part of both squared norms.
MARGIN = 1e-6


def _edges(width: int, blocks: int) -> np.ndarray:
    return np.unique(np.linspace(0, width, min(blocks, width) + 1).astype(np.int64))


def _means(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums over root of size by block, residual norm, squared norm) of each row."""
    edges = _edges(x.shape[1], blocks)
    f = x.astype(np.float64)
    scaled = np.add.reduceat(f, edges[:-1], axis=1) / np.sqrt(np.diff(edges))
    norm = (f * f).sum(1)
    return scaled, np.sqrt(np.maximum(norm - (scaled * scaled).sum(1), 0)), norm


@dataclass(frozen=True)
class Book:
    """Entries of one part position, and their means for each number of blocks."""

    entries: np.ndarray
    means: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]

    @classmethod
    def of(cls, entries: np.ndarray) -> Book:
        entries = np.ascontiguousarray(entries, np.int64)
        return cls(entries, tuple(_means(entries, b) for b in BLOCKS))


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def _nearest_step(x: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray, int]:
    rows = np.arange(len(x))
    mean, rest, norm = _means(x, BLOCKS[0])
    c_mean, c_rest, c_norm = book.means[0]
    bound = (rest[:, None] - c_rest) ** 2
    for b in range(mean.shape[1]):
        bound += (mean[:, b, None] - c_mean[:, b]) ** 2
    best = _exact(x, book.entries[bound.argmin(1)])
    slack = MARGIN * (norm[:, None] + c_norm) + 1e-3
    i, j = np.nonzero(bound - slack <= best[:, None])
    for blocks, (c_mean, c_rest, c_norm) in zip(BLOCKS[1:], book.means[1:], strict=True):
        mean, rest, norm = _means(x, blocks)
        bound = (rest[i] - c_rest[j]) ** 2 + ((mean[i] - c_mean[j]) ** 2).sum(1)
        starts = np.searchsorted(i, rows)  # each row has survivors
        least = np.minimum.reduceat(bound, starts)
        at = np.flatnonzero(bound == least[i])
        at = at[np.unique(i[at], return_index=True)[1]]
        best = np.minimum(best, _exact(x, book.entries[j[at]]))
        stay = bound - (MARGIN * (norm[i] + c_norm[j]) + 1e-3) <= best[i]
        i, j = i[stay], j[stay]
    exact = _exact(x[i], book.entries[j])
    least = np.minimum.reduceat(exact, np.searchsorted(i, rows))
    at = np.flatnonzero(exact == least[i])
    at = at[np.unique(i[at], return_index=True)[1]]  # entries of a row stand in order: the lower index comes first
    return j[at], least, len(i)


def nearest(x: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) of each row's nearest entry, and how many distances were computed in full."""
    size = max(1, STEP // max(1, book.entries.size))
    done = [_nearest_step(x[k : k + size], book) for k in range(0, len(x), size)]
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done]), sum(d[2] for d in done)


def _lists(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(edges from 0, values) of a list column without null lists; null values are NaN or raise for integers."""
    edges = a.offsets.to_numpy()
    return edges - edges[0], a.values.slice(edges[0], edges[-1] - edges[0]).to_numpy(zero_copy_only=False)


def integers(vectors: DataFrame, id_col: str, vector_col: str, keep: Sequence[str], parts: int, scale: float) -> DataFrame:
    """(id, keep, v): usable rows, components as scaled integers."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), *keep, F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("v", T.ArrayType(T.LongType()))])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, values = _lists(batch.column("v"))
            size = np.diff(edges)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            fine = (size > 0) & (size % parts == 0) & (bad[edges[1:]] == bad[edges[:-1]])
            whole = np.floor(np.where(np.repeat(fine, size), values, 0) * scale)
            if len(whole) and np.abs(whole).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} after scaling")
            v = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(whole.astype(np.int64)))
            out = pa.RecordBatch.from_arrays([*batch.columns[:-1], v], names=schema.names)
            yield out.filter(pa.array(fine))

    return rows.mapInArrow(made, schema)


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return _lists(batch.column("v"))[1].reshape(-1, dim)


def _sums(rows: DataFrame, books: list[Book], dim: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> (count, sums) of the parts that are nearest to the entry."""
    width, n = dim // len(books), len(books[0].entries)
    names = [f"s{k}" for k in range(width)]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros((len(books), n, width), np.int64), np.zeros((len(books), n), np.int64)
        for batch in batches:
            x = _matrix(batch, dim)
            for p, book in enumerate(books):
                part = x[:, p * width : (p + 1) * width]
                entry = nearest(part, book)[0]
                np.add.at(total[p], entry, part)
                number[p] += np.bincount(entry, minlength=n)
        p, e = np.nonzero(number)
        columns = [pa.array(p), pa.array(e), pa.array(number[p, e]), *(pa.array(total[p, e, k]) for k in range(width))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *names])

    shape = ", ".join(f"{c} long" for c in ("part", "entry", "n", *names))
    met = rows.select("v").mapInArrow(summed, shape).groupBy("part", "entry").agg(F.sum("n"), *[F.sum(c) for c in names])
    return {(r[0], r[1]): (r[2], list(r[3:])) for r in met.collect()}  # a codebook's rows


@dataclass(frozen=True)
class Codes:
    #: (id, keep, entries array<int>, error long): an entry for each part, and the squared distances summed.
    rows: DataFrame
    #: By part: entries x components.
    books: list[np.ndarray]


def encode(
    scratch: Scratch,
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    keep: Sequence[str] = (),
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: float = 1024.0,
) -> Codes:
    """Fits codebooks in ``rounds`` passes over all rows and encodes them in one more."""
    rows = scratch.keep(integers(vectors, id_col, vector_col, keep, parts, scale), "vectors")
    order = [F.asc_nulls_last("id"), F.asc("v")]
    head = rows.orderBy(*order).select("v").first()
    dim = len(head["v"]) if head else parts
    rows = rows.where(F.size("v") == dim)
    first = np.array([r["v"] for r in rows.orderBy(*order).select("v").limit(entries).collect()], np.int64).reshape(-1, dim)
    width = dim // parts
    books = [first[:, p * width : (p + 1) * width] for p in range(parts)]
    for _ in range(rounds if head else 0):
        found = _sums(rows, [Book.of(b) for b in books], dim)
        books = [b.copy() for b in books]
        for (p, e), (n, sums) in found.items():
            books[p][e] = [s // n for s in sums]
    last = [Book.of(b) for b in books]
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("entries", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, dim)
            found = [nearest(x[:, p * width : (p + 1) * width], book) for p, book in enumerate(last)]
            each = np.column_stack([f[0] for f in found]).astype(np.int32)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * parts, pa.int32()), pa.array(each.ravel()))
            error = pa.array(sum(f[1] for f in found), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], codes, error], names=schema.names)

    return Codes(rows.mapInArrow(coded, schema), books)
