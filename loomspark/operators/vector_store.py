"""Stored vectors with 8-bit codes, and exact nearest neighbours by way of the codes.

A row's unit vector is stored twice: as 8-bit numbers, with the length of what
rounding took away, and in full. For a unit query, the true cosine differs from that with the
code by no more than that length. So one pass over the codes of the scope gives a
lower bound that the k nearest reach; rows whose upper bound is below it are out, and
the rest, a little more than k, are read in full and scored in double precision.
The answer is that of a search over all full vectors.

Rows lie in folders by owner, codes and vectors alike: writing an owner again
replaces its rows in both.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.operators.keyed import KeyedTable
from loomspark.operators.retrieval import cosine_distance

#: Distances are given to this many digits, and equal ones go by id.
DIGITS = 6
_CODED = T.StructType().add("code", "binary").add("off", "double")


@F.arrow_udf(_CODED)
def _coded(vectors: pa.Array) -> pa.Array:
    """Unit vectors as 8-bit numbers, and how far those are off. Zero vectors have no direction: null."""
    edges = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False)
    codes: list[bytes | None] = []
    off = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        v = values[a:b]
        norm = float(np.linalg.norm(v))
        if not norm or not np.isfinite(norm):
            codes.append(None)
            off.append(None)
            continue
        u = v / norm
        code = np.rint(u * 127).astype(np.int8)
        codes.append(code.tobytes())
        off.append(float(np.linalg.norm(u - code / 127)) + 1e-12)
    return pa.StructArray.from_arrays([pa.array(codes, pa.binary()), pa.array(off, pa.float64())], names=["code", "off"])


def _similar(query: list[float]) -> Column:
    """Dot product of codes with a unit query, a batch at a time."""
    q = np.asarray(query, np.float64)
    q = (q / np.linalg.norm(q) / 127).astype(np.float64)

    @F.arrow_udf(T.DoubleType())
    def near(codes: pa.Array) -> pa.Array:
        raw = b"".join(codes.to_pylist())
        return pa.array(np.frombuffer(raw, np.int8).reshape(-1, len(q)) @ q)

    return near(F.col("code"))


@dataclass(frozen=True)
class VectorStore:
    codes: KeyedTable
    vectors: KeyedTable

    @classmethod
    def at(cls, spark: SparkSession, path: str, folders: int = 32) -> VectorStore:
        return cls(KeyedTable(spark, f"{path}/codes", ("owner",), folders), KeyedTable(spark, f"{path}/vectors", ("owner",), folders))

    @staticmethod
    def _both(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        full = rows.select("id", "owner", F.col("vector").cast("array<double>").alias("vector"))
        coded = rows.select("id", "owner", "t_s", F.size("vector").alias("dim"), _coded(F.col("vector").cast("array<double>")).alias("c"))
        return coded.select("id", "owner", "t_s", "dim", "c.code", "c.off").where("code IS NOT NULL"), full

    def write(self, rows: DataFrame) -> VectorStore:
        """``rows`` (id, owner, t_s, vector), vectors without nulls."""
        coded, full = self._both(rows)
        self.codes.write(coded)
        self.vectors.write(full)
        return self

    def replace(self, rows: DataFrame, owners: DataFrame | None = None) -> None:
        """The owners' vectors give way to these."""
        coded, full = self._both(rows)
        # An owner of nothing but zero vectors has no codes, but its old ones go all the same.
        named = rows.select("owner") if owners is None else owners.select("owner").unionByName(rows.select("owner"))
        self.codes.replace(coded, named)
        self.vectors.replace(full, named)

    def delete(self, owners: DataFrame) -> None:
        self.codes.delete(owners)
        self.vectors.delete(owners)

    def knn(self, query: list[float], k: int, owners: DataFrame | None = None, t_from: float | None = None, t_to: float | None = None) -> DataFrame:
        """(id, owner, t_s, distance): the k nearest by cosine in scope, nearest first, ties by id.

        Both bounds of time are inclusive; vectors of another length than the query take no part.
        """
        rows = self.codes.read() if owners is None else self.codes.of(owners)
        for bound, fits in ((t_from, F.col("t_s") >= F.lit(t_from)), (t_to, F.col("t_s") <= F.lit(t_to))):
            rows = rows if bound is None else rows.where(fits)
        near = rows.where(F.col("dim") == len(query)).select("id", "owner", "t_s", "off", _similar(query).alias("s"))
        least = near.select((F.col("s") - F.col("off")).alias("l")).orderBy(F.desc("l")).limit(k).agg(F.min("l").alias("l"))
        # Rounded distances tie: what differs by less than the last digit stays in.
        may = near.crossJoin(F.broadcast(least)).where(F.col("s") + F.col("off") >= F.col("l") - 2 * 10**-DIGITS)  # one row
        q = F.array(*[F.lit(float(x)) for x in query])
        full = self.vectors.read() if owners is None else self.vectors.of(owners)
        scored = may.select("id", "owner", "t_s").join(full, ["owner", "id"])
        distance = F.round(cosine_distance(F.col("vector"), q), DIGITS)
        return scored.select("id", "owner", "t_s", distance.alias("distance")).orderBy("distance", "id").limit(k)
