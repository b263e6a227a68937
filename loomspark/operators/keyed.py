"""Stored tables that take upserts and deletions by key.

Rows lie in folders by a hash of their key. A change reads the folders of its own
keys, works out what they shall hold, writes that aside, and then puts it in
place of those folders (dynamic partition overwrite). Other folders are not
touched. What is written depends on the old rows and the change alone, and a change
that has happened already changes nothing, so a job that died may run again.

A table has one writer at a time; readers that began before a change may have to begin again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.store import Files

#: (old, new) -> what stays in a column.
Merge = Callable[[Column, Column], Column]
FOLDER = "folder"


def keep_old_if_null(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


@dataclass(frozen=True)
class KeyedTable:
    """``owner``: the columns whose hash chooses a folder; a key holds them."""

    spark: SparkSession
    path: str
    owner: tuple[str, ...]
    folders: int = 32

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(FOLDER, F.pmod(F.xxhash64(*self.owner), F.lit(self.folders)).cast("int"))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(FOLDER)

    def of(self, owners: DataFrame) -> DataFrame:
        """Rows of some owners; only their folders are read."""
        held = self._folders(self._dealt(owners.select(*self.owner)))
        rows = self.spark.read.parquet(self.path).where(F.col(FOLDER).isin(*held))
        return rows.drop(FOLDER).join(owners.select(*self.owner).distinct(), list(self.owner), "left_semi")

    def _folders(self, dealt: DataFrame) -> list[int]:
        return sorted(r[0] for r in dealt.select(FOLDER).distinct().collect())  # ``folders`` rows at most

    def write(self, rows: DataFrame) -> KeyedTable:
        """The whole table anew."""
        self._dealt(rows).repartition(self.folders, FOLDER).write.mode("overwrite").partitionBy(FOLDER).parquet(self.path)
        self._empty(rows, 0, "append")
        return self

    def _empty(self, rows: DataFrame, folder: int, mode: str) -> None:
        """A file without rows, so that a table without rows still has columns."""
        none = self.spark.createDataFrame([], rows.schema).drop(FOLDER)
        none.coalesce(1).write.mode(mode).parquet(f"{self.path}/{FOLDER}={folder}")

    def _put(self, rows: DataFrame, held: list[int]) -> None:
        """``rows`` are what the folders ``held`` shall hold."""
        files, aside = Files(self.spark), f"{self.path}.{uuid.uuid4().hex}"
        rows.repartition(max(1, len(held)), FOLDER).write.partitionBy(FOLDER).parquet(aside)
        written = self.spark.read.schema(rows.schema).parquet(aside)
        written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FOLDER).parquet(self.path)
        left = set(self._folders(written))
        for folder in held:
            if folder not in left:
                self._empty(rows, folder, "overwrite")
        files.delete(aside)
        self.spark.catalog.refreshByPath(self.path)

    def _old(self, held: list[int]) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col(FOLDER).isin(*held))

    def upsert(self, rows: DataFrame, key: Sequence[str], order: Sequence[Column] = (), merge: dict[str, Merge] | None = None) -> None:
        """Rows by key: of several for one key the last in ``order`` counts; ``merge`` rules join old and new values."""
        new = self._dealt(rows)
        held = self._folders(new)
        if not held:
            return
        columns = [c for c in rows.columns if c not in key]
        # One row for each key before the join; the largest struct is the last row.
        last = F.max_by(F.struct(*columns), F.struct(*order, *columns)).alias("row") if columns else F.lit(None).alias("row")
        new = new.groupBy(*key, FOLDER).agg(last).select(*key, FOLDER, *[F.col(f"row.{c}").alias(c) for c in columns], F.lit(True).alias("__new"))
        old = self._old(held).withColumn("__old", F.lit(True)).alias("o")
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
        both = old.join(new.alias("n"), [*same], "full")
        rule = lambda c: (merge or {}).get(c, lambda old, new: new)(F.col(f"o.{c}"), F.col(f"n.{c}"))
        value = lambda c: F.when(F.col("__new").isNull(), F.col(f"o.{c}")).when(F.col("__old").isNull(), F.col(f"n.{c}")).otherwise(rule(c)).alias(c)
        self._put(both.select(*[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in key], *map(value, columns), F.coalesce(f"n.{FOLDER}", f"o.{FOLDER}").alias(FOLDER)), held)

    def insert_missing(self, rows: DataFrame, key: Sequence[str]) -> None:
        """Rows whose key the table doesn't hold; of several for one key the least stays."""
        self.upsert(rows, key, merge={c: lambda old, new: old for c in rows.columns})

    def replace(self, rows: DataFrame, owners: DataFrame | None = None) -> None:
        """All rows of each owner give way to its rows here; ``owners`` names those that may have none."""
        named = rows.select(*self.owner) if owners is None else owners.select(*self.owner).unionByName(rows.select(*self.owner))
        gone = self._dealt(named.distinct())
        held = self._folders(gone)
        if not held:
            return
        stay = self._old(held).alias("o").join(gone.alias("g"), [F.col(f"o.{c}").eqNullSafe(F.col(f"g.{c}")) for c in self.owner], "left_anti")
        self._put(stay.unionByName(self._dealt(rows)), held)

    def delete(self, owners: DataFrame) -> None:
        """All rows of these owners."""
        self.replace(self.read().where("false"), owners)
