"""Pages over ranked rows, keyed replacement, and text helpers of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions.text import tsv


def capped(rows: DataFrame, key: str, most: int, order: list[Column]) -> DataFrame:
    """At most ``most`` rows of each key, the first by ``order``; later rows of other keys move up."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("__n", place).where(F.col("__n") <= most).drop("__n")


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` with ``place`` and ``has_more``.

    One row more than the page is read, so nothing beyond it is ranked and no total is counted.
    """
    last = offset + limit
    head = rows.orderBy(*order).limit(last + 1).withColumn("place", F.row_number().over(W.orderBy(*order)))
    more = F.max("place").over(W.partitionBy(F.lit(0))) > last
    return head.withColumn("has_more", more).where((F.col("place") > offset) & (F.col("place") <= last))


def last_offset(total: Column, limit: int) -> Column:
    return F.floor((total - 1) / limit).cast("long") * limit


def listed(value: Column, wanted: list[str] | None) -> Column:
    """No list: every row; an empty list: none."""
    if wanted is None:
        return F.lit(True)
    return value.isin(wanted) if wanted else F.lit(False)


def clip(text: Column, limit: int) -> Column:
    """One line of at most ``limit`` characters, cut at its end; null is empty."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.char_length(line) <= limit, line).otherwise(F.concat(F.rtrim(F.left(line, F.lit(max(1, limit - 1)))), F.lit("…")))


def csv(text: Column, most: int) -> Column:
    """Trimmed items between commas without the empty ones; null if there are more than ``most``."""
    items = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(items) <= most, items)


def slug(name: Column, fallback: str) -> Column:
    base = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    short = F.left(base, F.lit(48))
    return F.when(short != "", short).otherwise(fallback)


def unique_slugs(rows: DataFrame, key: str, name: Column, fallback: str) -> DataFrame:
    """(key, slug): names of one slug are numbered from 2 on, in the order of their keys."""
    based = rows.select(key, slug(name, fallback).alias("base"))
    n = F.row_number().over(W.partitionBy("base").orderBy(key))
    made = F.when(n == 1, F.col("base")).otherwise(F.concat(F.left("base", F.lit(44)), F.lit("-"), n.cast("string")))
    return based.select(key, made.alias("slug"))


def box(points: Column) -> Column:
    """The axis-aligned box, inside the unit square, of points given as x, y, x, y, ..."""
    part = lambda odd: F.filter(points, lambda _, i: i % 2 == odd)
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    corner = lambda f, odd: unit(f(part(odd)))
    return F.struct(
        corner(F.array_min, 0).alias("x0"), corner(F.array_min, 1).alias("y0"), corner(F.array_max, 0).alias("x1"), corner(F.array_max, 1).alias("y1")
    )


def screen_tokens(text: Column) -> Column:
    """Lower-case tokens in which ``_ - . /`` count as letters, as in names of commands and modules."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_\-./]+"), lambda x: x != "")


def field_postings(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, field, term), each once: one pass over the rows for all fields."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda x: x != ""))
    per = F.array(*[F.struct(F.lit(f).alias("field"), words(F.col(c)).alias("terms")) for f, c in fields.items()])
    each = rows.select(key, F.explode(per).alias("p")).select(key, "p.field", F.explode("p.terms").alias("term"))
    return each.distinct()


def replaced(old: DataFrame, new: DataFrame, key: str, seq: str, order: list[str]) -> DataFrame:
    """Old rows of keys that don't come again, and the new ones numbered from 0 in each key."""
    numbered = new.withColumn(seq, (F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1).cast("long"))
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(numbered)


def resource_lines(rows: DataFrame, columns: list[str], optional: str, order: list[Column], most: int) -> DataFrame:
    """(place, line): a table as tab-separated lines, the first ``most`` rows by ``order`` below a line of names.

    The last column, ``optional``, is there only if one of these rows has something in it:
    a column of empty cells would promise what the table doesn't have.
    """
    page = rows.orderBy(*order).limit(most).withColumn("place", F.row_number().over(W.orderBy(*order)))
    shown = F.max((F.coalesce(F.col(optional), F.lit("")) != "").cast("int")).over(W.partitionBy(F.lit(0))) == 1  # ``most`` rows
    lines = page.withColumn("__plain", tsv(page, columns)).withColumn("__full", tsv(page, [*columns, optional])).withColumn("__shown", shown)
    body = lines.select("place", F.when(F.col("__shown"), F.col("__full")).otherwise(F.col("__plain")).alias("line"))
    held = page.agg(F.coalesce(F.max((F.coalesce(F.col(optional), F.lit("")) != "").cast("int")), F.lit(0)).alias("any"))
    names = held.select(F.lit(0).alias("place"), F.when(F.col("any") == 1, "\t".join([*columns, optional])).otherwise("\t".join(columns)).alias("line"))
    return names.unionByName(body)
