"""A stored inverted index: postings by term, with counts, lengths and table statistics.

``build`` splits texts into terms once and writes

* ``postings`` (field, term, id, tf, dl): one row for each term of a field of a row,
  with the field's length, so that scoring needs no second table;
* ``terms`` (field, term, df, cf): the vocabulary;
* ``stats`` (field, n, total): rows and terms of each field, one row each.

Postings and vocabulary lie in folders by a hash of a term's first two characters,
sorted by term inside a file. A term, or a prefix of two characters and more, is in one
folder, and the file's statistics lead to its rows: a query reads its own terms'
postings and no text. A folder is written in slices by id, so a term that a third of
all rows hold is spread over files and tasks.

An index is complete or absent: it is written aside and renamed. ``open_or_build`` keeps
it by the state of its source, so a source that has changed gets a new one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.stemming import fold_accents, stem, stem_terms
from loomspark.operators.pages import screen_tokens
from loomspark.operators.retrieval import B, K1, LEAST_IDF, tokens
from loomspark.store import Files, complete, derived

#: Counts up when what is written changes.
VERSION = 1
#: Characters of a term that choose its folder, and so the shortest prefix that one folder answers.
HEAD = 2
#: Bytes of source text that a slice of all folders holds: one task sorts one folder of a slice, however large the table is.
SLICE_BYTES = 1 << 27
#: Words that a worker counts at a time, whatever the size of a batch; a longer text is counted by itself.
WORDS_AT_ONCE = 1 << 18
#: A term is also taken as a prefix from this length on; fixed values, the second for scripts without spaces between words.
PREFIX_FROM, DENSE_PREFIX_FROM = 3, 2
_DENSE = re.compile("[⺀-ヿ㐀-鿿ꀀ-꓏가-힯豈-﫿\U00020000-\U0002fa1f]")


@dataclass(frozen=True)
class Analyzer:
    """How a text becomes terms; ``one`` does the same for a single word of a query."""

    name: str
    tokens: Callable[[Column], Column]
    stems: bool = False

    def terms(self, spark: SparkSession, words: Sequence[str]) -> list[str]:
        """Query words as the index has them; a word of several terms gives each, one without any none."""
        if not words:
            return []
        split = spark.range(1).select(*[self.tokens(F.lit(w)).alias(f"w{i}") for i, w in enumerate(words)]).first()
        flat = [t for w in split for t in w]
        return [stem(t) for t in flat] if self.stems else flat


#: Lower-case runs of letters and digits.
PLAIN = Analyzer("plain", tokens)
#: The same without accents, stemmed: prose.
PROSE = Analyzer("prose", lambda text: tokens(fold_accents(text)), stems=True)
#: Names of programs and paths stay whole: text on screens.
SCREEN = Analyzer("screen", lambda text: screen_tokens(fold_accents(text)))


def _folder(term: Column, folders: int) -> Column:
    return F.pmod(F.crc32(F.left(term, F.lit(HEAD)).cast("binary")), F.lit(folders)).cast("int")


def folder_of(term: str, folders: int) -> int:
    return zlib.crc32(term[:HEAD].encode()) % folders


def _runs(edges: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows, one at least, that hold ``most`` words together; ``edges`` is where each row's words begin, and the end."""
    first = 0
    while first < len(edges) - 1:
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + most, side="right")) - 1)
        yield first, last
        first = last


def _count_terms(stems: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(field, id, w) -> (field, term, id, tf, dl), batch by batch: rows meet nowhere, so nothing is shuffled."""

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        edges = part.column("w").offsets.to_numpy()
        words = part.column("w").values.slice(edges[0], edges[-1] - edges[0])
        words = stem_terms(words) if stems else words
        coded = words.dictionary_encode()
        size = np.diff(edges)
        row = np.repeat(np.arange(len(size)), size)
        known = max(1, len(coded.dictionary))
        pair, tf = np.unique(row * known + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        row, term = pair // known, pair % known
        return pa.RecordBatch.from_arrays(
            [
                part.column("field").take(pa.array(row)),
                coded.dictionary.take(pa.array(term)),
                part.column("id").take(pa.array(row)),
                pa.array(tf, pa.int64()),
                pa.array(size[row], pa.int64()),
            ],
            names=["field", "term", "id", "tf", "dl"],
        )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in _runs(batch.column("w").offsets.to_numpy(), WORDS_AT_ONCE):
                yield count(batch.slice(first, last - first))

    return counted


def postings(docs: DataFrame, id_col: Column | str, fields: dict[str, Column], analyzer: Analyzer) -> DataFrame:
    """(field, term, id, tf, dl) of all rows; null texts have no terms."""
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    split = [docs.select(F.lit(name).alias("field"), key.cast("long").alias("id"), analyzer.tokens(F.coalesce(text, F.lit(""))).alias("w")) for name, text in fields.items()]
    rows = reduce(DataFrame.unionByName, split).where(F.size("w") > 0)
    return rows.mapInArrow(_count_terms(analyzer.stems), "field string, term string, id long, tf long, dl long")


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    analyzer: Analyzer
    folders: int

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def stats(self) -> DataFrame:
        return self._table("stats")

    def _rows(self, name: str, terms: Sequence[str], prefixes: Sequence[str], fields: Sequence[str] | None) -> DataFrame:
        if short := [p for p in prefixes if len(p) < HEAD]:
            raise ValueError(f"a prefix has {HEAD} characters or more: {short}")
        held = [F.col("term").isin(*terms)] if terms else []
        held += [F.col("term").startswith(p) for p in prefixes]
        rows = self._table(name).where(reduce(lambda a, b: a | b, held, F.lit(False)))
        folders = sorted({folder_of(t, self.folders) for t in (*terms, *prefixes)})
        rows = rows.where(F.col("folder").isin(*folders)) if folders else rows
        rows = rows.where(F.col("field").isin(*fields)) if fields else rows
        return rows.drop("folder")

    def postings(self, terms: Sequence[str] = (), prefixes: Sequence[str] = (), fields: Sequence[str] | None = None) -> DataFrame:
        """Postings of these terms and of those that begin so; only their folders are read."""
        return self._rows("postings", terms, prefixes, fields)

    def vocabulary(self, terms: Sequence[str] = (), prefixes: Sequence[str] = (), fields: Sequence[str] | None = None) -> DataFrame:
        return self._rows("terms", terms, prefixes, fields)


def build(docs: DataFrame, id_col: Column | str, fields: dict[str, Column], analyzer: Analyzer, path: str, folders: int = 64, slices: int = 1) -> Index:
    """Writes an index to ``path``, complete or not at all."""
    spark = docs.sparkSession
    with complete(spark, path) as aside:
        _write(docs, id_col, fields, analyzer, aside, folders, slices)
    return Index(spark, path, analyzer, folders)


def _write(docs: DataFrame, id_col: Column | str, fields: dict[str, Column], analyzer: Analyzer, aside: str, folders: int, slices: int) -> None:
    spark = docs.sparkSession
    rows = postings(docs, id_col, fields, analyzer).withColumn("folder", _folder(F.col("term"), folders))
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices))).repartition(folders * slices, "folder", "slice")
    dealt.drop("slice").sortWithinPartitions("folder", "term", "field", "id").write.partitionBy("folder").parquet(f"{aside}/postings")
    written = spark.read.parquet(f"{aside}/postings")
    terms = written.groupBy("folder", "field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    terms.repartition(folders, "folder").sortWithinPartitions("folder", "term").write.partitionBy("folder").parquet(f"{aside}/terms")
    total = spark.read.parquet(f"{aside}/terms").groupBy("field").agg(F.sum("cf").alias("total"))
    names = docs.agg(F.count("*").alias("n")).select(F.explode(F.array(*map(F.lit, fields))).alias("field"), "n")
    names.join(total, "field", "left").select("field", "n", F.coalesce("total", F.lit(0)).alias("total")).coalesce(1).write.parquet(f"{aside}/stats")


def open_or_build(spark: SparkSession, source: str, id_col: Column | str, fields: dict[str, Column], analyzer: Analyzer, folders: int = 64) -> Index:
    """The index of a stored table as it is now; built when there is none for this state of its files."""
    path = derived(spark, source, "-".join([analyzer.name, f"v{VERSION}", str(folders), *sorted(fields)]))
    if Files(spark).exists(path):
        return Index(spark, path, analyzer, folders)
    slices = 1 + Files(spark).size(source) // SLICE_BYTES
    return build(spark.read.parquet(source), id_col, fields, analyzer, path, folders, slices)


def expands(term: str) -> bool:
    """Is a query's term long enough to stand for all that begin with it?"""
    import re

    dense = re.search("[⺀-ヿ㐀-鿿ꀀ-꓏가-힯豈-﫿\U00020000-\U0002fa1f]", term)
    return len(term) >= (DENSE_PREFIX_FROM if dense else PREFIX_FROM)


def match(index: Index, words: Sequence[str], mode: str = "all", expand: bool = False, fields: Sequence[str] | None = None, scope: DataFrame | None = None) -> DataFrame:
    """(id, score, n_terms): BM25 of rows that hold all (or ``any``) of the words.

    ``expand`` takes a word that is long enough as a prefix as well: it then counts as
    often as all terms it stands for. Frequencies are those of the whole index;
    ``scope`` (id) picks rows afterwards, before any cap of the caller's. No words: no rows.
    """
    terms = list(dict.fromkeys(index.analyzer.terms(index.spark, words)))
    wide = [t for t in terms if expand and expands(t)]
    hits = index.postings(terms, wide, fields)
    if not terms:
        return hits.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("n_terms")).where("false")
    is_of = lambda t: F.col("term").startswith(t) if t in wide else F.col("term") == t
    own = [F.coalesce(F.sum(F.when(is_of(t), F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)]
    # A row's lengths in several fields add up; one field has one length, whichever of its terms says so.
    one = hits.groupBy("id", "field").agg(*own, F.max("dl").alias("dl"))
    if not fields or len(fields) > 1:
        one = one.groupBy("id").agg(*[F.sum(f"tf{i}").alias(f"tf{i}") for i in range(len(terms))], F.sum("dl").alias("dl"))
    tf = [F.col(f"tf{i}") for i in range(len(terms))]
    counts = one.agg(*[F.count_if(n > 0).alias(f"df{i}") for i, n in enumerate(tf)])
    table = index.stats().where(F.col("field").isin(*fields)) if fields else index.stats()
    average = table.agg(F.max("n").alias("n"), (F.sum("total") / F.max("n")).alias("avgdl"))
    kept = one if scope is None else one.join(scope.select("id"), "id", "left_semi")
    n_terms = reduce(lambda a, b: a + b, [(n > 0).cast("int") for n in tf])
    kept = kept.withColumn("n_terms", n_terms)
    kept = kept.where(F.col("n_terms") == len(terms)) if mode == "all" else kept
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    part = lambda i: F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(LEAST_IDF)) * tf[i] * (K1 + 1) / (tf[i] + norm)
    score = reduce(lambda a, b: a + b, [part(i) for i in range(len(terms))])
    return kept.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(average)).select("id", F.round(score, 6).alias("score"), "n_terms")  # one row each
