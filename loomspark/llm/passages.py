"""Removal of repeated passages by Rabin-Karp hashes of every word window.

1. Tasks hash each window of ``WINDOW`` words, in blocks of ``BLOCK`` bytes. Of
   windows that recur in a block the earliest is sent on; the others are compared
   with it word by word and marked on the spot, as intervals. So a passage that a
   third of all documents share is one row per block, not one per document.
2. Windows meet by hash in groups of about ``GROUP`` bytes of text each, however
   much text there is. All but the earliest of equal hash become candidates, each
   with its source, that earliest window.
3. Candidates meet by document and join to runs that follow a run of their source.
4. Every run and its source are compared by 128-bit cryptographic digests of their
   words. A run whose words differ (two passages with one hash) is taken apart, and
   its windows and its source's are classed by digests of their own.
5. Runs meet their documents, overlapping ones merge into maximal intervals of
   words, and the intervals are cut out.

Hashes only find candidates; no word goes because of an equal hash. Rows of a
group are streamed in order, so a task holds one group or one document's marks.

Order of windows: by document id, then start. Defined results
* null text: no words. A text shorter than a window loses nothing.
* rows that share an id count as one document: of two windows with equal id and
  start neither is the earlier, and a mark counts for those rows whose words it
  names. A null id comes first; so does id -2**63.
* empty table: no rows. Other columns pass through, whatever their names; columns
  of ``schema`` replace columns of the same name, and the text column goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.store import Scratch
from loomspark.llm.words import DIGEST, Block, blocks, mix

WINDOW = 20
#: Bytes of text that are hashed at once, more where there are many groups; a longer text is a block of its own.
BLOCK, LARGEST_BLOCK, BLOCK_BYTES_PER_GROUP = 1_000_000, 4_000_000, 400
#: Bytes of text whose windows, or whose marks, make a group.
GROUP = 4_000_000
#: Groups of a task.
GROUPS_PER_TASK = 16
NULL_ID = -(2**63)

_U = np.uint64
_CLAIMS = "part long, ids binary, counts binary, starts binary, hashes binary, runs binary, digests binary"
_MARKS = "part long, windows binary, runs binary, digests binary"
_RUNS = "id long, from long, n long, source long, at long, digest binary"
_DIGESTS = "id long, from long, n long, digest binary"


def _later(hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows for which one of equal hash stands earlier, and the earliest such for each."""
    order = np.argsort(hashes)
    h = hashes[order]
    same = h[1:] == h[:-1]
    if not same.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    some = order[np.r_[same, False] | np.r_[False, same]]
    some = some[np.lexsort((starts[some], ids[some], hashes[some]))]
    h = hashes[some]
    head = np.r_[True, h[1:] != h[:-1]]
    first = some[np.maximum.accumulate(np.where(head, np.arange(len(some)), 0))]
    late = (ids[some] != ids[first]) | (starts[some] != starts[first])
    return some[late], first[late]


def _planes(*columns: np.ndarray) -> bytes:
    """Numbers in planes of bytes: Spark's codec then shrinks the upper planes to nothing."""
    x = np.stack(columns).astype("<i8") if len(columns) > 1 else columns[0].astype("<i8")
    return np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(b: bytes, columns: int = 1) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)
    return x.reshape(columns, -1) if columns > 1 else x


def _pack_places(ids: np.ndarray, start: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Windows text after text -> the texts' ids, windows per text, starts."""
    head = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    gap = np.diff(start, prepend=0)
    gap[head] = start[head]
    return _planes(np.diff(ids[head], prepend=0)), _planes(np.diff(np.r_[head, len(ids)])), _planes(gap)


def _unpack_places(ids: bytes, counts: bytes, starts: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, start = _unplanes(counts), np.cumsum(_unplanes(starts))
    head = np.r_[0, np.cumsum(n)[:-1]]
    before = np.r_[0, start][head]  # what the sum had reached when a text began
    return np.repeat(np.cumsum(_unplanes(ids)), n), start - np.repeat(before, n)


def _runs(*sequences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows and lengths of stretches over which ids (even columns) stay and places (odd ones) rise by one."""
    if not len(sequences[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(sequences[0]) - 1, bool)
    for k, x in enumerate(sequences):
        cut |= x[1:] != x[:-1] + (k & 1)
    head = np.r_[0, np.flatnonzero(cut) + 1]
    return head, np.diff(np.r_[head, len(sequences[0])])


def _pieces(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Stretches of equal numbers in a sorted array."""
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)].tolist() if len(part) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(part[a]), slice(a, b)


def _rows(kind: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "binary": pa.binary()}
    shape = pa.schema([(c.split()[0], types[c.split()[1]]) for c in kind.split(", ")])
    columns = zip(*rows, strict=True) if rows else [[] for _ in shape]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, shape, strict=True)], schema=shape)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    return (mix(x.astype(np.int64).view(_U)) % _U(parts)).astype(np.int64)


def _repeats_in(b: Block, ids: np.ndarray, hashes: np.ndarray, at: np.ndarray, text: np.ndarray):
    """Windows that repeat an earlier one of the block, as compared runs (id, start, n, digest); and all other windows."""
    own, start = ids[text], at - b.edges[text]
    late, first = _later(hashes, own, start)
    order = np.argsort(at[late])
    late, first = late[order], first[order]
    head, n = _runs(text[late], at[late], text[first], at[first])
    found, gone = [], np.zeros(len(hashes), bool)
    for h, k in zip(head.tolist(), n.tolist(), strict=True):
        w, v, size = int(at[late[h]]), int(at[first[h]]), k + WINDOW - 1
        if b.same(w, v, size):
            gone[late[h : h + k]] = True
            found.append((int(own[late[h]]), int(start[late[h]]), k, b.digest(w, w + size)))
    return found, np.flatnonzero(~gone)


def _claims(parts: int, mask: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = min(LARGEST_BLOCK, max(BLOCK, parts * BLOCK_BYTES_PER_GROUP))
        for batch in batches:
            every = _ids(batch.column("id"))
            for lo, hi, b in blocks(batch.column("text"), size):
                ids = every[lo:hi]
                hashes, at, text = b.windows(WINDOW)
                hashes = hashes & _U(mask)
                found, left = _repeats_in(b, ids, hashes, at, text)
                part = (hashes[left] % _U(parts)).astype(np.int64)
                order = left[np.argsort(part, kind="stable")]
                own, start = ids[text[order]], (at - b.edges[text])[order]
                rows = [
                    (p, *_pack_places(own[s], start[s]), hashes[order[s]].astype("<u8").tobytes(), b"", b"")
                    for p, s in _pieces(np.sort(part))
                ]
                if found:  # anywhere: compared runs only pass through
                    i, a, n, digest = zip(*found, strict=True)
                    packed = _planes(np.array(i, np.int64), np.array(a), np.array(n))
                    rows.append((i[0] % parts, b"", b"", b"", b"", packed, b"".join(digest)))
                if rows:
                    yield _rows(_CLAIMS, rows)

    return claim


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one ``part`` after another; they lie in its order."""
    part, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["part"] != part and rows:
                yield rows
                rows = []
            part = r["part"]
            rows.append(r)
    if rows:
        yield rows


def _compared(rows: list[dict]) -> tuple[np.ndarray, list[bytes]]:
    runs = [_unplanes(r["runs"], 3) for r in rows if r["runs"]]
    raw = b"".join(r["digests"] for r in rows if r["runs"])
    return np.concatenate(runs, axis=1) if runs else np.zeros((3, 0), np.int64), [raw[k : k + DIGEST] for k in range(0, len(raw), DIGEST)]


def _candidates(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            claims = [r for r in rows if r["hashes"]]
            marks = np.zeros((4, 0), np.int64)
            if claims:
                places = [_unpack_places(r["ids"], r["counts"], r["starts"]) for r in claims]
                hashes = np.concatenate([np.frombuffer(r["hashes"], "<u8") for r in claims])
                ids, starts = (np.concatenate(x) for x in zip(*places, strict=True))
                late, first = _later(hashes, ids, starts)
                marks = np.stack([ids[late], starts[late], ids[first], starts[first]])
            to = _part(marks[0], parts)
            order = np.lexsort((marks[1], marks[0], to))
            marks = marks[:, order]
            made = [(p, _planes(*marks[:, s]), b"", b"") for p, s in _pieces(to[order])]
            runs, digests = _compared(rows)
            to = _part(runs[0], parts)
            order = np.argsort(to, kind="stable")
            made += [
                (p, b"", _planes(*runs[:, order[s]]), b"".join(digests[k] for k in order[s].tolist())) for p, s in _pieces(to[order])
            ]
            if made:
                yield _rows(_MARKS, made)

    return meet


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches):
        marks = [_unplanes(r["windows"], 4) for r in rows if r["windows"]]
        m = np.concatenate(marks, axis=1) if marks else np.zeros((4, 0), np.int64)
        m = m[:, np.lexsort((m[1], m[0]))]
        head, n = _runs(*m)
        first = m[:, head]
        runs, digests = _compared(rows)
        none = [None] * len(head)
        columns = [
            *(pa.array(np.r_[a, b]) for a, b in ((first[0], runs[0]), (first[1], runs[1]), (n, runs[2]))),
            *(pa.array([*x.tolist(), *[None] * len(digests)], pa.int64()) for x in first[2:]),
            pa.array([*none, *digests], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _RUNS.split(", ")])


def _tasks(spark: SparkSession, n_bytes: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // (GROUP * GROUPS_PER_TASK)))


def _dealt(df: DataFrame, tasks: int, key: str, *order: str) -> DataFrame:
    return df.repartition(tasks, key).sortWithinPartitions(key, *order)


def candidate_runs(texts: DataFrame, n_bytes: int, tasks: int, hash_bits: int) -> DataFrame:
    """(id, from, n, source, at, digest) of ``texts`` (id, text): n windows from ``from`` on may repeat those of source.

    A null source: the run was compared already, and ``digest`` is that of its words.
    """
    parts = max(1, -(-n_bytes // GROUP))
    # Parts are numbers without gaps: dealt in turn, each task gets as many as the next.
    turn = (F.col("part") % tasks).cast("int")
    met = lambda df: df.repartitionById(tasks, turn).sortWithinPartitions("part")
    claims = met(texts.mapInArrow(_claims(parts, 2**hash_bits - 1), _CLAIMS))
    marks = met(claims.mapInArrow(_candidates(parts), _MARKS))
    return marks.mapInArrow(_join_runs, _RUNS)


def _beside(rows: DataFrame, texts: DataFrame, tasks: int) -> DataFrame:
    """Rows (id, from, n, digest) and the texts of their documents in one stream: by id, rows before texts."""
    columns = [*rows.columns, *(c for c in texts.columns if c != "id")]
    both = rows.withColumn("kind", F.lit(0)).unionByName(texts.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return _dealt(both.select("kind", *columns), tasks, "id", "kind")


def digests(spans: DataFrame, texts: DataFrame, tasks: int) -> DataFrame:
    """(id, from, n, digest) of spans (id, from, n) of windows; as many rows as the id has texts with that many words."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: int | None = None
        asked: list[tuple[int, int]] = []
        for batch in batches:
            out, ids, kinds = [], _ids(batch.column("id")), batch.column("kind").to_numpy()
            starts, ns = batch.column("from"), batch.column("n")
            for i, j in _same(ids, kinds):
                if ids[i] != known:
                    known, asked = int(ids[i]), []
                if not kinds[i]:
                    asked += zip(starts[i:j].to_pylist(), ns[i:j].to_pylist(), strict=True)
                elif asked:
                    for _, _, b in blocks(batch.column("text")[i:j], 1):  # text by text
                        words = len(b.begin)
                        out += [(known, a, n, b.digest(a, a + n + WINDOW - 1)) for a, n in asked if a + n + WINDOW - 1 <= words]
            if out:
                yield _rows(_DIGESTS, out)

    return _beside(spans, texts, tasks).mapInArrow(look, _DIGESTS).distinct()


def _same(ids: np.ndarray, kinds: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (kinds[1:] != kinds[:-1])) + 1
    edges = [0, *cuts.tolist(), len(ids)] if len(ids) else []
    yield from zip(edges[:-1], edges[1:], strict=True)


def repeated_runs(scratch: Scratch, texts: DataFrame, n_bytes: int, tasks: int, hash_bits: int = 64) -> DataFrame:
    """(id, from, n, digest): runs of windows whose words stand earlier."""
    runs = scratch.keep(candidate_runs(texts, n_bytes, tasks, hash_bits), "runs")
    open_runs = runs.where("source IS NOT NULL")
    spans = open_runs.select("id", "from", "n").unionByName(open_runs.select(F.col("source").alias("id"), F.col("at").alias("from"), "n"))
    told = scratch.keep(digests(spans.distinct(), texts, tasks), "digests")
    theirs = told.select(F.col("id").alias("source"), F.col("from").alias("at"), "n", F.col("digest").alias("theirs"))
    met = open_runs.drop("digest").join(told, ["id", "from", "n"]).join(theirs, ["source", "at", "n"])
    equal = met.groupBy("id", "from", "n", "source", "at").agg(F.max(F.when(F.col("digest") == F.col("theirs"), F.col("digest"))).alias("digest"))
    judged = scratch.keep(equal, "judged")
    # A source has one digest where its id has one text; more digests of one run are for rows that share an id.
    sure = runs.where("source IS NULL").unionByName(judged.where("digest IS NOT NULL"))
    out = sure.select("id", "from", "n", "digest")
    torn = judged.where("digest IS NULL")
    if torn.isEmpty():
        return out
    windows = lambda i, a: torn.select(F.col(i).alias("id"), F.explode(F.sequence(F.col(a), F.col(a) + F.col("n") - 1)).alias("from"))
    single = windows("id", "from").unionByName(windows("source", "at")).distinct().withColumn("n", F.lit(1).cast("long"))
    own = digests(single, texts, tasks)
    place = F.struct("id", "from")
    first = own.groupBy("digest").agg(F.min(place).alias("first"))
    later = own.join(first, "digest").where(place != F.col("first")).select("id", "from", "n", "digest")
    return out.unionByName(scratch.keep(later, "later"))


def removed_words(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals [from, to) of words -> maximal ones."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def kept_text(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the words in ``spans``, other white space as it was."""
    if not spans:
        return raw.decode()
    data = np.frombuffer(b" " + raw + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begin = np.flatnonzero(np.diff(space.view(np.int8)) == -1)
    starts = [*begin.tolist(), len(raw)]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = starts[b]
    out.append(raw[at:])
    return b"".join(out).rstrip(b" \t\n\v\f\r").decode()


Finish = Callable[[bytes, list[tuple[int, int]]], tuple]


def dedup_passages(
    spark: SparkSession,
    docs: DataFrame,
    finish: Finish,
    schema: list[tuple[str, pa.DataType, str]],
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_bits: int = 64,
) -> DataFrame:
    """Documents without their text, with the columns of ``schema`` that ``finish`` makes of it.

    ``finish(raw, spans)`` gets a whole text and the maximal intervals of its
    words that repeat earlier ones. ``schema``: name, Arrow type and SQL type.
    ``hash_bits``: how much of a hash finds candidates; fewer bits cost time, never words.
    """
    scratch = Scratch(spark, "passages")
    new = {n for n, _, _ in schema}
    key: Column = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id")
    texts = docs.select(key, F.col(text_col).alias("text"))
    n_bytes = int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    tasks = _tasks(spark, n_bytes)
    marked = repeated_runs(scratch, texts, n_bytes, tasks, hash_bits)
    others = [c for c in docs.columns if c != text_col and c not in new]
    # Other columns travel as one struct: their names cannot clash with those used here.
    whole = docs.select(key, F.col(text_col).alias("text"), F.struct(F.lit(1).alias("_"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(others)]).alias("row"))
    stream = _beside(marked, whole, tasks)
    row_type = stream.schema["row"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: int | None = None
        marks: list[tuple[int, int, bytes]] = []
        for batch in batches:
            made, kept = [], []
            ids, kinds = _ids(batch.column("id")), batch.column("kind").to_numpy()
            starts, ns, sums = (batch.column(c) for c in ("from", "n", "digest"))
            for i, j in _same(ids, kinds):
                if ids[i] != known:
                    known, marks = int(ids[i]), []
                if not kinds[i]:
                    marks += zip(starts[i:j].to_pylist(), ns[i:j].to_pylist(), sums[i:j].to_pylist(), strict=True)
                    continue
                for k in range(i, j):
                    raw = (batch.column("text")[k].as_py() or "").encode()
                    made.append(finish(raw, _own(raw, marks)))
                    kept.append(k)
            columns = zip(*made, strict=True) if made else [[] for _ in schema]
            arrays = [pa.array(v, t) for v, (_, t, _) in zip(columns, schema, strict=True)]
            row = batch.column("row").take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([row, *arrays], names=["row", *(f"n{k}" for k in range(len(schema)))])

    shape = ", ".join([f"row {row_type}", *(f"n{k} {t}" for k, (_, _, t) in enumerate(schema))])
    done = scratch.keep(stream.mapInArrow(cut, shape), "result")
    scratch.drop_all_but("result")
    return done.select(
        *[F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(others)], *[F.col(f"n{k}").alias(n) for k, (n, _, _) in enumerate(schema)]
    )


def _own(raw: bytes, marks: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
    """Maximal intervals of words of those marks whose words are this text's."""
    if not marks:
        return []
    words = raw.split()
    spans = []
    for a, n, digest in marks:
        b = a + n + WINDOW - 1
        if hashlib.blake2b(b" ".join(words[a:b]), digest_size=DIGEST).digest() == digest:
            spans.append((a, b))
    return removed_words(spans)
