"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text.
A window of a text that shrinks more with the toxic dictionary speaks like toxic
text; by how many bytes, at most and in sum over the windows, and in how many
windows, is calibrated to a probability.

Training: segments (whole words, word beginnings, and pieces of scripts without
spaces) are counted by documents of each class in Spark, documents that have a
segment between the same two words as one: copies are no evidence of their own.
As toxic documents are mostly ordinary prose, zstandard's trainer gets of them what
tells: each document's words with a segment that is commoner in toxic text than
chance allows. The ordinary dictionary is trained on windows of ordinary text. Both
hold it, and the infixes of toxic segments that ordinary text shares, so that the
two lengths differ by toxic segments alone. Calibration takes documents that the
dictionaries have not seen. Where a class has too few texts for the trainer, the
samples themselves are the dictionary.

Bound of training: about ``max_toxic`` and ``max_ordinary`` labelled rows,
picked by a hash of the id where there are more. Everything else covers all rows,
whole texts, and keeps nothing between rows.

Defined results
* null and empty texts have no segment: the score of a text without evidence.
* null labels teach nothing; of repeated labels for an id the largest counts.
* no toxic or no ordinary label at all: score 0.
* repeated documents are scored each for itself; extra columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a window, of one word to three; windows end at word ends. In longer ones a telling word drowns among others.
WINDOW = 24
#: Bytes of a piece of a word without end.
LONGEST_WINDOW = 1024
#: zstandard refers to so many bytes at least.
MIN_MATCH = 7
#: Stands before, between and after words. With it a whole short word is a match, and a chance match inside a word is a long one.
GAP = b"   "
PREFIXES = (4, 5, 6, 7, 8)
#: Letters of a piece of a longer word.
LONGEST_WORD = 24
#: Letters of a piece of a script without spaces; shorter ones are under MIN_MATCH bytes.
GRAMS = (3, 4, 5)
#: A segment teaches only if so many documents of its class have it, copies apart.
LEAST_DOCS = 3
#: And if it is so many times likelier there than in the other class.
LEAST_ODDS = 4.0
#: And if it would be so likely there by chance at most, with all segments counted together.
CHANCE = 0.01
#: A longer segment replaces its own beginning if it tells at least this part as much.
SAME_Z = 0.8
#: Bytes of the ordinary dictionary, and of the toxic one for each byte of distinct telling segments.
ORDINARY_BYTES, TOXIC_SCALE = 8192, 4
#: Windows of an ordinary document that teach the ordinary dictionary.
WINDOWS_TAUGHT = 2
TABLE_BITS = 18
#: Part of unseen ordinary documents that the calibrated threshold refuses.
REFUSED = 0.015
#: Part of ordinary documents that makes an infix of a toxic segment common.
COMMON = 0.002

_WORDS = re.compile(r"[^\W\d_]+")
#: Thai to Burmese, Khmer, kana, Chinese characters.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")


def _words(text: str | None) -> list[bytes]:
    return [w.encode(errors="replace") for w in _WORDS.findall((text or "").lower())]


def _normal(text: str | None) -> bytes:
    words = _words(text)
    return GAP + GAP.join(words) + GAP if words else b""


def _spans(body: bytes) -> list[tuple[int, int]]:
    """A normalized text in windows of about ``WINDOW`` bytes; each begins with the gap that ended the one before."""
    out, at, last = [], 0, len(body) - len(GAP)
    while at < last:
        end = body.find(GAP, at + WINDOW // 2)
        end = last if end < 0 else end
        for cut in range(at, end, LONGEST_WINDOW):  # a word without end
            out.append((cut, min(cut + LONGEST_WINDOW, end + len(GAP))))
        at = end
    return out


def windows(text: str | None) -> list[bytes]:
    """The whole normalized text in windows."""
    body = _normal(text)
    return [body[a:b] for a, b in _spans(body)]


def _pieces(w: str) -> set[bytes]:
    """A word with the gaps round it, its beginnings after a gap, and pieces of scripts without spaces."""
    parts = [w[k : k + LONGEST_WORD].encode(errors="replace") for k in range(0, len(w), LONGEST_WORD)]
    parts[0] = GAP + parts[0]
    parts[-1] += GAP
    out = {p for p in parts if len(p) >= MIN_MATCH}
    out.update(GAP + w[:k].encode(errors="replace") for k in PREFIXES if len(w) > k)
    for run in _UNSPACED.findall(w):
        out.update(run[i : i + n].encode(errors="replace") for n in GRAMS for i in range(len(run) - n + 1))
    return out


def segments(text: str | None) -> set[bytes]:
    return set(contexts(text))


def contexts(text: str | None) -> dict[bytes, int]:
    """Segments, each with a hash of the words round its first place: copies of a text have the same."""
    words = _WORDS.findall((text or "").lower())
    out: dict[bytes, int] = {}
    known: set[str] = set()
    for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):  # none at all for a text without words
        if w not in known:
            known.add(w)
            at = zlib.crc32(f"{before} {after}".encode(errors="replace"))
            for p in _pieces(w):
                out.setdefault(p, at)
    return out


def _runs_of_bytes(body: bytes) -> np.ndarray:
    """Each ``MIN_MATCH`` bytes of the body as one number."""
    raw = np.frombuffer(body + bytes(8), np.uint8)
    return np.ndarray(len(body) - MIN_MATCH + 1, "<u8", raw, 0, (1,)) & np.uint64(2 ** (8 * MIN_MATCH) - 1)


def _slots(runs: np.ndarray) -> np.ndarray:
    return (runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """One per task: compressors are not shared."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._toxic, self._ordinary = self._compressor(model.toxic), self._compressor(model.ordinary)
        own = model.toxic[len(model.ordinary) :]
        # Runs of MIN_MATCH bytes that the toxic dictionary alone may match, and a table to look them up.
        self._grams = np.unique(_runs_of_bytes(own)) if len(own) >= MIN_MATCH else np.zeros(0, np.uint64)
        self._table = np.zeros(1 << TABLE_BITS, bool)
        self._table[_slots(self._grams)] = True

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        # Raw content: a trained header would differ between the two in more than their text.
        d = zstandard.ZstdCompressionDict(content.rjust(8, b"|"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        # The fast strategy with a target length leaves literals as they are: lengths then tell of matches alone.
        p = zstandard.ZstdCompressionParameters.from_level(
            1,
            source_size=256,
            dict_size=max(len(content), 8),
            strategy=zstandard.STRATEGY_FAST,
            target_length=1,
            min_match=MIN_MATCH,
            hash_log=16,
            write_content_size=False,
        )
        d.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=p)

    def _telling(self, body: bytes, spans: np.ndarray) -> np.ndarray:
        """Windows with ``MIN_MATCH`` bytes of the toxic dictionary's own part; the others save nothing."""
        runs = _runs_of_bytes(body)
        at = np.flatnonzero(self._table[_slots(runs)])
        at = at[np.isin(runs[at], self._grams)]
        if not len(at):
            return at
        first = np.searchsorted(at, spans[:, 0])
        return np.flatnonzero(at[np.minimum(first, len(at) - 1)] - spans[:, 0] + MIN_MATCH <= np.where(first < len(at), spans[:, 1] - spans[:, 0], -1))

    def evidence(self, text: str | None) -> tuple[float, float, float, float]:
        """Largest saving of a window, and logs of all savings, of the windows that save more than a byte, and of all windows."""
        toxic, ordinary = self._toxic.compress, self._ordinary.compress
        body = _normal(text)
        spans = _spans(body)
        n = len(spans)
        best = total = many = 0
        for i in self._telling(body, np.array(spans)).tolist() if n and len(body) >= MIN_MATCH else ():
            w = body[spans[i][0] : spans[i][1]]
            saved = len(ordinary(w)) - len(toxic(w))
            if saved > 0:
                total += saved
                many += saved > 1
                if saved > best:
                    best = saved
        return float(best), *(float(np.log1p(x)) for x in (total, many, n))

    def score(self, text: str | None) -> float:
        bias, *w = self.model.weights
        z = bias + sum(x * y for x, y in zip(w, self.evidence(text), strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Newton's method on a few weights; classes weigh as they occur, so a clean text needs evidence to be refused."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.r_[1e-3, np.ones(a.shape[1] - 1)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + penalty * w
        h = (a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, w))


def _content(counts: pd.DataFrame, n_toxic: int, n_ordinary: int) -> bytes:
    """All telling segments of toxic text, none the beginning of another.

    A dictionary of pure segments matters: zstandard refers to any ``MIN_MATCH``
    bytes of it, and each needless segment adds matches by chance. A segment is
    judged by its own counts alone, so a common one never hides a rare one.
    """
    n = counts["toxic"]
    odds = np.log((n + 0.5) / (n_toxic + 1)) - np.log((counts["ordinary"] + 0.5) / (n_ordinary + 1))
    # Chernoff's bound: so many of its documents are toxic by chance with a probability of at most exp(-documents * divergence).
    both, part = n + counts["ordinary"], n_toxic / (n_toxic + n_ordinary)
    seen = (n / both).clip(1e-12, 1 - 1e-12)
    chance = -both * (seen * np.log(seen / part) + (1 - seen) * np.log((1 - seen) / (1 - part)))
    pure = (odds >= np.log(LEAST_ODDS)) & (n >= LEAST_DOCS) & (chance <= np.log(CHANCE / max(1, len(counts))))
    keep = counts.assign(z=odds * np.sqrt(n))[pure]
    keep = keep.assign(size=-keep["segment"].map(len)).sort_values(["z", "size", "segment"], ascending=[False, True, True])
    chosen: dict[bytes, float] = {}
    heads: dict[bytes, bytes] = {}  # every beginning of a chosen segment
    for s, z in zip(keep["segment"].map(bytes), keep["z"], strict=True):
        if s in heads:
            continue
        inner = next((s[:k] for k in range(len(s) - 1, 0, -1) if s[:k] in chosen), None)
        if inner is not None:
            if z < SAME_Z * chosen[inner]:
                continue
            del chosen[inner]  # the longer one tells as much and shrinks a window more
        chosen[s] = z
        heads.update((s[:k], s) for k in range(1, len(s) + 1))
    return b"".join(s + b"|" for s in reversed(chosen))


def _common_infixes(taught: DataFrame, toxic: bytes, n_toxic: int, n_ordinary: int) -> bytes:
    """What ordinary text has in common with the toxic dictionary and is no sign of toxic text, the commonest last.

    With it in the ordinary dictionary, a chance match inside an ordinary word
    shrinks a window alike with both, and only whole toxic segments tell.
    """
    segs = [s for s in toxic.split(b"|") if s]
    infixes = {s[i:j] for s in segs for i in range(len(s)) for j in range(i + MIN_MATCH, len(s) + 1)}

    def held(body: bytes) -> set[bytes]:
        out: set[bytes] = set()
        for i in range(len(body) - MIN_MATCH + 1):
            j = i + MIN_MATCH
            while j <= len(body) and (x := body[i:j]) in infixes:  # every infix's beginning is one too
                out.add(x)
                j += 1
        return out

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())
        for f in frames:
            for t, label, fold in zip(f["text"], f["__toxic"], f["__fold"], strict=True):
                if fold:
                    seen[label].update(held(_normal(t)))
        yield pd.DataFrame([(x, n, k) for k in (0, 1) for x, n in seen[k].items()], columns=["infix", "n", "toxic"])

    of = lambda label: F.sum(F.when(F.col("toxic") == label, F.col("n")).otherwise(0))
    counted = taught.mapInPandas(count, "infix binary, n long, toxic int").groupBy("infix").agg(of(0).alias("n"), of(1).alias("m"))
    common = [
        (int(r["n"]), bytes(r["infix"]))
        for r in counted.collect()
        if r["n"] >= max(1, COMMON * n_ordinary) and r["m"] / n_toxic < LEAST_ODDS * r["n"] / n_ordinary
    ]
    # An infix of an infix adds nothing; what is inside a common one is common, so one byte less tells.
    inner = {y for _, x in common for y in (x[1:], x[:-1])}
    return b"|".join(x for _, x in sorted(common) if x not in inner) + b"|"


def _trained(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little text for zstandard's trainer
        return b"".join(samples)[-size:]


def _taught_samples(taught: DataFrame, telling: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Samples of both classes, in a fixed order: words of toxic documents with telling segments, windows of ordinary ones."""
    known = frozenset(telling)

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for f in frames:
            for i, t, label, fold in zip(f["__id"], f["text"], f["__toxic"], f["__fold"], strict=True):
                if fold and label:
                    # Of each such word the longest telling segment: the rest of it is ordinary.
                    told = [max(p, key=len) for w in _WORDS.findall((t or "").lower()) if (p := _pieces(w) & known)]
                    if told:
                        rows.append((str(i), 1, b"|".join(told) + b"|"))
                elif fold:
                    rows += [(str(i), 0, w) for w in windows(t)[:: max(1, len(windows(t)) // WINDOWS_TAUGHT)][:WINDOWS_TAUGHT]]
        yield pd.DataFrame(rows, columns=["id", "toxic", "sample"])

    # Bounded by max_toxic + max_ordinary documents.
    rows = sorted((r["toxic"], r["id"], bytes(r["sample"])) for r in taught.mapInPandas(pick, "id string, toxic int, sample binary").collect())
    return [s for k, _, s in rows if k], [s for k, _, s in rows if not k]


def sample(labels: DataFrame, id_col: str, label_col: str, max_toxic: int, max_ordinary: int) -> DataFrame:
    """(id, toxic, fold) of about so many labelled rows of each class."""
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(label_col).cast("int").alias("__toxic"))
    )
    n = {r["__toxic"]: r["count"] for r in known.groupBy("__toxic").count().collect()}
    draw = F.pmod(F.xxhash64("__id"), F.lit(1_000_000))
    part = F.when(F.col("__toxic") == 1, F.lit(min(1.0, max_toxic / max(1, n.get(1, 0))) * 1e6)).otherwise(
        F.lit(min(1.0, max_ordinary / max(1, n.get(0, 0))) * 1e6)
    )
    return known.where(draw < part).withColumn("__fold", F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(4)))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_toxic: int = 4000,
    max_ordinary: int = 8000,
) -> Model:
    picked = sample(labels, id_col, label_col, max_toxic, max_ordinary)
    # At most max_toxic + max_ordinary rows, give or take the hash: small enough to send everywhere.
    taught = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "__id")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[bytes, int, int]] = set()
        docs_of = Counter()
        for f in frames:
            for t, label, fold in zip(f["text"], f["__toxic"], f["__fold"], strict=True):
                if fold:
                    seen.update((s, label, at) for s, at in contexts(t).items())
                    docs_of[label] += 1
        whole = [(b"", label, TaskContext.get().partitionId(), n) for label, n in docs_of.items()]
        yield pd.DataFrame([*((*x, 1) for x in seen), *whole], columns=["segment", "toxic", "at", "n"])

    of = lambda label: F.sum(F.when(F.col("toxic") == label, F.col("n")).otherwise(0))
    summed = (
        taught.mapInPandas(count, "segment binary, toxic int, at long, n long")
        .groupBy("segment", "toxic", "at")
        .agg(F.max("n").alias("n"))  # one place, however many copies
        .groupBy("segment")
        .agg(of(1).alias("toxic"), of(0).alias("ordinary"))
    )
    # Segments of one or two documents teach nothing; the rest are few in a bounded sample.
    counts = summed.where((F.greatest("toxic", "ordinary") >= LEAST_DOCS) | (F.octet_length("segment") == 0)).toPandas()
    whole = counts[counts["segment"].map(len) == 0]
    n1, n0 = int(whole["toxic"].sum()), int(whole["ordinary"].sum())
    if not n1 or not n0:
        return Model(b"", b"", (-30.0, 0.0, 0.0, 0.0, 0.0))
    counts = counts[counts["segment"].map(len) > 0]
    telling = _content(counts, n1, n0)
    segments_told = [x for x in telling.split(b"|") if x]
    of_toxic, of_ordinary = _taught_samples(taught, segments_told)
    # What ordinary text has stands in both, as toxic documents are mostly ordinary prose.
    ordinary = _trained(of_ordinary, ORDINARY_BYTES) + b"|" + _common_infixes(taught, telling, n1, n0)
    toxic = ordinary + (_trained(of_toxic, max(1024, TOXIC_SCALE * len(telling))) + b"|" + telling if of_toxic else b"")
    draft = Model(toxic, ordinary, (0.0, 0.0, 0.0, 0.0, 0.0))

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = draft.scorer()
        for f in frames:
            rows = [(*s.evidence(t), y, k) for t, y, k in zip(f["text"], f["__toxic"], f["__fold"], strict=True)]
            yield pd.DataFrame(rows, columns=["best", "total", "many", "n", "y", "fold"])

    seen = taught.mapInPandas(measure, "best double, total double, many double, n double, y int, fold long").toPandas()
    unseen = seen[seen["fold"] == 0]
    if unseen["y"].sum() < 5 or (1 - unseen["y"]).sum() < 5:
        unseen = seen
    x, y = unseen[["best", "total", "many", "n"]].to_numpy(float), unseen["y"].to_numpy(float)
    bias, *slopes = _fit_logistic(x, y)
    # The threshold is where so few unseen ordinary texts are refused; a small fold moves it little.
    limit = float(np.quantile((bias + x @ slopes)[y == 0], 1 - REFUSED)) if (y == 0).any() else 0.0
    weights = (bias - float(np.clip(limit, -2, 2)), *slopes)
    return Model(toxic, ordinary, weights)


def score(df: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds double column ``out``: the probability of label 1 for each whole text."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = model.scorer()
        for t in texts:
            yield pd.Series([s.score(x) for x in t], dtype=float)

    return df.withColumn(out, scored(F.col(text_col)))


def id_bucket(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "utf-8")) % n
