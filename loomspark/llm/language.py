"""Language identification by rank order of n-grams.

A profile is the most frequent letter n-grams (1 to 3, words padded with a
blank) of a language, by rank. A document's own ranking is compared with each
profile by out-of-place distance: the sum, over the document's n-grams, of how
far the ranks lie apart, an n-gram outside the profile costing the most.

Bound of training: about ``max_docs`` documents of each language, picked by a
hash of the id where there are more. Predictions cover every whole text, row by
row; nothing is kept between rows.

Defined results
* null text, or a text without letters: ``und``, score 0.
* no labelled document: every text is ``und``.
* null languages teach nothing; ties in frequency go by n-gram, ties in
  distance by language name.
* repeated documents are judged each for itself; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: n-grams of a profile and of a document.
TOP = 300
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Characters that are counted at once.
BLOCK = 1_000_000
_BITS = 21  # of a code point


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


class Counter:
    """n-gram counts of many texts at once. An n-gram is its code points, 21 bits each, left-aligned by a leading one."""

    def __init__(self) -> None:
        self._is_letter = _letters()

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, n-gram, count), sorted by the first two."""
        lowered = [t.lower() for t in texts]
        points = np.frombuffer("\0".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
        letter = self._is_letter[points]
        # Runs of anything else shrink to one blank; a blank stands before the first letter too.
        keep = letter | np.r_[True, letter[:-1]]
        sym, owner = np.where(letter, points, 0)[keep].astype(np.int64), owner[keep]
        sym, owner = np.r_[0, sym], np.r_[owner[:1], owner]
        # Small numbers for the letters at hand, in code point order, so that text number and n-gram share 64 bits.
        alphabet = np.flatnonzero(np.bincount(sym, minlength=1))
        small = np.zeros(int(alphabet[-1]) + 1, np.int64)
        small[alphabet] = np.arange(len(alphabet))
        s, base = small[sym], len(alphabet) + 1
        if base**3 * (len(texts) + 1) >= 2**62:  # many scripts: fewer texts at once
            half = len(texts) // 2
            (a, b, c), (d, e, f) = self.count(texts[:half]), self.count(texts[half:])
            return np.r_[a, d + half], np.r_[b, e], np.r_[c, f]
        keys = []
        for n in ORDERS:
            m = len(s) - n + 1
            if m <= 0:
                continue
            code = np.zeros(m, np.int64)
            for k in range(n):
                code = code * base + s[k : k + m] + 1
            code += 0 if n == 3 else base**3 if n == 2 else base**3 + base**2
            mid = sym[1 : 1 + m] if n == 3 else None
            ok = sym[:m] != 0 if n == 1 else (sym[:m] != 0) | (sym[1 : 1 + m] != 0) if n == 2 else mid != 0
            keys.append((owner[n - 1 :] * (2 * base**3) + code)[ok])
        found, count = np.unique(np.concatenate(keys), return_counts=True)
        text, code = np.divmod(found, 2 * base**3)
        return text, self._wide(code, base, alphabet), count

    @staticmethod
    def _wide(code: np.ndarray, base: int, alphabet: np.ndarray) -> np.ndarray:
        """Codes over the alphabet at hand -> the same n-grams for every batch."""
        three, two = code < base**3, code < base**3 + base**2
        rest = np.where(three, code, np.where(two, code - base**3, code - base**3 - base**2))
        letters = np.r_[0, alphabet]  # 0: no symbol
        out = np.zeros(len(code), np.int64)
        for shift in (0, 1, 2):
            rest, d = np.divmod(rest, base)
            # A blank and no symbol are told apart by adding one to code points.
            out |= np.where(d > 0, letters[d] + 1, 0) << (_BITS * shift)
        return out


def ranked(text: np.ndarray, gram: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, rank from 0) of the TOP n-grams of each text."""
    order = np.lexsort((gram, -count, text))
    text, gram = text[order], gram[order]
    first = np.searchsorted(text, np.arange(n))
    rank = np.arange(len(text)) - first[text]
    top = rank < TOP
    return text[top], gram[top], rank[top]


def blocks(texts: list[str]) -> Iterator[list[str]]:
    """A long text is a block of its own, never cut."""
    out, size = [], 0
    for t in texts:
        if out and size + len(t) > BLOCK:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = 4000) -> dict[str, list[int]]:
    """Language -> n-grams by rank, from the labelled rows given."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    part = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, max_docs / n) * 1e6)])
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000))
    picked = known.where(draw < F.element_at(part, F.col("lang")))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter()
        for f in frames:
            for lang, g in f.groupby("lang"):
                parts = [counter.count(b)[1:] for b in blocks(list(g["text"]))]
                gram, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pd.DataFrame({"lang": lang, "gram": gram, "n": n})

    counted = picked.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # TOP rows for each language: the aggregate keeps no more than that of any group.
    best = counted.groupBy("lang").agg(F.expr(f"slice(sort_array(collect_list(struct(-n AS n, gram))), 1, {TOP})").alias("top"))
    return {r["lang"]: [x["gram"] for x in r["top"]] for r in best.collect()}


LANGUAGE = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


class Judge:
    """Profiles as one sorted table, for all languages at once."""

    def __init__(self, profiles: dict[str, list[int]]) -> None:
        self.names = sorted(profiles)
        self.grams = np.unique(np.concatenate([np.array(profiles[k], np.int64) for k in self.names] or [np.zeros(0, np.int64)]))
        # Rank of each n-gram in each language; the last row is for n-grams of no profile.
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        for j, k in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[k], np.int64)), j] = np.arange(len(profiles[k]))
        self.counter = Counter()

    def judge(self, texts: list[str]) -> list[tuple[str, float]]:
        n = len(texts)
        if not self.names or not n:
            return [(UNKNOWN, 0.0)] * n
        text, gram, rank = ranked(*self.counter.count(texts), n)
        at = np.searchsorted(self.grams, gram)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != gram)] = len(self.grams)
        theirs = self.ranks[at]
        apart = np.where(theirs < 0, TOP, np.abs(theirs - rank[:, None]))
        size = np.bincount(text, minlength=n)
        dist = np.column_stack([np.bincount(text, weights=apart[:, j], minlength=n) for j in range(len(self.names))])
        near = 1 - dist / np.maximum(size * TOP, 1)[:, None]
        best = near.argmax(1)
        return [(self.names[b], float(near[i, b])) if size[i] else (UNKNOWN, 0.0) for i, b in enumerate(best)]


def identify(df: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", out: str = "language") -> DataFrame:
    """Adds struct column ``out``: the nearest language and 1 less its distance as part of the largest possible one."""

    @F.pandas_udf(LANGUAGE)
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        j = Judge(profiles)
        for t in texts:
            rows = [r for b in blocks(["" if x is None else x for x in t]) for r in j.judge(b)]
            yield pd.DataFrame(rows, columns=LANGUAGE.names)

    return df.withColumn(out, judged(F.col(text_col)))
