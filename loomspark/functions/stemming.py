"""Accent folding as a Column, and Porter's suffix stripping over columns of terms.

The stemmer sees each distinct term of an Arrow batch once; what a worker has seen
lately it looks up.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Last code point whose letters are folded: Latin, Greek and Cyrillic with their extensions are below.
_LAST = 0x1FFF

# Fixed values of the algorithm (M. F. Porter, 1980, with the two amended rules of step 2): suffix and what stands in for it.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
#: Terms outside these lengths stay as they are.
SHORTEST, LONGEST = 3, 64


@lru_cache
def _accents() -> tuple[str, str]:
    """Letters whose canonical decomposition is a base and marks, and their bases; marks have none."""
    pairs, marks = {}, []
    for c in map(chr, range(0x80, _LAST + 1)):
        if unicodedata.combining(c):
            marks.append(c)
        elif (base := unicodedata.normalize("NFD", c)[0]) != c and all(map(unicodedata.combining, unicodedata.normalize("NFD", c)[1:])):
            pairs[c] = base
    return "".join(pairs) + "".join(marks), "".join(pairs.values())


def fold_accents(text: Column) -> Column:
    """Base letters without their marks; combining marks go. Plain ASCII is left as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.translate(text, *_accents()))


def _shape(word: str) -> str:
    """c and v for each letter: y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def _short(word: str, shape: str) -> bool:
    """Does it end in consonant, vowel, consonant, the last being none of w, x, y?"""
    return shape[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, rules: dict[str, str]) -> str:
    """The longest suffix of the rules gives way if something with a measure above 0 stands before it."""
    for n in range(min(len(word), 7), 1, -1):
        if (new := rules.get(word[-n:])) is not None:
            return word[:-n] + new if "vc" in _shape(word[:-n]) else word
    return word


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    if not SHORTEST <= len(word) <= LONGEST:
        return word
    if word.endswith("s"):
        if word.endswith(("sses", "ies")):
            word = word[:-2]
        elif not word.endswith("ss"):
            word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if "vc" in _shape(word[:-3]) else word
    else:
        for suffix in ("ed", "ing"):
            base = word.removesuffix(suffix)
            if base != word and "v" in _shape(base):
                shape = _shape(base)
                if base.endswith(("at", "bl", "iz")):
                    word = base + "e"
                elif len(base) > 1 and base[-1] == base[-2] and shape[-1] == "c" and base[-1] not in "lsz":
                    word = base[:-1]
                else:
                    word = base + "e" if shape.count("vc") == 1 and _short(base, shape) else base
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2), STEP_3)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if _shape(base).count("vc") > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        shape = _shape(base)
        if shape.count("vc") > 1 or (shape.count("vc") == 1 and not _short(base, shape)):
            word = base
    if word.endswith("ll") and _shape(word).count("vc") > 1:
        word = word[:-1]
    return word


def stem_terms(terms: pa.Array) -> pa.Array:
    """Stems of a column of terms; each distinct term is worked out once."""
    coded = terms.dictionary_encode()
    stems = pa.array([stem(t) for t in coded.dictionary.to_pylist()], pa.string())
    return stems.take(coded.indices)
