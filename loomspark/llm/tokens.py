"""Token ids of whole texts with a public word-level BPE vocabulary.

The vocabulary's pre-tokenizer splits a text into words, and a word's ids do
not depend on its neighbours. So words are split here and each distinct word is
encoded by the tokenizer once per block or cache; the ids are the tokenizer's
own. Texts outside the plain Latin range go through the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import pairwise

#: Below this code point composition has nothing to do and lower-casing is character by character.
_PLAIN_END = 0x250
#: Words kept between blocks; the cache starts anew beyond that.
CACHE = 300_000


def _class(test) -> str:
    return "".join(re.escape(chr(i)) for i in range(_PLAIN_END) if test(chr(i)))


_LETTER = _class(lambda c: unicodedata.category(c)[0] == "L")
_NUMBER = _class(lambda c: unicodedata.category(c)[0] == "N")
_SPACE = "\t-\r \x85\xa0"
#: Letters first, as most words are: no two of the alternatives begin alike but the last and those with an apostrophe.
_WORD = re.compile(rf"[{_LETTER}]+|[{_NUMBER}]|'s|'t|'re|'ve|'m|'ll|'d|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_OTHER = re.compile(f"[^\x00-{chr(_PLAIN_END - 1)}]")


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # a special token's name inside a text is text
        self._cache: dict[str, bytes] = {}
        #: Ids that end a word.
        self._ends = frozenset(i for t, i in self._tokenizer.get_vocab().items() if t.endswith("</w>"))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [
            array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Many words in one call, cut after each id that ends a word."""
        ids = self._tokenizer.encode(" ".join(words), add_special_tokens=False).ids
        ends = self._ends
        cuts = [k for k, i in enumerate(ids, 1) if i in ends]
        if len(cuts) != len(words):
            return self._ids(words)
        raw = array("I", ids).tobytes()
        return [raw[4 * a : 4 * b] for a, b in pairwise([0, *cuts])]

    def encode(self, texts: Iterable[str | None], end_id: int | None = None) -> list[bytes]:
        tail = b"" if end_id is None else end_id.to_bytes(4, "little")
        out: list[bytes | list[str]] = []
        cache = self._cache
        if len(cache) > CACHE:
            cache.clear()
        missing: set[str] = set()
        for t in texts:
            low = (t or "").lower()
            if _OTHER.search(low):
                out.append(self._ids([t])[0])
                continue
            words = _WORD.findall(low)
            out.append(words)
            missing.update(set(words).difference(cache))
        new = list(missing)
        for at in range(0, len(new), 500):
            cache.update(zip(new[at : at + 500], self._word_ids(new[at : at + 500]), strict=True))
        get = cache.__getitem__
        return [(w if isinstance(w, bytes) else b"".join(map(get, w))) + tail for w in out]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, whose tasks share what it has loaded and the words it has seen."""
    return WordTokenizer(path)
