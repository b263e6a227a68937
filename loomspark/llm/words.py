"""Words of whole Arrow text columns and Rabin-Karp fingerprints of word windows.

A word is a run of anything but space, tab, newline, vertical tab, form feed and
carriage return. Words get 64-bit hashes; a window's fingerprint is the polynomial
of its words' hashes modulo the prime 2**61 - 1, computed for all windows at once
by doubling the window. Fingerprints find candidates; who needs certainty compares
the words (``Block.digest``, ``Block.same``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
PRIME = 2**61 - 1
#: Bases of two fingerprints, drawn once from 1 to PRIME.
BASES = (0x0DEECE66D3A57C91, 0x13198A2E03707344)
#: A longer word is hashed by blake2b, one by one.
LANES = 8
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TAILS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], _U)
_STEPS = [_U((k + 1) * 0xD6E8FEB86659FD93 % 2**64) for k in range(LANES)]
DIGEST = 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without pattern (the splitmix64 finalizer)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _folded(x: np.ndarray) -> np.ndarray:
    x = (x & _U(PRIME)) + (x >> _U(61))
    return np.where(x >= _U(PRIME), x - _U(PRIME), x)


def _times(a: np.ndarray, c: int) -> np.ndarray:
    """a * c modulo PRIME for a, c < PRIME, in halves of 31 bits so that nothing overflows."""
    low, high = _U(c & 0x7FFFFFFF), _U(c >> 31)
    a0, a1 = a & _U(0x7FFFFFFF), a >> _U(31)
    middle = a1 * low + a0 * high
    return _folded(((a1 * high) << _U(1)) + (middle >> _U(30)) + ((middle & _U(0x3FFFFFFF)) << _U(31)) + a0 * low)


def fingerprints(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomials of all windows of ``size`` words, also of those that cross from one text into the next."""
    if len(words) < size:
        return np.zeros(0, _U)
    power, span = _folded(words), 1  # windows of span words
    out, have = None, 0
    left = size
    while True:
        if left & 1:
            if out is None:
                out, have = power, span
            else:  # the longer part stands first
                n = len(power) - have
                out = _folded(_times(power[:n], pow(base, have, PRIME)) + out[span : span + n])
                have += span
        left >>= 1
        if not left:
            return mix(out)
        n = len(power) - span
        power = _folded(_times(power[:n], pow(base, span, PRIME)) + power[span : span + n])
        span *= 2


@dataclass
class Block:
    """Texts one after another in ``data`` (with 8 spare bytes), and where their words are."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    #: First word of each text, and one past the last.
    edges: np.ndarray

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash for each word."""
        size = self.end - self.begin
        h = mix(size.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(seed + 1))
        lanes = np.ndarray(len(self.data) - 7, "<u8", self.data, 0, (1,))  # eight bytes from any place
        some = np.arange(len(size))
        for k in range(LANES):
            left = size[some] - 8 * k
            some, left = some[left > 0], left[left > 0]
            if not len(some):
                return h
            part = lanes[self.begin[some] + 8 * k] & _TAILS[np.minimum(left, 8)]
            h[some] = mix(h[some] ^ (part + _STEPS[k]))
        for i in np.flatnonzero(size > 8 * LANES).tolist():
            d = hashlib.blake2b(self.data[self.begin[i] : self.end[i]], digest_size=8, salt=seed.to_bytes(8, "little"))
            h[i] = int.from_bytes(d.digest(), "little")
        return h

    def windows(self, size: int, base: int = BASES[0], seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, first word, text) of each window that lies inside one text."""
        whole = fingerprints(self.hashes(seed), size, base)
        text = np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))
        at = np.flatnonzero(text[size - 1 :] == text[: len(whole)]) if len(whole) else np.zeros(0, np.int64)
        return whole[at], at, text[at]

    def joined(self, a: int, b: int) -> bytes:
        """Words a to b (not itself) of one text, one space between."""
        return b" ".join(self.data[self.begin[a] : self.end[b - 1]].tobytes().split())

    def word(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.end[i]].tobytes()

    def digest(self, a: int, b: int) -> bytes:
        """128 bits of a cryptographic hash of words a to b: equal only for equal words."""
        return hashlib.blake2b(self.joined(a, b), digest_size=DIGEST).digest()

    def same(self, a: int, b: int, n: int) -> bool:
        """Are the n words from a on those from b on?"""
        x = self.data[self.begin[a] : self.end[a + n - 1]]
        y = self.data[self.begin[b] : self.end[b + n - 1]]
        return (len(x) == len(y) and bool((x == y).all())) or self.joined(a, a + n) == self.joined(b, b + n)


def read_block(data: np.ndarray, edges: np.ndarray, lower: bool = False) -> Block:
    """``edges``: where each text begins in ``data``, and where the last one ends; ``lower`` folds A-Z."""
    body = data[edges[0] : edges[-1]]
    spare = np.full(len(body) + 8, 32, np.uint8)
    spare[: len(body)] = _LOWER[body] if lower else body
    edges = edges - edges[0]
    word = ~_SPACE[spare[: len(body)]]
    first = np.zeros(len(body) + 1, bool)
    first[edges] = True
    before = np.empty_like(word)
    before[:1], before[1:] = False, word[:-1]
    after = np.empty_like(word)
    after[-1:], after[:-1] = False, word[1:]
    begin = np.flatnonzero(word & (~before | first[:-1]))
    end = np.flatnonzero(word & (~after | first[1:])) + 1
    return Block(spare, begin, end, np.searchsorted(begin, edges))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the edges of its texts; nulls are empty. Nothing is copied."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    edges = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8), edges.astype(np.int64)


def blocks(column: pa.Array, size: int, lower: bool = False) -> Iterator[tuple[int, int, Block]]:
    """(from, to, block): texts from..to of the column, about ``size`` bytes; a longer text is a block of its own."""
    data, edges = text_buffer(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + size, side="right")) - 1)
        yield at, to, read_block(data, edges[at : to + 1], lower)
        at = to
