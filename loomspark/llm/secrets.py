"""Secret scans: plain patterns, and candidates whose decoded bytes are confirmed by their structure.

Patterns report what they match. All other kinds are candidates until their
content has been decoded and parsed:

* ``jwt``: a compact token; its header decodes to JSON that names an algorithm, its
  payload to a JSON object, and its signature has the length of that algorithm.
* ``pem``: armour round a private key; ``key64`` and ``keyhex``: the same keys as a
  bare run of base64 (line breaks allowed) or hexadecimal digits. The bytes must be
  DER with nested lengths that add up, in the shape of a PKCS#1, PKCS#8, encrypted
  PKCS#8, SEC1 or DSA private key, or an OpenSSH key with consistent lengths.
* ``checked``: a prefixed token whose last six characters are the CRC-32 of the others.

Each text is scanned by itself, so there is no shuffle. Every pattern is linear
in the text but for the decoding of candidates, which don't overlap.

Defined results
* null or empty text: no spans. Spans are [start, stop) in code points, ordered by
  start, then kind as in ``KINDS``.
* spans of one kind don't overlap; spans of two kinds may.
* repeated rows are scanned each for itself; extra columns stay as they are, and a
  column of the output's name is replaced.
* only a key's own bytes make its span: what follows in the same run is left out.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: In the order of spans that begin at the same place.
KINDS = ("assign", "access", "hex", "jwt", "pem", "key64", "keyhex", "checked")
SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("stop", "integer"))
Span = tuple[int, int]

# Fixed values of the three plain kinds. Letters of names count in either case, A-Z only.
_NAMES = ("password", "passwd", "secret", "token", "api_?key")
_either = lambda word: re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", word)
ASSIGN = re.compile(rf"""({"|".join(map(_either, _NAMES))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 12
#: Runs are taken whole, so a least length in the pattern drops the same matches as a test after it.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f][0-9a-f]{15,}")

# A look behind stands after the first letters, so that these are what is searched for.
_JWT = re.compile(r"(?s)eyJ(?<![A-Za-z0-9_-]...)[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?![A-Za-z0-9_.-])")
_ARMOUR = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
#: A DER sequence begins with M in base64, as its first byte is 0x30; an OpenSSH key with its name.
_RUN64 = re.compile(r"(?s)[Mb](?<![A-Za-z0-9+/_-].)(?:(?<=M)|(?<=b)3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/]{30,}(?:\r?\n[A-Za-z0-9+/]+)*={0,2}")
_RUNHEX = re.compile(r"(?s)30(?<![0-9A-Fa-f]..)[0-9A-Fa-f]{60,}")
_CHECKED = re.compile(r"(?s)gh(?<![A-Za-z0-9_]..)[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")

#: Signature bytes by algorithm; 0 stands for any from 128 on.
_SIGNED = {
    "HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64,
    "RS256": 0, "RS384": 0, "RS512": 0, "PS256": 0, "PS384": 0, "PS512": 0,
}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_OPENSSH = b"openssh-key-v1\0"
_CIPHER = re.compile(rb"aes(?:128|192|256)-(?:ctr|cbc)|aes(?:128|256)-gcm@openssh\.com|chacha20-poly1305@openssh\.com|3des-cbc")
#: Object identifiers, as DER content.
_RSA, _EC = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201")
_PKCS5, _PKCS12 = bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01")
_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30
_DEEPEST = 12

Node = tuple[int, bytes, list]


class _NotDer(ValueError):
    pass


def der(data: bytes, at: int, limit: int, depth: int = 0) -> tuple[Node, int]:
    """((tag, content, children), end) of the element at ``at``; a constructed element's children fill it exactly."""
    if depth > _DEEPEST or at + 2 > limit:
        raise _NotDer
    tag, size = data[at], data[at + 1]
    at += 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > limit:
            raise _NotDer
        size = int.from_bytes(data[at : at + n], "big")
        at += n
        if size < 0x80 or size >> (8 * (n - 1)) == 0:  # not the shortest form
            raise _NotDer
    end = at + size
    if tag & 0x1F == 0x1F or end > limit:
        raise _NotDer
    children, inner = [], at
    while tag & 0x20 and inner < end:
        child, inner = der(data, inner, end, depth + 1)
        children.append(child)
    return (tag, data[at:end], children), end


def _tags(node: Node) -> list[int]:
    return [c[0] for c in node[2]]


def _number(node: Node) -> int:
    return int.from_bytes(node[1], "big", signed=True)


def _is_private(node: Node) -> bool:
    """Does a parsed sequence have the shape of a private key?"""
    tags, parts = _tags(node), node[2]
    if node[0] != _SEQUENCE or len(parts) < 2:
        return False
    if tags == [_INTEGER] * 9 and _number(parts[0]) == 0:  # PKCS#1: the modulus is the product of its primes
        return _number(parts[1]) == _number(parts[4]) * _number(parts[5]) > 1
    if tags == [_INTEGER] * 6 and _number(parts[0]) == 0:  # DSA
        return 0 < _number(parts[5]) < _number(parts[2]) < _number(parts[1])
    if tags[:2] == [_INTEGER, _OCTETS] and _number(parts[0]) == 1:  # SEC1
        return 16 <= len(parts[1][1]) <= 66 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS] and _number(parts[0]) in (0, 1):  # PKCS#8
        if _tags(parts[1])[:1] != [_OID]:
            return False
        kind = parts[1][2][0][1]
        inner, end = der(parts[2][1], 0, len(parts[2][1]))
        if end != len(parts[2][1]):
            return False
        if kind in (_RSA, _EC):
            return _is_private(inner)
        return inner[0] in (_INTEGER, _OCTETS) and len(inner[1]) >= 16
    if tags == [_SEQUENCE, _OCTETS] and _tags(parts[0])[:1] == [_OID]:  # encrypted PKCS#8
        return parts[0][2][0][1].startswith((_PKCS5, _PKCS12)) and len(parts[1][1]) >= 16
    return False


def _ssh_strings(data: bytes, at: int, n: int) -> tuple[list[bytes], int]:
    out = []
    for _ in range(n):
        (size,) = struct.unpack_from(">I", data, at)
        at += 4
        if at + size > len(data):
            raise _NotDer
        out.append(data[at : at + size])
        at += size
    return out, at


def _openssh(data: bytes) -> int:
    """Length of an OpenSSH key whose nested lengths add up."""
    (cipher, kdf, _), at = _ssh_strings(data, len(_OPENSSH), 3)
    (keys,) = struct.unpack_from(">I", data, at)
    if not 1 <= keys <= 16:
        raise _NotDer
    public, at = _ssh_strings(data, at + 4, keys)
    (private,), at = _ssh_strings(data, at, 1)
    if any(not _ssh_strings(p, 0, 1)[0][0].isascii() for p in public) or len(private) % 8 or len(private) < 16:
        raise _NotDer
    if cipher == b"none":
        sound = kdf == b"none" and private[:4] == private[4:8]  # the check number stands there twice
    else:
        sound = kdf == b"bcrypt" and bool(_CIPHER.fullmatch(cipher))
    if not sound:
        raise _NotDer
    return at


def private_key(data: bytes) -> int:
    """Length of the private key that the bytes begin with; 0 if they don't."""
    try:
        if data.startswith(_OPENSSH):
            return _openssh(data)
        if data[:1] != b"\x30":
            return 0
        node, end = der(data, 0, len(data))
        return end if _is_private(node) else 0
    except (_NotDer, struct.error, IndexError):
        return 0


def _decoded(run: str, url: bool = False) -> bytes:
    """Base64 without regard to padding; a last character that holds no whole byte is left out."""
    body = run.rstrip("=")
    body = body[:-1] if len(body) % 4 == 1 else body
    return base64.b64decode(body + "=" * (-len(body) % 4), b"-_" if url else None)


def _json(part: str) -> object:
    try:
        return json.loads(_decoded(part, url=True))
    except (ValueError, RecursionError):  # also bytes that aren't UTF-8
        return None


def is_token(header: str, payload: str, signature: str) -> bool:
    """Three parts of a compact token: what does its header say, and is the rest as it says?"""
    said = _json(header)
    if not isinstance(said, dict) or not isinstance(said.get("alg"), str) or not isinstance(_json(payload), dict):
        return False
    want, have = _SIGNED.get(said["alg"]), len(_decoded(signature, url=True))
    return want is not None and (have == want if want else have >= 128)


def _assigns(text: str) -> Iterator[Span]:
    low = text.lower()
    if not any(n in low for n in ("passw", "secret", "token", "api")):  # any match holds one
        return
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= ASSIGN_LEAST:
            yield m.span()


def _tokens(text: str) -> Iterator[Span]:
    for m in _JWT.finditer(text):
        if is_token(*m[0].split(".")):
            yield m.span()


def _armoured(text: str) -> Iterator[Span]:
    at = 0
    while m := _ARMOUR.search(text, at):
        close = f"-----END {m[1]}-----"
        at = m.end()
        end = text.find("-----", at)
        if end < 0 or not text.startswith(close, end):
            continue
        body = re.sub(r"(?s)^\s*(?:[A-Za-z-]+:[^\n]*\n)+\s*", "", text[at:end])
        try:
            data = base64.b64decode(re.sub(r"\s+", "", body), validate=True)
        except (binascii.Error, ValueError):
            continue
        if private_key(data):
            yield m.start(), end + len(close)
            at = end + len(close)


def _width(run: str, chars: int) -> int:
    """Places of a run, line breaks included, up to its ``chars``-th character that is none."""
    for i, c in enumerate(run):
        chars -= c not in "\r\n"
        if not chars:
            return i + 1
    return len(run)


def _bare(text: str) -> Iterator[Span]:
    for m in _RUN64.finditer(text):
        body = re.sub(r"[\r\n]+", "", m[0])
        if n := private_key(_decoded(body)):
            chars = -(-4 * n // 3)
            filled = chars + -chars % 4
            padded = body[chars:filled] == "=" * (filled - chars)
            yield m.start(), m.start() + _width(m[0], filled if padded else chars)


def _hexadecimal(text: str) -> Iterator[Span]:
    for m in _RUNHEX.finditer(text):
        if n := private_key(bytes.fromhex(m[0][: len(m[0]) // 2 * 2])):
            yield m.start(), m.start() + 2 * n


def _checked(text: str) -> Iterator[Span]:
    for m in _CHECKED.finditer(text):
        n, digits = zlib.crc32(m[1].encode()), ""
        while n:
            n, d = divmod(n, 62)
            digits = _BASE62[d] + digits
        if digits.rjust(6, "0") == m[2]:
            yield m.span()


_matches = lambda pattern: lambda text: (m.span() for m in pattern.finditer(text))
#: For each kind: what any match of it holds, and how its spans are found.
_FINDERS: tuple[tuple[str, str, Callable[[str], Iterator[Span]]], ...] = (
    ("assign", "", _assigns),
    ("access", "AKIA", _matches(ACCESS)),
    ("hex", "", _matches(HEX)),
    ("jwt", "eyJ", _tokens),
    ("pem", "PRIVATE KEY-----", _armoured),
    ("key64", "", _bare),
    ("keyhex", "30", _hexadecimal),
    ("checked", "gh", _checked),
)


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of one text."""
    found = [(a, k, kind, b) for k, (kind, held, finder) in enumerate(_FINDERS) if text and held in text for a, b in finder(text)]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


@F.arrow_udf(SPANS)
def _scan(texts: pa.Array) -> pa.Array:
    kinds, starts, stops, ends = [], [], [], [0]
    for t in texts:
        for kind, a, b in find(t.as_py()):
            kinds.append(kind)
            starts.append(a)
            stops.append(b)
        ends.append(len(kinds))
    spans = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=["kind", "start", "stop"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)


def scan(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Adds ``out``: array of spans (kind, start, stop)."""
    return df.withColumn(out, _scan(F.col(text)))


def listed(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
