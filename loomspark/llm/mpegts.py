"""MPEG transport streams as media columns.

``mux`` stores a payload as one private-data elementary stream: a program
association table, a program map table, then elementary packets (PES) cut into
188-byte transport packets with continuity counters, clock references and
random-access flags. ``demux`` starts from the stored bytes alone: it parses
the tables, checks the counters, reassembles the elementary packets and returns
the payload with its timestamps and random-access points.

Work is per row, whole arrays at a time; a row never meets another row.

Defined results
* null payload: no stream (null columns); empty payload: a stream of one empty
  elementary packet, which reads back as empty.
* a stored value whose packets or program tables can't be read raises
  ``BadStream`` in ``demux``; in ``read_streams`` it gives ``error`` and null fields; null gives null.
* elementary packets that lost or damaged transport packets left incomplete raise
  ``BadStream`` too, but in ``read_streams``, as with ``salvage``, they are counted
  in ``damaged`` and left out, and those that are whole are returned. A packet
  sent twice in a row counts once; a counter may jump where the discontinuity flag says so.
* changed bytes inside an elementary packet that leave every header whole can't be seen.
* extra columns pass through ``with_streams`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Fixed values of ISO/IEC 13818-1.
PACKET = 188
SYNC = 0x47
PAT_PID = 0x0000
PRIVATE_STREAM_ID = 0xBD
PRIVATE_STREAM_TYPE = 0x06
CLOCK_HZ = 90_000
CRC_POLY = 0x04C11DB7

# This module's own choices.
PMT_PID = 0x0100
DATA_PID = 0x0101
PROGRAM = 1
#: Payload bytes of an elementary packet; its length field then fits 16 bits.
PES_BYTES = 32_768
#: Ticks between two elementary packets: 25 a second.
PES_TICKS = CLOCK_HZ // 25
#: Every so many elementary packets a reader may start.
ACCESS_EVERY = 8
#: Stored bytes that a task works on at a time.
PIECE = 1 << 20


class BadStream(ValueError):
    """The bytes are not a transport stream that this module can read."""


@dataclass
class Stream:
    payload: bytes
    pid: int
    stream_type: int
    packets: int
    pts: list[int]
    #: (transport packet number, presentation time) of each random-access point.
    access_points: list[tuple[int, int]]
    #: Places where the continuity counter jumps without a discontinuity flag.
    counter_errors: int
    #: Elementary packets that are not whole; ``payload`` and ``pts`` leave them out.
    damaged: int


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ CRC_POLY if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    whole = head + body
    return whole + crc32_mpeg(whole).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(PAT_PID, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(
    PMT_PID,
    _section(
        0x02,
        PROGRAM,
        (0xE000 | DATA_PID).to_bytes(2, "big")
        + b"\xf0\x00"
        + bytes([PRIVATE_STREAM_TYPE])
        + (0xE000 | DATA_PID).to_bytes(2, "big")
        + b"\xf0\x00",
    ),
)


def _stamp(prefix: int, t: int) -> bytes:
    """A 33-bit time in five bytes with marker bits."""
    return bytes(
        [prefix << 4 | t >> 29 & 0x0E | 1, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1]
    )


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _clock(base: int) -> bytes:
    """Program clock reference with extension 0."""
    return (base << 15 | 0x7E00).to_bytes(6, "big")


def _pes(chunk: bytes, pts: int) -> bytes:
    head = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_ID]) + (len(chunk) + 8).to_bytes(2, "big")
    return head + b"\x84\x80\x05" + _stamp(2, pts) + chunk


def _packets(pes: bytes, pts: int, counter: int, access: bool) -> np.ndarray:
    """One elementary packet over transport packets: a first with clock, full ones, a stuffed last."""
    first = bytes([7, 0x10 | 0x40 * access]) + _clock(pts)
    room, size = PACKET - 4 - len(first), PACKET - 4
    if len(pes) < room:  # all in one packet: more adaptation bytes
        first = bytes([len(first) - 1 + room - len(pes)]) + first[1:] + b"\xff" * (room - len(pes))
        room = len(pes)
    rest = len(pes) - room
    n = 1 + -(-rest // size)
    out = np.empty((n, PACKET), np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 0x0F
    data = np.frombuffer(pes, np.uint8)
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    out[0, 4 : 4 + len(first)] = np.frombuffer(first, np.uint8)
    out[0, 4 + len(first) :] = data[:room]
    full = rest // size
    out[1 : 1 + full, 4:] = data[room : room + full * size].reshape(full, size)
    if left := rest - full * size:
        gap = size - left
        last = out[-1]
        last[3] |= 0x20
        last[4] = gap - 1
        if gap > 1:
            last[5] = 0
            last[6 : 4 + gap] = 0xFF
        last[4 + gap :] = data[len(pes) - left :]
    return out


def mux(payload: bytes) -> bytes:
    parts, counter = [_PAT, _PMT], 0
    for k, at in enumerate(range(0, max(1, len(payload)), PES_BYTES)):
        pts = CLOCK_HZ + k * PES_TICKS
        rows = _packets(_pes(payload[at : at + PES_BYTES], pts), pts, counter, k % ACCESS_EVERY == 0)
        counter += len(rows)
        parts.append(rows.tobytes())
    return b"".join(parts)


def _section_of(rows: np.ndarray, table_id: int) -> bytes:
    """The first intact section of a table's packets; it may run over several of them."""
    held: bytes | None = None
    for packet in rows:
        control = packet[3] >> 4 & 3
        start = 5 + int(packet[4]) if control & 2 else 4
        if packet[1] & 0x80 or not control & 1 or start >= PACKET:
            continue
        body = packet[start:].tobytes()
        parts = [(held, body)]
        if packet[1] & 0x40:  # a section begins behind the pointer; what stands before it ends the last one
            at = 1 + body[0]
            parts = [(held, body[1:at]), (b"", body[at:])]
        for before, more in parts:
            held = None if before is None else before + more
            if held is None or len(held) < 3:
                continue
            size = 3 + ((held[1] & 0x0F) << 8 | held[2])
            if len(held) >= size:
                if held[0] == table_id and size >= 12 and crc32_mpeg(held[:size]) == 0:
                    return held[:size]
                held = None
    raise BadStream("a program table is missing or damaged")


def _streams(rows: np.ndarray, pids: np.ndarray) -> list[tuple[int, int]]:
    """(packet id, stream type) of every elementary stream of the first program."""
    pat = _section_of(rows[pids == PAT_PID], 0x00)
    programs = [(pat[i] << 8 | pat[i + 1], (pat[i + 2] & 0x1F) << 8 | pat[i + 3]) for i in range(8, len(pat) - 7, 4)]
    maps = [pid for number, pid in programs if number]
    if not maps:
        raise BadStream("the tables name no program")
    pmt = _section_of(rows[pids == maps[0]], 0x02)
    end, found = len(pmt) - 4, []
    at = 12 + ((pmt[10] & 0x0F) << 8 | pmt[11])
    while at + 5 <= end:
        found.append(((pmt[at + 1] & 0x1F) << 8 | pmt[at + 2], pmt[at]))
        at += 5 + ((pmt[at + 3] & 0x0F) << 8 | pmt[at + 4])
    if not found:
        raise BadStream("the program has no stream")
    return found


def _read_pes(pes: bytes) -> tuple[bytes, int] | None:
    """Data and presentation time (-1 without one) of an elementary packet; None if it is not whole."""
    if len(pes) < 9 or pes[:3] != b"\x00\x00\x01" or pes[6] & 0xC0 != 0x80 or len(pes) < 9 + pes[8]:
        return None
    size = pes[4] << 8 | pes[5]
    if size and len(pes) != 6 + size:  # size 0: up to the next elementary packet
        return None
    timed = pes[7] & 0x80 and pes[8] >= 5
    return pes[9 + pes[8] :], _read_stamp(pes[9:14]) if timed else -1


def demux(stored: bytes, pid: int | None = None, salvage: bool = False) -> Stream:
    """Reads elementary stream ``pid``, or else the first that the program map names.

    With ``salvage`` a damaged stream gives its whole elementary packets; without, it raises.
    """
    if not stored or len(stored) % PACKET:
        raise BadStream("not a whole number of packets")
    rows = np.frombuffer(stored, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        raise BadStream("a packet lacks its sync byte")
    pids = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    named = _streams(rows, pids)
    pid = named[0][0] if pid is None else pid
    if pid not in dict(named):
        raise BadStream("the program map doesn't name the stream")

    number = np.flatnonzero((pids == pid) & ((rows[:, 3] & 0x10) > 0))
    ts = rows[number]
    adapted = (ts[:, 3] & 0x20) > 0
    length = np.where(adapted, ts[:, 4].astype(np.int16), 0)
    flags = np.where(length > 0, ts[:, 5], 0)
    begins = np.where(adapted, 5 + length, 4)
    bad = ((ts[:, 1] & 0x80) > 0) | (begins > PACKET)
    step = np.diff(ts[:, 3].astype(np.int16) & 0x0F) % 16
    # A packet may be sent twice in a row; the clock reference in bytes 6 to 11 is all that may differ.
    twice = np.r_[False, (step == 0) & (ts[1:, 12:] == ts[:-1, 12:]).all(1) & (ts[1:, :6] == ts[:-1, :6]).all(1)] if len(ts) else np.zeros(0, bool)
    lost = np.r_[False, step != 1] & ~twice & ((flags & 0x80) == 0) if len(ts) else np.zeros(0, bool)
    begins = np.where(twice, PACKET, np.minimum(begins, PACKET))
    body = ts[np.arange(PACKET) >= begins[:, None]].tobytes()
    ends = np.cumsum(PACKET - begins)
    unit = np.flatnonzero(((ts[:, 1] & 0x40) > 0) & ~twice)
    if not len(unit):
        raise BadStream("the stream has no elementary packet")
    edges = [*(ends[unit] - (PACKET - begins[unit])).tolist(), len(body)]
    inside = lost.copy()
    inside[unit] = False  # a gap before an elementary packet harms the one before it
    tail = np.r_[lost[unit[1:]], False]
    harmed = np.add.reduceat((inside | bad).astype(np.int32), unit) > 0
    chunks, pts, access = [], [], []
    damaged = int(unit[0] > 0)
    for k, i in enumerate(unit.tolist()):
        pes = body[edges[k] : edges[k + 1]]
        whole = None if harmed[k] or tail[k] and pes[4:6] == b"\0\0" else _read_pes(pes)
        if whole is None:
            damaged += 1
            continue
        chunks.append(whole[0])
        pts.append(whole[1])
        if flags[i] & 0x40:
            access.append((int(number[i]), whole[1]))
    if damaged and not salvage:
        raise BadStream("an elementary packet is incomplete")
    return Stream(b"".join(chunks), pid, dict(named)[pid], len(rows), pts, access, int(lost.sum()), damaged)


def _parts(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Batches in pieces of about ``PIECE`` bytes, a longer value alone: what is made of one piece is all that a task holds."""
    for batch in values:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + PIECE, "right")))
            yield batch.slice(at, to - at)
            at = to


def with_streams(df: DataFrame, payload: str, out: str = "media") -> DataFrame:
    """Adds binary column ``out``: the stream that stores binary column ``payload``."""

    @F.arrow_udf(T.BinaryType())
    def stored(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in _parts(values):
            yield pa.array([None if v is None else mux(v) for v in part.to_pylist()], pa.binary())

    return df.withColumn(out, stored(F.col(payload)))


STREAM = T.StructType(
    [
        T.StructField("payload", T.BinaryType()),
        T.StructField("pid", T.IntegerType()),
        T.StructField("stream_type", T.IntegerType()),
        T.StructField("packets", T.IntegerType()),
        T.StructField("pts", T.ArrayType(T.LongType())),
        T.StructField(
            "access_points",
            T.ArrayType(T.StructType([T.StructField("packet", T.LongType()), T.StructField("pts", T.LongType())])),
        ),
        T.StructField("counter_errors", T.IntegerType()),
        T.StructField("damaged", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)


_STREAM_ARROW = to_arrow_type(STREAM)


def read_streams(df: DataFrame, media: str, out: str = "stream") -> DataFrame:
    """Adds struct column ``out`` (see ``STREAM``) parsed from binary column ``media``."""

    def parsed(v: bytes | None) -> dict | None:
        if v is None:
            return None
        try:
            s = demux(v, salvage=True)
        except BadStream as e:
            return {"error": str(e)}
        return vars(s) | {"access_points": [{"packet": n, "pts": t} for n, t in s.access_points]}

    @F.arrow_udf(STREAM)
    def read(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in _parts(values):
            yield pa.array([parsed(v) for v in part.to_pylist()], _STREAM_ARROW)

    return df.withColumn(out, read(F.col(media)))
