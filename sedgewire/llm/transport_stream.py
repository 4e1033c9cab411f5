"""MPEG transport streams as a media column: writing, and reading with program tables, continuity, packets and timestamps.

Layout (ISO/IEC 13818-1): packets of 188 bytes; PID 0 holds the program association, the PID it names
the program map, which names the elementary stream. Every access unit is one elementary packet (PES)
with a presentation timestamp; every `RANDOM_ACCESS`th starts with the random-access flag.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewire.llm.common import in_batches, map_arrow, with_fields

PACKET, SYNC = 188, 0x47
MAP_PID, STREAM_PID, PROGRAM, PRIVATE_DATA = 0x1000, 0x0100, 1, 0x06
UNIT_BYTES, UNIT_TICKS, CLOCK, RANDOM_ACCESS = 32_768, 3_600, 1 << 33, 8


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 24
    for _ in range(8):
        table = np.where(table & 0x80000000, (table << 1) ^ np.uint32(0x04C11DB7), table << 1).astype(np.uint32)
    return table


_CRC = _crc_table().tolist()


def crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2, the checksum of program tables."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ b]
    return crc


def _table_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    section = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, 0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big")) + _table_packet(
    MAP_PID, 2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, 1 | pts >> 14 & 0xFE, pts >> 7 & 255, 1 | pts << 1 & 0xFE])


def write_stream(payload: bytes, first_pts: int = 0) -> bytes:
    """A single-program stream that holds the payload, without loss, in units of UNIT_BYTES."""
    out, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        unit = payload[at : at + UNIT_BYTES]
        pts = (first_pts + k * UNIT_TICKS) % CLOCK
        pes = b"\x00\x00\x01\xbd" + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit
        key = k % RANDOM_ACCESS == 0
        room = 184 - 2 * key
        n = 1 + max(0, -(-(len(pes) - room) // 184))
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 255
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        stuffing = room + 184 * (n - 1) - len(pes)
        offset = np.full(n, 4)
        offset[0] = PACKET - room
        offset[-1] += stuffing
        if key:
            packets[0, 3] |= 0x20
            packets[0, 4], packets[0, 5] = 1, 0x40
        if stuffing:  # adaptation field of the last packet, which may be the first as well
            last = packets[-1]
            last[3] |= 0x20
            size = int(offset[-1]) - 5
            last[4] = size
            if size:
                last[5] = 0x40 if key and n == 1 else 0
        cells = np.arange(4, PACKET)[None, :] >= offset[:, None]
        packets[:, 4:][cells] = np.frombuffer(pes, np.uint8)
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """What a reader finds: streams {pid: type}, elementary bytes, (offset, pts, random access) of each unit, and errors."""

    streams: dict[int, int] = field(default_factory=dict)
    payload: dict[int, bytes] = field(default_factory=dict)
    units: dict[int, list[tuple[int, int | None, bool]]] = field(default_factory=dict)
    packets: int = 0
    bad_packets: int = 0
    continuity_errors: int = 0
    table_errors: int = 0


def _sections(packets: np.ndarray, starts: np.ndarray, offset: np.ndarray) -> list[bytes]:
    """The sections of one PID's packets."""
    out, open_ = [], b""
    for row, start, at in zip(packets, starts, offset, strict=True):
        data = row[at:].tobytes()
        if start:
            pointer = data[0] if data else 0
            open_ = data[1 + pointer :]
        elif open_:
            open_ += data
        while len(open_) >= 3 and open_[0] != 0xFF:
            size = 3 + (int.from_bytes(open_[1:3], "big") & 0xFFF)
            if len(open_) < size:
                break
            out.append(open_[:size])
            open_ = open_[size:]
    return out


def read_stream(media: bytes) -> Stream:
    """Parse a stream. Packets without the sync byte or with the error flag are counted and left out; so are sections whose checksum fails; a trailing part of a packet is a bad packet."""
    found = Stream()
    whole = len(media) // PACKET
    all_packets = np.frombuffer(media, np.uint8, count=whole * PACKET).reshape(whole, PACKET)
    good = (all_packets[:, 0] == SYNC) & (all_packets[:, 1] < 0x80)
    packets = all_packets[good]
    found.packets, found.bad_packets = whole, int(whole - good.sum()) + (len(media) % PACKET > 0)
    pid = (packets[:, 1] & 0x1F).astype(np.int32) << 8 | packets[:, 2]
    start = (packets[:, 1] & 0x40) > 0
    control, counter = packets[:, 3] >> 4 & 3, packets[:, 3] & 15
    adapted, filled = (control & 2) > 0, (control & 1) > 0
    offset = np.where(adapted, 5 + packets[:, 4].astype(np.int32), 4)
    flags = np.where(adapted & (packets[:, 4] > 0), packets[:, 5], 0)
    filled &= offset < PACKET

    def of(which: int) -> np.ndarray:
        rows = np.flatnonzero((pid == which) & filled)
        if len(rows) > 1:
            step = (counter[rows[1:]].astype(np.int32) - counter[rows[:-1]]) & 15
            jump = (flags[rows[1:]] & 0x80) > 0
            repeated = (step == 0) & (packets[rows[1:], 4:] == packets[rows[:-1], 4:]).all(axis=1)
            found.continuity_errors += int(((step != 1) & ~jump & ~repeated).sum())
            rows = rows[np.concatenate([[True], ~repeated])]
        return rows

    def tables(which: int, table_id: int) -> list[bytes]:
        rows, kept = of(which), []
        for s in _sections(packets[rows], start[rows], offset[rows]):
            if s[0] == table_id and len(s) >= 12:
                if crc32_mpeg(s):
                    found.table_errors += 1
                else:
                    kept.append(s)
        return kept

    maps: dict[int, int] = {}
    for s in tables(0, 0):
        for i in range(8, len(s) - 4, 4):
            if number := int.from_bytes(s[i : i + 2], "big"):
                maps[int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF] = number
    for m in maps:
        for s in tables(m, 2):
            i = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            while i + 5 <= len(s) - 4:
                found.streams[int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF] = s[i]
                i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0xFFF)
    for stream in found.streams:
        rows = of(stream)
        begins = np.flatnonzero(start[rows])
        parts, units, size = [], [], 0
        for k, b in enumerate(begins):
            own = rows[b : begins[k + 1] if k + 1 < len(begins) else len(rows)]
            body = packets[own][np.arange(PACKET)[None, :] >= offset[own][:, None]].tobytes()
            if body[:3] != b"\x00\x00\x01" or len(body) < 9:
                found.bad_packets += 1
                continue
            length, head = int.from_bytes(body[4:6], "big"), 9 + body[8]
            pts = None
            if body[7] & 0x80 and len(body) >= 14:
                t = body[9:14]
                pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
            unit = body[head : 6 + length] if length else body[head:]
            parts.append(unit)
            units.append((size, pts, bool(flags[own[0]] & 0x40)))
            size += len(unit)
        found.payload[stream], found.units[stream] = b"".join(parts), units
    return found


def features(found: Stream) -> str:
    pids = ";".join(f"{pid:#06x}:{kind:#04x}" for pid, kind in sorted(found.streams.items()))
    units = [u for pid in sorted(found.units) for u in found.units[pid]]
    stamps = [u[1] for u in units if u[1] is not None]
    keys = [u[1] for u in units if u[2]]
    return f"streams={pids} packets={found.packets} bad={found.bad_packets} continuity_errors={found.continuity_errors} table_errors={found.table_errors} units={len(units)} first_pts={stamps[0] if stamps else ''} last_pts={stamps[-1] if stamps else ''} random_access={','.join(map(str, keys))}"


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 if text else 64)


def _media(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.append_column("media", pa.array([write_stream(padded((t or "").encode())) for t in batch.column("text").to_pylist()], pa.large_binary())).drop_columns(["text"])


def text_streams(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as UTF-8 (null: empty), padded with zero bytes to a positive multiple of 64, as a transport stream."""
    source = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return source.mapInArrow(lambda it: in_batches(_media, it, 256), f"doc_id {kind}, n_bytes long, media binary")


_READ = "payload binary, streams map<int,int>, timestamps array<long>, random_access array<long>, continuity_errors long, bad_packets long, table_errors long, feature string"


def _read(batch: pa.RecordBatch, column: str) -> pa.RecordBatch:
    rows = []
    for media in batch.column(column).to_pylist():
        found = read_stream(media or b"")
        units = [u for pid in sorted(found.units) for u in found.units[pid]]
        rows.append((b"".join(found.payload[p] for p in sorted(found.payload)), list(found.streams.items()), [u[1] for u in units], [u[1] for u in units if u[2]], found.continuity_errors, found.bad_packets, found.table_errors, features(found)))
    kinds = [pa.binary(), pa.map_(pa.int32(), pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in _READ.split(", ")]
    for i, (name, kind) in enumerate(zip(names, kinds, strict=True)):
        batch = batch.append_column(name, pa.array([r[i] for r in rows], kind))
    return batch


def read_streams(frame: DataFrame, column: str = "media") -> DataFrame:
    """A frame with a binary column of streams (null: empty), plus what reading them finds; columns of the added names are replaced."""
    added = {x.split()[0] for x in _READ.split(", ")}
    frame = frame.select(*[F.col(f"`{c}`") for c in frame.columns if c.lower() not in added])
    ddl = with_fields(frame.schema, _READ)
    return map_arrow(frame, lambda it: in_batches(lambda b: _read(b, column), it, 256), ddl)


def media_digests(docs: DataFrame) -> DataFrame:
    """The contract's digests of text_streams read back. Equal texts give equal rows but for doc_id."""
    back = read_streams(text_streams(docs))
    tail = F.expr("substring(payload, length(payload) - 63, 64)")
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).cast("long").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
