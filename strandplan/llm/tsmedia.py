"""Media columns: MPEG transport streams.

A payload is cut into access units, each a PES packet with a presentation timestamp; packets of 188 bytes carry
them with continuity counters, adaptation fields for stuffing, clock references and random-access marks. The
reader parses program tables, checks continuity counters and table checksums, reassembles the elementary
stream and stores the timestamps with their random-access points.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandplan.plans.session import bounded_batches

PACKET = 188
PAT_PID, PMT_PID, MEDIA_PID = 0x0000, 0x1000, 0x0100
PROGRAM = 1
STREAM_TYPE = 0x06  # PES packets with private data
STREAM_ID = 0xBD
#: Bytes of an access unit; each is a random-access point every ``KEY_EVERY`` units.
UNIT = 8192
KEY_EVERY = 4
CLOCK = 90_000
#: Samples of one byte a second, which fix an access unit's time.
RATE = 8000
BLOCK = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def table_crc(data: bytes) -> int:
    """CRC-32 of program tables, most significant bit first."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", table_crc(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHBB", 0x47, 0x4000 | pid, 0x10, 0) + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)))
_PMT = _table_packet(PMT_PID, _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | MEDIA_PID, 0xF000, STREAM_TYPE, 0xE000 | MEDIA_PID, 0xF000)))


def _stamp(t: int) -> bytes:
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, 0x01 | t >> 14 & 0xFE, t >> 7 & 0xFF, 0x01 | t << 1 & 0xFE])


def _clock(t: int) -> bytes:
    return struct.pack(">IH", t >> 1, (t & 1) << 15 | 0x7E00)


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """The transport stream of a payload; equal payloads give equal streams."""
    out, counter = [_PAT, _PMT], 0
    for k, at in enumerate(range(0, len(payload), unit)):
        body = payload[at : at + unit]
        t = at * CLOCK // RATE & (1 << 33) - 1
        pes = b"\x00\x00\x01" + struct.pack(">BHBBB", STREAM_ID, len(body) + 8, 0x84, 0x80, 5) + _stamp(t) + body
        flags = 0x10 | 0x40 * (k % KEY_EVERY == 0)  # a clock reference, and a mark where reading may start
        field_ = bytes([flags]) + _clock(t)
        room = PACKET - 5 - len(field_)
        if len(pes) < room:
            field_ += b"\xff" * (room - len(pes))
            room = len(pes)
        out.append(struct.pack(">BHBB", 0x47, 0x4000 | MEDIA_PID, 0x30 | counter & 15, len(field_)) + field_ + pes[:room])
        counter += 1
        whole, rest = divmod(len(pes) - room, PACKET - 4)
        if whole:
            packets = np.empty((whole, PACKET), np.uint8)
            packets[:, :3] = (0x47, MEDIA_PID >> 8, MEDIA_PID & 0xFF)
            packets[:, 3] = 0x10 | (np.arange(counter, counter + whole) & 15)
            packets[:, 4:] = np.frombuffer(pes, np.uint8, whole * (PACKET - 4), room).reshape(whole, PACKET - 4)
            out.append(packets.tobytes())
            counter += whole
        if rest:
            fill = PACKET - 5 - rest
            stuffing = b"" if fill == 0 else b"\x00" + b"\xff" * (fill - 1)
            out.append(struct.pack(">BHBB", 0x47, MEDIA_PID, 0x30 | counter & 15, fill) + stuffing + pes[-rest:])
            counter += 1
    return b"".join(out)


@dataclass
class Media:
    """What a transport stream holds."""

    payload: bytes = b""
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    packets: int = 0
    gaps: int = 0
    bad_tables: int = 0
    stamps: list[int] = field(default_factory=list)
    #: (packet number, timestamp) of each point where reading may start.
    entries: list[tuple[int, int]] = field(default_factory=list)


def _table(packet: bytes, media: Media) -> bytes | None:
    """The body of the table section that starts in a packet."""
    start = 5 + packet[4]
    if packet[3] & 0x20:
        start = 6 + packet[4] + packet[5 + packet[4]]
    length = (packet[start + 1] & 0x0F) << 8 | packet[start + 2]
    section = packet[start : start + 3 + length]
    if table_crc(section) != 0:
        media.bad_tables += 1
        return None
    return section[8:-4]


def demux(stream: bytes) -> Media:
    """Parse a transport stream; counts counter gaps and bad tables, raises where packets lose their sync byte."""
    if len(stream) % PACKET:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise ValueError("lost sync")
    media = Media(packets=len(p))
    pids = (p[:, 1] & 0x1F).astype(np.int32) << 8 | p[:, 2]
    starts = p[:, 1] & 0x40 != 0
    for i in np.flatnonzero((pids == PAT_PID) & starts):
        body = _table(stream[i * PACKET : (i + 1) * PACKET], media)
        for k in range(0, len(body or b""), 4):
            number, pid = struct.unpack_from(">HH", body, k)
            media.programs[number] = pid & 0x1FFF
    for pmt in media.programs.values():
        for i in np.flatnonzero((pids == pmt) & starts):
            body = _table(stream[i * PACKET : (i + 1) * PACKET], media)
            k = 4 + (struct.unpack_from(">H", body, 2)[0] & 0x0FFF) if body else 0
            while body and k < len(body):
                kind, pid, info = struct.unpack_from(">BHH", body, k)
                media.streams[pid & 0x1FFF] = kind
                k += 5 + (info & 0x0FFF)
    parts = []
    for pid in sorted(media.streams):
        at = np.flatnonzero(pids == pid)
        q = p[at]
        counters = q[:, 3] & 15
        media.gaps += int(((counters[1:] - counters[:-1]) & 15 != 1).sum())
        adapted = q[:, 3] & 0x20 != 0
        skip = np.where(adapted, 5 + q[:, 4].astype(np.int32), 4)
        entry = adapted & (q[:, 4] > 0) & (q[:, 5] & 0x40 != 0)
        bounds = [*np.flatnonzero(q[:, 1] & 0x40).tolist(), len(q)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            rows, pieces, i = q[a:b], [], 0
            plain = skip[a:b] == 4
            odd = np.flatnonzero(~plain).tolist()
            for k in [*odd, b - a]:
                if k > i:
                    pieces.append(rows[i:k, 4:].tobytes())
                if k < b - a:
                    pieces.append(rows[k, skip[a + k] :].tobytes())
                i = k + 1
            pes = b"".join(pieces)
            if pes[:3] != b"\x00\x00\x01":
                raise ValueError("no PES packet where one should start")
            size, head = struct.unpack_from(">H", pes, 4)[0], pes[8]
            if pes[7] & 0x80:
                s = pes[9:14]
                t = (s[0] & 0x0E) << 29 | s[1] << 22 | (s[2] & 0xFE) << 14 | s[3] << 7 | s[4] >> 1
                media.stamps.append(t)
                if entry[a]:
                    media.entries.append((int(at[a]), t))
            parts.append(pes[9 + head : 6 + size])
    media.payload = b"".join(parts)
    return media


def padded(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 bytes with zeros up to a positive multiple of 64, bytes before them)."""
    raw = (text or "").encode()
    size = max(BLOCK, -(-len(raw) // BLOCK) * BLOCK)
    return raw.ljust(size, b"\0"), len(raw)


def _store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        streams, sizes = [], []
        for t in batch.column(1):
            payload, n = padded(t.as_py())
            streams.append(mux(payload))
            sizes.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(streams, pa.binary())], names=["id", "n_bytes", "media"])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, media)``: every whole text as a transport stream column, a row for each row of ``docs``.

    Null texts are empty, one block of zeros. Equal texts give equal streams, repeated rows included; a text of any
    length is one stream, in access units of ``UNIT`` bytes. Other columns aren't read, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_store, "id long, n_bytes long, media binary")


FEATURES = (
    "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "gaps long, stamps array<long>, entry_packets array<long>"
)


def _describe(payload: bytes, media: Media) -> str:
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    total = int((counts * np.arange(256)).sum())
    step = int(np.abs(np.diff(samples.astype(np.int16))).sum())
    return (
        f"packets={media.packets};units={len(media.stamps)};entries={len(media.entries)};gaps={media.gaps};bad_tables={media.bad_tables};"
        f"first={media.stamps[0]};last={media.stamps[-1]};min={samples.min()};max={samples.max()};sum={total};levels={int((counts > 0).sum())};step={step}"
    )


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for stream in batch.column(2):
            stream = stream.as_py()
            media = demux(stream)
            p = media.payload
            rows.append((
                len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(stream), hashlib.sha256(stream).hexdigest(), _describe(p, media),
                media.gaps, media.stamps, [e[0] for e in media.entries],
            ))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "gaps", "stamps", "entry_packets"]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "n_bytes", *names])


def media_features(media: DataFrame) -> DataFrame:
    """Digests, continuity gaps, timestamps and random-access packets of each stream of ``text_media``.

    A row for each row; an empty table gives an empty result. A stream that isn't whole packets, loses its sync byte
    or starts a unit without a PES header raises.
    """
    return media.select("id", "n_bytes", "media").mapInArrow(_read, FEATURES)
