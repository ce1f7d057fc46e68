"""Media columns: byte payloads stored as MPEG transport streams and read back.

Layout: programme association and map tables every ``TABLE_EVERY`` frames, one
private elementary stream whose packets hold ``FRAME`` 8-bit samples each with a
presentation time stamp, a clock reference and the random-access flag on every
``RANDOM_EVERY``-th frame.  The reader knows none of this: it follows the tables,
checks continuity counters and table checksums, and reassembles the packets.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, map_rows

# Fixed values of the transport stream format.
PACKET = 188
SYNC = 0x47
PAT_PID = 0x0000
CRC_POLY = 0x04C11DB7
PRIVATE_STREAM = 0xBD
PRIVATE_TYPE = 0x06
CLOCK = 90_000

# Our layout.
PMT_PID = 0x1000
ES_PID = 0x0100
PROGRAM = 1
FRAME = 576
RATE = 8_000
FRAME_TICKS = FRAME * CLOCK // RATE
RANDOM_EVERY = 16
TABLE_EVERY = 64
PAD = b"\xff"


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1) ^ (CRC_POLY if value & 0x80000000 else 0)
        table.append(value & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2 of a table section."""
    value = 0xFFFFFFFF
    for byte in data:
        value = ((value << 8) & 0xFFFFFFFF) ^ _CRC[(value >> 24) ^ byte]
    return value


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    data = head + body
    return data + section_crc(data).to_bytes(4, "big")


PAT_SECTION = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT_SECTION = _section(
    0x02,
    PROGRAM,
    (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00",
)


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter & 15])
    return head + (b"\x00" + section).ljust(PACKET - 4, PAD)


def _stamp(ticks: int) -> bytes:
    t = ticks & 0x1FFFFFFFF
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def _clock(ticks: int) -> bytes:
    t = ticks & 0x1FFFFFFFF
    return (t << 15 | 0x7E00).to_bytes(6, "big")


def write_stream(payload: bytes) -> bytes:
    """Transport stream of ``payload``, whose length is a multiple of ``FRAME``."""
    out: list[bytes] = []
    counter = table = 0
    for number, at in enumerate(range(0, len(payload), FRAME)):
        if number % TABLE_EVERY == 0:
            out += (_table_packet(PAT_PID, table, PAT_SECTION), _table_packet(PMT_PID, table, PMT_SECTION))
            table += 1
        samples = payload[at : at + FRAME]
        ticks = number * FRAME_TICKS
        unit = b"\x00\x00\x01\xbd" + (8 + len(samples)).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(ticks) + samples
        fields = b"\x50" + _clock(ticks) if number % RANDOM_EVERY == 0 else b""
        done, start = 0, 0x40
        while done < len(unit):
            room = PACKET - 4 - (len(fields) + 1 if fields else 0)
            left = len(unit) - done
            if left < room:  # stuffing goes into the adaptation field
                fields = (fields or (b"\x00" if room - left > 1 else b"")).ljust(PACKET - 5 - left, PAD)
                head = bytes([SYNC, start | ES_PID >> 8, ES_PID & 0xFF, 0x30 | counter & 15, len(fields)])
                out += (head, fields, unit[done:])
                done = len(unit)
            else:
                if fields:
                    out += (bytes([SYNC, start | ES_PID >> 8, ES_PID & 0xFF, 0x30 | counter & 15, len(fields)]), fields)
                else:
                    out.append(bytes([SYNC, start | ES_PID >> 8, ES_PID & 0xFF, 0x10 | counter & 15]))
                out.append(unit[done : done + room])
                done += room
            fields, start = b"", 0
            counter += 1
    return b"".join(out)


@dataclass
class Stream:
    """What a reader finds in a transport stream."""

    payload: bytes = b""
    stamps: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)  # byte offsets of packets that start such a frame
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    packets: int = 0
    breaks: int = 0
    bad_tables: int = 0


def _read_table(data: bytes, found: Stream) -> bytes | None:
    start = 1 + data[0]
    size = 3 + ((data[start + 1] & 0x0F) << 8 | data[start + 2])
    section = data[start : start + size]
    if section_crc(section):
        found.bad_tables += 1
        return None
    return section


def read_stream(data: bytes) -> Stream:
    """Parse tables, check continuity and reassemble the first elementary stream named by them."""
    found = Stream()
    last: dict[int, int] = {}
    parts: list[bytes] = []
    unit: list[bytes] = []
    checked: dict[bytes, bool] = {}
    map_pids: set[int] = set()
    main = -1

    def close() -> None:
        if not unit:
            return
        whole = b"".join(unit)
        if whole[:3] != b"\x00\x00\x01":
            found.breaks += 1
        else:
            if whole[7] & 0x80:
                s = whole[9:14]
                found.stamps.append((s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1)
            size = int.from_bytes(whole[4:6], "big")
            parts.append(whole[9 + whole[8] : 6 + size if size else None])
        unit.clear()

    for at in range(0, len(data) - PACKET + 1, PACKET):
        found.packets += 1
        if data[at] != SYNC:
            found.breaks += 1
            continue
        second, flags = data[at + 1], data[at + 3]
        pid = (second & 0x1F) << 8 | data[at + 2]
        body, random = at + 4, False
        if flags & 0x20:
            size = data[body]
            random = size > 0 and bool(data[body + 1] & 0x40)
            body += 1 + size
        if not flags & 0x10:
            continue
        count = flags & 15
        if last.get(pid, count - 1) + 1 & 15 != count:
            found.breaks += 1
        last[pid] = count
        if pid == main:
            if second & 0x40:
                close()
                if random:
                    found.random_access.append(at)
            unit.append(data[body : at + PACKET])
        elif (pid == PAT_PID or pid in map_pids) and second & 0x40:
            content = data[body : at + PACKET]
            if checked.get(content):
                continue
            section = _read_table(content, found)
            checked[content] = section is not None
            if section is None:
                continue
            if pid == PAT_PID:
                for i in range(8, len(section) - 4, 4):
                    number = int.from_bytes(section[i : i + 2], "big")
                    if number:
                        found.programs[number] = int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF
                map_pids = set(found.programs.values())
            else:
                i = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF)
                while i < len(section) - 4:
                    stream = int.from_bytes(section[i + 1 : i + 3], "big") & 0x1FFF
                    found.streams[stream] = section[i]
                    i += 5 + (int.from_bytes(section[i + 3 : i + 5], "big") & 0x0FFF)
                main = min(found.streams, default=-1)
    close()
    found.payload = b"".join(parts)
    return found


def padded(text: bytes) -> bytes:
    """``text`` and bytes 255 up to a positive multiple of ``FRAME``."""
    size = max(1, -(-len(text) // FRAME)) * FRAME
    return text.ljust(size, PAD)


def feature_of(stream: Stream) -> str:
    """Integer features of what was read back."""
    samples = stream.payload
    return (
        f"program={','.join(map(str, stream.programs))};type={','.join(map(str, stream.streams.values()))}"
        f";packets={stream.packets};breaks={stream.breaks};bad_tables={stream.bad_tables};frames={len(stream.stamps)}"
        f";random={len(stream.random_access)};first={stream.stamps[0]};last={stream.stamps[-1]}"
        f";mean={sum(samples) // len(samples)};peak={max(samples)}"
    )


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a transport stream and read it back.

    Returns one row per input row: ``id, n_bytes, payload, media, stamps, random_access, feature``.
    A null text is the empty text and gives one frame of padding; very long texts are stored whole, a few
    rows at a time; there are no ties, as rows don't meet; repeated rows give equal results; an empty table
    gives an empty table; a null id stays null; other columns are left out, so names cannot clash.
    """
    schema = "id bigint, n_bytes bigint, payload binary, media binary, stamps array<bigint>, random_access array<bigint>, feature string"

    def store(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for text in batch.column(1).to_pylist():
            media = write_stream(padded(text))
            back = read_stream(media)
            rows.append((len(text), back.payload, media, back.stamps, back.random_access, feature_of(back)))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), *arrays],
            names=["id", "n_bytes", "payload", "media", "stamps", "random_access", "feature"],
        )

    rows = keyed(df, id_col, text_col)
    return map_rows(rows.select(rows.id.cast("bigint").alias("id"), rows.body.cast("binary").alias("body")), store, schema, 64)
