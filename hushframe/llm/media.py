"""Media columns: baseline JPEG in numpy.

Reading: markers are parsed (SOF0, DHT, DQT, DRI, SOS, COM, RSTn, EOI), scans are Huffman-decoded to quantised coefficients, and a luminance thumbnail is reconstructed from the DC terms alone, one sample a block. All restart intervals of all pictures of a slice are decoded side by side, one symbol of each at a step, so the work is done on long arrays; a picture without restart markers is one interval.

Writing: a payload of bytes becomes the quantised coefficients of a picture. A unit of 192 bytes is one MCU of three blocks (Y, Cb, Cr, 4:4:4) in zigzag order, and byte b is the coefficient b - 128 below 128 and b - 127 from there, so no coefficient is zero. Entropy coding loses nothing: the payload comes back bit for bit. Each MCU is a restart interval, and a comment segment holds the payload's length, for the last row of MCUs may be filled up.

Cases: a null or empty text has a payload of 192 blanks; a stream that is cut off, damaged or not baseline raises ValueError; an empty table gives no rows; other columns of the input are ignored and may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table
from .textbytes import slices

UNIT, BLOCK, WIDE = 192, 64, 64
#: Code length of each magnitude category, for DC and AC alike; letters are of category 3 to 6, blanks of 7.
LENGTHS = {5: 1, 4: 3, 7: 3, 3: 4, 6: 4, 2: 6, 8: 6, 1: 7}


def canonical(counts, symbols) -> dict[int, tuple[int, int]]:
    """(code, length) of each symbol, from the number of codes of each length."""
    found, code, at = {}, 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            found[symbols[at]] = (code, n)
            code, at = code + 1, at + 1
        if code > 1 << n:
            raise ValueError("a Huffman table has too many codes")
        code <<= 1
    return found


ORDER = sorted(LENGTHS, key=lambda s: (LENGTHS[s], s))
COUNTS = [sum(n == k for n in LENGTHS.values()) for k in range(1, 17)]
VALUE = np.array([b - 128 if b < 128 else b - 127 for b in range(256)])
_CODES = [(canonical(COUNTS, ORDER)[n], n, v if v > 0 else v + (1 << n) - 1) for v in VALUE.tolist() for n in [abs(v).bit_length()]]
CODE = np.array([c << n | bits for (c, _), n, bits in _CODES], np.uint32)
LENGTH = np.array([k + n for (_, k), n, _ in _CODES], np.int64)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_DHT = b"".join(segment(0xC4, bytes([kind, *COUNTS, *ORDER])) for kind in (0x00, 0x10))
_DQT = segment(0xDB, bytes([0, 8] + [1] * 63))  # DC steps of 8: a block's mean is its first coefficient + 128
_TAIL = segment(0xDD, struct.pack(">H", 1)) + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))


def grid(units: int) -> tuple[int, int]:
    """Columns and rows of MCUs."""
    wide = min(units, max(WIDE, -(-units // 8191)))
    return wide, -(-units // wide)


def head(units: int) -> bytes:
    """Everything before the scan's data."""
    wide, high = grid(units)
    frame = struct.pack(">BHHB", 8, 8 * high, 8 * wide, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + segment(0xFE, b"payload %d" % (units * UNIT)) + _DQT + segment(0xC0, frame) + _DHT + _TAIL


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload, which must be a positive multiple of UNIT long."""
    units = [len(p) // UNIT for p in payloads]
    mcus = np.array([grid(u)[0] * grid(u)[1] for u in units])
    data = np.frombuffer(b"".join(p.ljust(n * UNIT) for p, n in zip(payloads, mcus.tolist(), strict=True)), np.uint8).reshape(-1, UNIT)
    length = LENGTH[data]
    ends = np.cumsum(length, axis=1)
    size = -(-ends[:, -1] // 8)
    first = np.cumsum(size) - size
    at = ((first * 8)[:, None] + ends - length).ravel()
    window = CODE[data].ravel() << (24 - (at & 7) - length.ravel()).astype(np.uint32)
    at >>= 3
    out = np.zeros(int(size.sum()) + 2, np.uint8)
    for i in range(3):  # codes do not overlap, so that adding them up is the same as or
        part = np.bincount(at + i, ((window >> np.uint32(16 - 8 * i)) & np.uint32(255)), len(out))
        out += part[: len(out)].astype(np.uint8)
    out = out[:-2]
    last = first + size - 1
    out[last] |= ((1 << (size * 8 - ends[:, -1])) - 1).astype(np.uint8)
    # A zero after each 255, a restart marker after each interval but a picture's last.
    owner_end = np.cumsum(mcus) - 1
    number = np.arange(len(size)) - np.repeat(np.cumsum(mcus) - mcus, mcus)
    more = np.ones(len(size), bool)
    more[owner_end] = False
    room = 1 + (out == 255).astype(np.int64)
    room[last] += 2 * more
    stop = np.cumsum(room)
    final = np.zeros(int(stop[-1]), np.uint8)
    final[stop - room] = out
    marks = stop[last[more]]
    final[marks - 2], final[marks - 1] = 0xFF, 0xD0 + number[more] % 8
    raw, cuts = final.tobytes(), [0, *stop[last[owner_end]].tolist()]
    return [head(u) + raw[a:b] + b"\xff\xd9" for u, a, b in zip(units, cuts[:-1], cuts[1:], strict=True)]


@dataclass
class Scan:
    """One scan: where its blocks go, and its data without stuffing and markers."""

    data: np.ndarray
    starts: np.ndarray  # of the intervals, in data
    components: list[tuple[int, int, int, int, int]]  # (component, columns and rows of its blocks in an MCU, DC table, AC table)
    wide: int  # MCUs
    high: int
    interval: int


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    comments: list[bytes] = field(default_factory=list)
    quantisers: dict[int, list[int]] = field(default_factory=dict)
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # identifier, horizontal and vertical factor, quantiser
    scans: list[Scan] = field(default_factory=list)
    tables: list[tuple] = field(default_factory=list)  # of all Huffman tables met: (counts, symbols)


def parse(raw: bytes) -> Picture:
    """Markers, and scans with their data made ready."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    p, at, interval, tables = Picture(), 2, 0, {}
    try:
        while True:
            if raw[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker = raw[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                return p
            n = struct.unpack_from(">H", raw, at + 2)[0]
            body, at = raw[at + 4 : at + 2 + n], at + 2 + n
            if len(body) != n - 2:
                raise ValueError("a segment is cut off")
            if marker == 0xFE:
                p.comments.append(body)
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    p.quantisers[body[0] & 15] = list(struct.unpack_from(">64H" if wide else "64B", body, 1))
                    body = body[129 if wide else 65 :]
            elif marker == 0xC4:
                while body:
                    count = sum(body[1:17])
                    tables[body[0]] = len(p.tables)
                    p.tables.append((body[1:17], body[17 : 17 + count]))
                    body = body[17 + count :]
            elif marker == 0xDD:
                interval = struct.unpack(">H", body)[0]
            elif marker == 0xC0:
                _, p.height, p.width, count = struct.unpack_from(">BHHB", body)
                p.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
            elif 0xC1 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError("not baseline")
            elif marker == 0xDA:
                at = scan(raw, at, body, p, interval, tables)
    except (IndexError, struct.error, KeyError) as e:
        raise ValueError("a damaged JPEG") from e


def scan(raw: bytes, at: int, body: bytes, p: Picture, interval: int, tables: dict) -> int:
    """Adds a scan; the position after it."""
    top_h, top_v = max(c[1] for c in p.components), max(c[2] for c in p.components)
    chosen, names = [], [c[0] for c in p.components]
    for i in range(body[0]):
        which, t = names.index(body[1 + 2 * i]), body[2 + 2 * i]
        chosen.append((which, p.components[which][1], p.components[which][2], tables[t >> 4], tables[0x10 | t & 15]))
    if len(chosen) == 1:  # alone in its scan, a component has one block in each MCU
        which, h, v, dc, ac = chosen[0]
        chosen = [(which, 1, 1, dc, ac)]
        wide, high = -(-(-(-p.width * h // top_h)) // 8), -(-(-(-p.height * v // top_v)) // 8)
    else:
        wide, high = -(-p.width // (8 * top_h)), -(-p.height // (8 * top_v))
    data = np.frombuffer(raw, np.uint8, offset=at)
    ff = np.flatnonzero(data[:-1] == 255)
    after = data[ff + 1]
    end = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
    if not len(end):
        raise ValueError("a scan has no end")
    end = int(end[0])
    ff, after = ff[ff < end], after[: int(np.searchsorted(ff, end))]
    keep = np.ones(end, bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[after != 0]
    keep[marks] = keep[marks + 1] = False
    starts = np.append(0, np.cumsum(keep)[marks]) if len(marks) else np.zeros(1, np.int64)
    if len(starts) != (-(-wide * high // interval) if interval else 1):
        raise ValueError("restart intervals are missing")
    p.scans.append(Scan(data[:end][keep], starts, chosen, wide, high, interval or wide * high))
    return at + end


def look_up(counts: bytes, symbols: bytes) -> np.ndarray:
    """For every 16 bits the length of the code they begin with, times 256, and its symbol; 0 where there is none."""
    found = np.zeros(1 << 16, np.uint16)
    for symbol, (code, n) in canonical(counts, symbols).items():
        found[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
    return found


def decode(pictures: list[Picture]) -> list[list[np.ndarray]]:
    """For each scan of each picture its blocks in the order of the stream, as (blocks, 64) quantised coefficients in zigzag order."""
    scans = [(p, s) for p in pictures for s in p.scans]
    if not scans:
        return [[] for _ in pictures]
    numbers: dict[tuple, int] = {}
    kinds: dict[tuple, int] = {}
    schedules: list[tuple[list[int], list[int], list[int]]] = []
    base, total, lanes = 0, 0, []
    for p, s in scans:
        plan = []
        for which, h, v, dc, ac in s.components:
            plan += [(which, numbers.setdefault(p.tables[dc], len(numbers)), numbers.setdefault(p.tables[ac], len(numbers)))] * (h * v)
        kind = kinds.setdefault(tuple(plan), len(kinds))
        if kind == len(schedules):
            schedules.append(tuple(list(x) for x in zip(*plan, strict=True)))
        mcus = np.minimum(s.interval, s.wide * s.high - np.arange(len(s.starts)) * s.interval)
        blocks = mcus * len(plan)
        lanes.append(np.column_stack([s.starts + base, np.append(s.starts[1:], len(s.data)) + base, total + np.cumsum(blocks) - blocks, blocks, np.full(len(blocks), kind)]))
        base += len(s.data)
        total += int(blocks.sum())
    tables = np.stack([look_up(*t) for t in numbers]).ravel()
    width = max(len(x[0]) for x in schedules)
    per = np.array([len(x[0]) for x in schedules])
    component, dc, ac = (np.array([x[i] + [0] * (width - len(x[i])) for x in schedules]) for i in range(3))
    lane = np.concatenate(lanes)
    data = np.concatenate([*(s.data for _, s in scans), np.zeros(8, np.uint8)])
    # Three bytes on from any place, so that 16 bits can be read at any bit and up to 11 more after a code.
    word = data[:-4].astype(np.uint64) << np.uint64(32) | data[1:-3].astype(np.uint64) << np.uint64(24) | data[2:-2].astype(np.uint64) << np.uint64(16) | data[3:-1].astype(np.uint64) << np.uint64(8) | data[4:]
    out = np.zeros((total, BLOCK), np.int16)
    pos, stop, block, left, kind = lane[:, 0] * 8, lane[:, 1] * 8, lane[:, 2], lane[:, 3], lane[:, 4]
    unit = np.zeros(len(lane), np.int64)
    k = np.zeros(len(lane), np.int64)
    before = np.zeros((len(lane), int(component.max()) + 1), np.int64)
    flat = out.reshape(-1)
    while len(pos):
        is_dc = k == 0
        which = np.where(is_dc, dc[kind, unit], ac[kind, unit])
        bits = word[pos >> 3] << (pos & 7).astype(np.uint64) & np.uint64((1 << 40) - 1)
        found = tables[which << 16 | (bits >> np.uint64(24)).astype(np.int64)].astype(np.int64)
        n, symbol = found >> 8, found & 255
        size, run = symbol & 15, symbol >> 4
        extra = ((bits >> (40 - n - size).astype(np.uint64)).astype(np.int64)) & ((1 << size) - 1)
        value = np.where((size > 0) & (extra < 1 << np.maximum(size - 1, 0)), extra - (1 << size) + 1, extra)
        pos = pos + n + size
        if (n == 0).any() or (pos > stop).any():
            raise ValueError("a damaged scan")
        rows = np.flatnonzero(is_dc)
        if len(rows):
            c = component[kind[rows], unit[rows]]
            before[rows, c] += value[rows]
            value[rows] = before[rows, c]
        eob, zrl = ~is_dc & (symbol == 0), ~is_dc & (symbol == 0xF0)
        at = k + np.where(is_dc, 0, run)
        if (at > 63).any():
            raise ValueError("a damaged scan")
        put = is_dc | (size > 0)
        if put.all():
            flat[block * BLOCK + at] = value
        else:
            flat[(block * BLOCK + at)[put]] = value[put]
        k = np.where(eob, BLOCK, np.where(zrl, k + 16, at + 1))
        full = k >= BLOCK
        if full.any():
            k[full] = 0
            block = block + full
            left = left - full
            unit = np.where(full, (unit + 1) % per[kind], unit)
            if not left.all():
                go = left > 0
                pos, stop, block, left, kind, unit, k, before = (x[go] for x in (pos, stop, block, left, kind, unit, k, before))
    cuts = np.cumsum([0, *(s.wide * s.high * sum(h * v for _, h, v, _, _ in s.components) for _, s in scans)])
    pieces = iter(out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return [[next(pieces) for _ in p.scans] for p in pictures]


def thumbnail(p: Picture, scans: list[np.ndarray]) -> np.ndarray:
    """The luminance plane at an eighth of its size: the mean of each block, from its DC term."""
    for s, blocks in zip(p.scans, scans, strict=True):
        first = 0
        for which, h, v, _, _ in s.components:
            if which == 0:
                units = sum(h * v for _, h, v, _, _ in s.components)
                dc = blocks[:, 0].reshape(s.high, s.wide, units)[:, :, first : first + h * v].reshape(s.high, s.wide, v, h)
                plane = dc.transpose(0, 2, 1, 3).reshape(s.high * v, s.wide * h)
                return np.clip(plane * (p.quantisers[p.components[0][3]][0] / 8) + 128, 0, 255).round().astype(np.uint8)
            first += h * v
    raise ValueError("no luminance")


def shrunk(plane: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Means over a grid of high x wide fields; a field smaller than a sample takes that sample."""
    sums = np.zeros((plane.shape[0] + 1, plane.shape[1] + 1))
    np.cumsum(np.cumsum(plane, axis=0, dtype=float), axis=1, out=sums[1:, 1:])
    r0, c0 = (np.arange(n) * size // n for n, size in ((high, plane.shape[0]), (wide, plane.shape[1])))
    r1 = np.maximum(r0 + 1, (np.arange(high) + 1) * plane.shape[0] // high)
    c1 = np.maximum(c0 + 1, (np.arange(wide) + 1) * plane.shape[1] // wide)
    area = (r1 - r0)[:, None] * (c1 - c0)[None, :]
    return (sums[r1][:, c1] - sums[r0][:, c1] - sums[r1][:, c0] + sums[r0][:, c0]) / area


def feature(p: Picture, plane: np.ndarray) -> str:
    """Width x height in pixels, the thumbnail's mean hash and its difference hash."""
    small, slope = shrunk(plane, 8, 8), shrunk(plane, 8, 9)
    mean = np.packbits(small > small.mean()).tobytes().hex()
    return f"{p.width}x{p.height}:{mean}:{np.packbits(slope[:, 1:] > slope[:, :-1]).tobytes().hex()}"


def payload(p: Picture, scans: list[np.ndarray]) -> bytes:
    """The bytes that encode() stored."""
    size = int(next(c for c in p.comments if c.startswith(b"payload ")).split()[1])
    value = scans[0].reshape(-1)[:size]
    return np.where(value < 0, value + 128, value + 127).astype(np.uint8).tobytes()


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's payload as a JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "__text"):
                raw, size = data.tobytes(), np.diff(offsets)
                full = [raw[a : a + n].ljust(max(UNIT, -(-n // UNIT) * UNIT)) for a, n in zip(offsets.tolist(), size.tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(encode(full), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def described(media: DataFrame) -> DataFrame:
    """Reads the column media of (doc_id, n_bytes, media) back; what was stored, and the thumbnail's feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum([0, *(len(m) for m in (x.as_buffer() for x in batch.column("media")))]) if batch.num_rows else np.zeros(1)
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(size, size[first] + (1 << 20), "right")) - 1)
                part = batch.slice(first, last - first)
                first = last
                raw = part.column("media").to_pylist()
                pictures = [parse(x) for x in raw]
                found = decode(pictures)
                back = [payload(p, s) for p, s in zip(pictures, found, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("n_bytes"), pa.array([len(x) for x in back], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in back]), pa.array([zlib.crc32(x[-16:]) for x in back], pa.int64()),
                    pa.array([len(x) for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([feature(p, thumbnail(p, s)) for p, s in zip(pictures, found, strict=True)]),
                ], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op1_jpeg_media(spark, sf_dir: str) -> DataFrame:
    return described(stored(table(spark, sf_dir, "documents")))
