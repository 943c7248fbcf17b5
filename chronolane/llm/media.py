"""Motion-JPEG AVI columns: RIFF indexes, intra frames, shots and timed clip rows.

Frames are baseline JPEG with Huffman coding. They are decoded at one eighth of
their size, where a sample is the mean of an 8 x 8 block and follows from its
DC coefficient alone; this is the usual picture for finding shots. All restart
intervals of all frames of an Arrow batch are decoded side by side in numpy,
one block of each at a time.

``store`` writes bytes as such frames: each byte is one flat 8 x 8 block whose
quantised DC coefficient is the byte less 128, so the decoded samples are the
bytes. A row of 64 blocks is one restart interval, 16 rows are one frame, and a
``strd`` chunk holds the number of bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOC_ID, TEXT, texts, utf8

ROW, ROWS, FPS = 64, 16, 25
#: Fixed values of the JPEG standard: how many codes of each length its DC table has (lengths 1 to 16), and the zigzag order's DC quantiser used here.
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_QUANTISER = 8
#: Shots: bins of a frame's histogram, frames looked back at, and how far a change must stand out.
BINS, BACK, DEVIATIONS, FLOOR = 32, 8, 3.0, 0.25
CLIP = "array<struct<start_s:double,end_s:double,first_frame:int,n_frames:int>>"


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _canonical(lengths: tuple[int, ...], symbols: bytes) -> list[tuple[int, int, int]]:
    """(code, its length, symbol) of a Huffman table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(lengths, 1):
        for _ in range(n):
            out.append((code, length, symbols[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _frame_head(rows: int) -> bytes:
    dc, ac = bytes(range(12)), bytes([0])
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, bytes([0, DC_QUANTISER]) + b"\x01" * 63),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * rows, 8 * ROW, 1, 1, 0x11, 0)),
            _segment(0xC4, bytes([0x00, *DC_LENGTHS]) + dc),
            _segment(0xC4, bytes([0x10, 1, *[0] * 15]) + ac),
            _segment(0xDD, struct.pack(">H", ROW)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def _code_table() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a flat block whose DC differs by d from the last, at index d + 255."""
    codes = {s: (c, n) for c, n, s in _canonical(DC_LENGTHS, bytes(range(12)))}
    bits, sizes = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        value = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255] = ((code << size) | value) << 1  # and the one-bit code for the end of the block
        sizes[d + 255] = n + size + 1
    return bits, sizes


_BITS, _SIZES = _code_table()


def _scans(samples: np.ndarray) -> list[bytes]:
    """The entropy-coded data of each frame; ``samples``: frames x ROWS x ROW bytes."""
    n = samples.shape[0] * ROWS
    levels = samples.reshape(n, ROW).astype(np.int64) - 128
    diff = np.diff(levels, axis=1, prepend=0) + 255
    sizes, bits = _SIZES[diff], _BITS[diff]
    ends = np.cumsum(sizes, axis=1)
    total = ends[:, -1]
    n_bytes = (total + 7) // 8
    first = np.cumsum(n_bytes) - n_bytes
    at = (ends - sizes) + (first * 8)[:, None]
    words = bits << (32 - sizes - (at & 7))
    where, length = (at >> 3).ravel(), int(n_bytes.sum()) + 4
    raw = np.zeros(length)
    for i in range(4):
        raw += np.bincount(where + i, ((words >> (24 - 8 * i)) & 255).ravel(), length)
    raw = raw[: length - 4].astype(np.uint8)
    raw[first + n_bytes - 1] |= ((1 << ((-total) % 8)) - 1).astype(np.uint8)
    # A zero goes after each 255, and a restart marker after each row but a frame's last.
    stuffed = raw == 255
    marked = np.zeros(len(raw), np.int64)
    inner = np.arange(n) % ROWS != ROWS - 1
    marked[(first + n_bytes - 1)[inner]] = 2
    shift = np.cumsum(stuffed + marked) - stuffed - marked
    out = np.zeros(len(raw) + int(stuffed.sum() + marked.sum()), np.uint8)
    place = np.arange(len(raw)) + shift
    out[place] = raw
    markers = place[(first + n_bytes - 1)[inner]] + 1 + stuffed[(first + n_bytes - 1)[inner]]
    out[markers] = 255
    out[markers + 1] = 0xD0 + (np.arange(n) % ROWS % 8)[inner]
    frame_ends = (first + n_bytes - 1)[ROWS - 1 :: ROWS]
    cuts = place[frame_ends] + 1 + stuffed[frame_ends]
    data = out.tobytes()
    return [data[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def _avi(frames: list[bytes], n_bytes: int) -> bytes:
    width, height, largest = 8 * ROW, 8 * ROWS, max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", n_bytes))))
    chunks = [_chunk(b"00dc", f) for f in frames]
    index, at = [], 4
    for f, c in zip(frames, chunks):
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + head + _list(b"movi", b"".join(chunks)) + _chunk(b"idx1", b"".join(index)))


def encode_batch(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload."""
    size, head = ROW * ROWS, _frame_head(ROWS)
    counts = [max(1, -(-len(p) // size)) for p in payloads]
    samples = np.frombuffer(b"".join(p + bytes(c * size - len(p)) for p, c in zip(payloads, counts)), np.uint8)
    scans = iter(_scans(samples.reshape(-1, ROWS, ROW))) if payloads else iter(())
    return [_avi([head + next(scans) + b"\xff\xd9" for _ in range(c)], len(p)) for p, c in zip(payloads, counts)]


@dataclass
class Video:
    frames: list[bytes] = field(default_factory=list)
    fps: float = float(FPS)
    payload_bytes: int | None = None


def parse_avi(data: bytes) -> Video:
    """Frames of the first video stream, by the index if there is one, else in the order of the movi list. Broken files give the frames that can be told."""
    out, movi, index = Video(), None, None

    open_lists = [(0, len(data))]
    while open_lists:
        at, end = open_lists.pop()
        if at + 8 > end:
            continue
        name, size = struct.unpack_from("<4sI", data, at)
        body, stop = at + 8, min(at + 8 + size, end)
        open_lists.append((body + size + size % 2, end))
        if name in (b"RIFF", b"LIST"):
            if data[body : body + 4] == b"movi":
                movi = (body, stop)
            else:
                open_lists.append((body + 4, stop))
        elif name == b"strh" and data[body : body + 4] == b"vids" and stop - body >= 28:
            scale, rate = struct.unpack_from("<II", data, body + 20)
            out.fps = rate / scale if scale and rate else out.fps
        elif name == b"strd" and stop - body == 8:
            out.payload_bytes = struct.unpack_from("<Q", data, body)[0]
        elif name == b"idx1":
            index = (body, stop)
    if movi is None:
        return out
    if index is not None:
        entries = [struct.unpack_from("<4sIII", data, i) for i in range(index[0], index[1] - 15, 16)]
        offsets = [(at, size) for name, _, at, size in entries if name[2:] in (b"dc", b"db")]
        if offsets:
            base = movi[0] if data[movi[0] + offsets[0][0] :][2:4] in (b"dc", b"db") else 0
            out.frames = [data[base + at + 8 : base + at + 8 + size] for at, size in offsets]
            return out
    at = movi[0] + 4
    while at + 8 <= movi[1]:
        name, size = struct.unpack_from("<4sI", data, at)
        if name[2:] in (b"dc", b"db"):
            out.frames.append(data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out


@dataclass
class Head:
    """What the segments before a frame's scan say."""

    width: int
    height: int
    components: list[tuple[int, int, int, int]]  # horizontal and vertical sampling, DC and AC table
    quantiser: int
    interval: int
    tables: dict[int, tuple[np.ndarray, np.ndarray]]  # class and number -> symbol and length by the next 16 bits
    scan_at: int

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = max(c[0] for c in self.components), max(c[1] for c in self.components)
        if len(self.components) == 1:
            h = v = 1
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse_head(frame: bytes) -> Head | None:
    """None for a frame that is not baseline JPEG with its own tables."""
    at, quantisers, tables, interval, size, parts = 2, {}, {}, 0, None, {}
    try:
        while True:
            if frame[at] != 0xFF:
                return None
            marker, length = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
            body = frame[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quantisers[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[1 + 64 * (1 + bool(wide)) :]
            elif marker == 0xC4:
                while body:
                    lengths = tuple(body[1:17])
                    symbol, n_bits = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
                    for code, n, s in _canonical(lengths, body[17:]):
                        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
                        n_bits[code << (16 - n) : (code + 1) << (16 - n)] = n
                    tables[body[0]] = (symbol, n_bits)
                    body = body[17 + sum(lengths) :]
            elif marker in (0xC0, 0xC1):
                size = struct.unpack_from(">HH", body, 1)
                parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
            elif 0xC2 <= marker <= 0xCF:
                return None
            elif marker == 0xDD:
                interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                own = [(parts[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])]
                components = [(h, v, t >> 4, 0x10 | (t & 15)) for (h, v, _), t in own]
                if size is None or any(t not in tables for c in components for t in c[2:]):
                    return None
                return Head(size[1], size[0], components, quantisers[own[0][0][2]], interval, tables, at)
    except (IndexError, KeyError, struct.error):
        return None


def _decode_alike(head: Head, scans: list[bytes]) -> list[np.ndarray]:
    """One-eighth luma pictures of frames that share all that stands before their scans."""
    wide, tall = head.mcus
    per_mcu = [(i, h if len(head.components) > 1 else 1, v if len(head.components) > 1 else 1, dc, ac) for i, (h, v, dc, ac) in enumerate(head.components)]
    plan = [(i, dc, ac) for i, h, v, dc, ac in per_mcu for _ in range(h * v)]
    h0, v0 = per_mcu[0][1:3]
    interval = head.interval or wide * tall
    lanes_each = -(-(wide * tall) // interval)
    # Unstuffed bytes of all scans, cut where markers stood.
    data = np.frombuffer(b"".join(s + b"\xff\xd9" for s in scans), np.uint8)
    after = np.append(data[1:], 0)
    mark = (data == 255) & (after != 0)
    gone = mark | np.append(False, mark[:-1]) | np.append(False, (data[:-1] == 255) & (data[1:] == 0))
    ends = np.cumsum(~gone)[np.nonzero(mark)[0]]
    kept = np.concatenate([data[~gone], np.zeros(8, np.uint8)]).astype(np.int64)
    starts = np.append(0, ends[:-1])
    frame_of = np.cumsum(np.append(0, after[np.nonzero(mark)[0]][:-1] == 0xD9))
    lane = np.arange(len(starts)) - np.searchsorted(frame_of, frame_of)
    good = lane < lanes_each
    starts, frame_of, lane = starts[good], frame_of[good], lane[good]
    windows = (kept[:-4] << 32) | (kept[1:-3] << 24) | (kept[2:-2] << 16) | (kept[3:-1] << 8) | kept[4:]
    top = len(windows) - 1
    pos = starts * 8
    blocks = np.minimum(interval, wide * tall - lane * interval)
    pred = np.zeros((len(head.components), len(starts)), np.int64)
    picture = np.zeros((len(scans), tall * v0, wide * h0), np.uint8)

    def peek(where: np.ndarray, n: int) -> np.ndarray:
        return (windows[np.minimum(where >> 3, top)] >> (40 - n - (where & 7))) & ((1 << n) - 1)

    for mcu in range(int(blocks.max(initial=0))):
        live = np.nonzero(blocks > mcu)[0]
        own, seen = pos[live], 0
        for component, dc, ac in plan:
            symbol, n_bits = head.tables[dc]
            code = peek(own, 16)
            size = symbol[code].astype(np.int64)
            own = own + n_bits[code]
            value = peek(own, 16) >> (16 - size)
            own = own + size
            pred[component, live] += np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)
            # AC coefficients are only stepped over.
            symbol, n_bits = head.tables[ac]
            open_at, k = np.arange(len(live)), np.ones(len(live), np.int64)
            while len(open_at):
                code = peek(own[open_at], 16)
                s, n = symbol[code].astype(np.int64), n_bits[code].astype(np.int64)
                own[open_at] += n + (s & 15)
                k[open_at] += (s >> 4) + 1
                open_at = open_at[(s != 0) & (k[open_at] < 64) & (n > 0)]
            if component == 0:
                number = lane[live] * interval + mcu
                y, x = number // wide * v0 + seen // h0, number % wide * h0 + seen % h0
                picture[frame_of[live], y, x] = np.clip((pred[0, live] * head.quantiser + 4) // 8 + 128, 0, 255)
                seen += 1
        pos[live] = own
    return [*picture]


def decode_frames(frames: list[bytes]) -> list[np.ndarray | None]:
    """The one-eighth luma picture of each frame, None where it is no baseline JPEG."""
    heads: dict[bytes, Head | None] = {}
    groups: dict[bytes, list[int]] = {}
    out: list[np.ndarray | None] = [None] * len(frames)
    for i, f in enumerate(frames):
        at = 2
        while at + 4 <= len(f) and f[at] == 0xFF and f[at + 1] != 0xDA:
            at += 2 + (f[at + 2] << 8 | f[at + 3])
        at += 2 + (f[at + 2] << 8 | f[at + 3]) if at + 4 <= len(f) else 0
        key = f[:at]
        if key not in heads:
            heads[key] = parse_head(f)
        groups.setdefault(key, []).append(i)
    for key, members in groups.items():
        if heads[key] is None:
            continue
        scans = []
        for i in members:
            scan = frames[i][heads[key].scan_at :]
            scans.append(scan[: scan.rfind(b"\xff\xd9")] if b"\xff\xd9" in scan else scan)
        for i, picture in zip(members, _decode_alike(heads[key], scans)):
            out[i] = picture
    return out


def shots(pictures: list[np.ndarray], fps: float) -> list[dict]:
    """Clips between cuts. A cut is a change of the histogram that stands out from the last ``BACK`` changes of its shot."""
    if not pictures:
        return []
    hist = np.stack([np.bincount(p.ravel() >> 3, minlength=BINS) / p.size for p in pictures])
    change = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    cuts, first = [0], 0
    for i, c in enumerate(change.tolist()):
        back = change[max(first, i - BACK) : i]
        least = max(FLOOR, back.mean() + DEVIATIONS * back.std()) if len(back) else 2 * FLOOR
        if c > least:
            cuts.append(i + 1)
            first = i + 1
    return [
        {"start_s": a / fps, "end_s": b / fps, "first_frame": a, "n_frames": b - a}
        for a, b in zip(cuts, [*cuts[1:], len(pictures)])
    ]


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as UTF-8, padded with zeros to a positive multiple of 64, in an AVI file.

    A null text is read as empty; equal texts give equal files; repeated rows stay repeated.
    """
    kind = docs.select(F.col(DOC_ID)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [utf8(t) for t in batch.column(1).to_pylist()]
            padded = [d + bytes(max(ROW, -(-len(d) // ROW) * ROW) - len(d)) for d in data]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([*map(len, data)], pa.int64()), pa.array(encode_batch(padded), pa.binary())],
                names=[DOC_ID, "n_bytes", "media"],
            )

    return texts(docs).mapInArrow(run, f"{DOC_ID} {kind}, n_bytes long, media binary")


def read(files: DataFrame) -> DataFrame:
    """``files`` with columns payload and clips read from its column media (binary).

    payload: the samples of all frames, cut to the stored number of bytes if the
    file has one. clips: the shots, with their times. A null or broken file gives
    an empty payload and no clips; frames that are no baseline JPEG are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("first_frame", pa.int32()), ("n_frames", pa.int32())]))
        for batch in batches:
            names = batch.schema.names
            videos = [parse_avi(m or b"") for m in batch.column(names.index("media")).to_pylist()]
            pictures = iter(decode_frames([f for v in videos for f in v.frames]))
            payloads, clips = [], []
            for v in videos:
                own = [p for p in (next(pictures) for _ in v.frames) if p is not None]
                payloads.append(b"".join(p.tobytes() for p in own)[: v.payload_bytes])
                ends = np.cumsum([0, *(p.size for p in own)])
                # What only pads the last frame is no picture.
                seen = [p.ravel()[: max(1, len(payloads[-1]) - int(at))] for p, at in zip(own, ends)]
                clips.append(shots(seen, v.fps))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(payloads, pa.binary()), pa.array(clips, clip)], names=[*names, "payload", "clips"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{fields}, payload binary, clips {CLIP}")


def clip_rows(files: DataFrame) -> DataFrame:
    """One row for each clip of each file: ``files``' columns but media, with start_s, end_s, first_frame and n_frames."""
    return read(files).drop("media", "payload").withColumn("clip", F.explode("clips")).select("*", "clip.*").drop("clip", "clips")
