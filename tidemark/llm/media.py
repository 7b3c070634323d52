"""Media columns: AVI files with motion-JPEG frames, one per row.

``avi_store`` turns a text into an AVI whose frames are baseline grey JPEGs. The unit of storage is
the quantised DCT coefficient: 64 payload bytes fill the 64 coefficients of one 8x8 block. All
coefficients are of magnitude class 8 (128..255 in size), whose appended bits are exactly one byte,
so the JPEG entropy coder carries the payload losslessly. A restart marker after each block keeps
the DC prediction at zero. ``avi_read`` finds the frames through the RIFF index, decodes them to
coefficients and pixels, and cuts shots where the luma histogram changes more than it lately did.

Any baseline JPEG is decoded by its own tables, one code at a time. Frames whose whole header is that
of this layout are decoded together, as their codes all have one length. A file that cannot be read
gets a status instead of an error.

The work is one Arrow-batched function per step; rows never move between partitions. A batch is
worked in groups of ``GROUP`` payload bytes, so memory follows neither the batch nor, but for the text
and its file, the longest text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Picture size, frames a second, payload bytes in a frame.
WIDTH, HEIGHT, RATE = 64, 16, 10
FRAME = WIDTH * HEIGHT
BLOCKS = FRAME // 64
#: Payload bytes that are worked at once.
GROUP = 8 << 20
#: Shots: histogram bins, frames of recent change, standard deviations, least change.
BINS, RECENT, SIGMAS, LEAST = 32, 12, 3.0, 0.25

_CODED = 72  # bytes of a coded block: 64 times one bit of Huffman code and 8 bits of magnitude


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: One code of one bit, "0", for class 8 (DC) and for run 0 with class 8 (AC).
_HUFFMAN = bytes([1] + [0] * 15 + [8])
_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0] + [1] * 64))
    + _segment(0xC0, struct.pack(">BHHB3B", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\x00" + _HUFFMAN)
    + _segment(0xC4, b"\x10" + _HUFFMAN)
    + _segment(0xDD, struct.pack(">H", 1))
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)
_LENGTH = len(_HEAD) + BLOCKS * _CODED + (BLOCKS - 1) * 2 + 2
_STRIDE = 8 + _LENGTH + _LENGTH % 2


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of 64, and the length without them."""
    raw = (text or "").encode("utf-8")
    return raw + bytes((-len(raw)) % 64 if raw else 64), len(raw)


def _sliced(work, rows: np.ndarray) -> np.ndarray:
    """``work`` on GROUP bytes of frames at a time."""
    step = GROUP // FRAME
    return np.concatenate([work(rows[at : at + step]) for at in range(0, max(1, len(rows)), step)])


def encode_frames(blocks: np.ndarray) -> np.ndarray:
    """(frames, BLOCKS, 64) payload bytes as (frames, stride) AVI chunks of one JPEG each."""
    return _sliced(_encode, blocks)


def _encode(blocks: np.ndarray) -> np.ndarray:
    n = len(blocks)
    if (blocks == 255).any():
        raise ValueError("byte 255 is not UTF-8 and would need stuffing")
    bits = np.zeros((n, BLOCKS, 64, 9), np.uint8)
    bits[..., 1:] = np.unpackbits(blocks.reshape(n, BLOCKS, 64, 1), axis=3)
    coded = np.zeros((n, BLOCKS, _CODED + 2), np.uint8)
    coded[:, :, :_CODED] = np.packbits(bits.reshape(n, BLOCKS, 576), axis=2)
    coded[:, :, _CODED] = 0xFF
    coded[:, :, _CODED + 1] = 0xD0 + np.arange(BLOCKS) % 8
    coded[:, -1, _CODED + 1] = 0xD9
    out = np.zeros((n, _STRIDE), np.uint8)
    out[:, : 8 + len(_HEAD)] = np.frombuffer(b"00dc" + struct.pack("<I", _LENGTH) + _HEAD, np.uint8)
    out[:, 8 + len(_HEAD) : 8 + _LENGTH] = coded.reshape(n, -1)
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi_file(frames: np.ndarray, size: int) -> bytes:
    """The AVI of encoded frames; ``size`` is the payload length, kept as a comment."""
    n = len(frames)
    main = struct.pack("<14I", 1_000_000 // RATE, 0, 0, 0x10, n, 0, 1, _LENGTH, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, n, _LENGTH, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    picture = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    note = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", str(size).encode()))
    index = np.empty((n, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, _LENGTH
    index[:, 2] = 4 + np.arange(n, dtype=np.uint32) * _STRIDE
    body = b"AVI " + head + note + _chunk(b"LIST", b"movi" + frames.tobytes()) + _chunk(b"idx1", index.tobytes())
    return _chunk(b"RIFF", body)


def _groups(sizes: list[int]):
    """Slices of rows of about GROUP bytes, at least one row each."""
    at = total = 0
    for k, size in enumerate(sizes):
        if total and total + size > GROUP:
            yield slice(at, k)
            at, total = k, 0
        total += size
    if len(sizes) > at:
        yield slice(at, len(sizes))


def _store(texts: pd.Series) -> pd.Series:
    out: list[bytes] = []
    payloads = [payload_of(t)[0] for t in texts]
    for part in _groups([len(p) for p in payloads]):
        some = payloads[part]
        counts = [-(-len(p) // FRAME) for p in some]
        data = b"".join(p + bytes(n * FRAME - len(p)) for p, n in zip(some, counts, strict=True))
        frames, at = encode_frames(np.frombuffer(data, np.uint8).reshape(-1, BLOCKS, 64)), 0
        for p, n in zip(some, counts, strict=True):
            out.append(avi_file(frames[at : at + n], len(p)))
            at += n
    return pd.Series(out, dtype=object)


def avi_store(text: Column) -> Column:
    """The AVI (binary) that carries a text; null counts as empty. A file is limited to 4 GiB by the format."""
    return F.pandas_udf(_store, "binary")(text)


class Unreadable(ValueError):
    """Media that cannot be decoded; its text is the status."""


def chunks_of(data: bytes, at: int = 12) -> dict[bytes, tuple[int, int]]:
    """Offset and length of the top chunks of an AVI; a LIST goes by its type. A length never goes past the end."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise Unreadable("not an AVI")
    found = {}
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        name = data[at + 8 : at + 12] if data[at : at + 4] == b"LIST" else data[at : at + 4]
        found.setdefault(name, (at + 8, min(size, len(data) - at - 8)))
        at += 8 + size + size % 2
    return found


def frame_places(data: bytes) -> np.ndarray:
    """(offset, length) of each frame, through the index, whose offsets count from the movi list or from the file's start."""
    parts = chunks_of(data)
    if b"movi" not in parts:
        raise Unreadable("no frames")
    if b"idx1" not in parts:
        raise Unreadable("no index")
    at, size = parts[b"idx1"]
    index = np.frombuffer(data, "<u4", size // 16 * 4, at).reshape(-1, 4)
    kind = index[:, 0] >> 16
    index = index[(kind == int.from_bytes(b"dc", "little")) | (kind == int.from_bytes(b"db", "little"))]
    if not len(index):
        raise Unreadable("no frames")
    start = index[:, 2].astype(np.int64)
    first = int(start[0])
    base = 0 if data[first : first + 4] == index[0, 0].tobytes() else parts[b"movi"][0]
    places = np.stack([start + base + 8, index[:, 3].astype(np.int64)], axis=1)
    if (places[:, 0] + places[:, 1] > len(data)).any():
        raise Unreadable("truncated")
    return places


def payload_size(data: bytes) -> int | None:
    """The payload length that the writer left as a comment."""
    parts = chunks_of(data)
    if b"INFO" not in parts:
        return None
    at, size = parts[b"INFO"]
    note = data[at + 4 : at + size]
    if note[:4] != b"ICMT" or len(note) < 8:
        return None
    text = note[8 : 8 + struct.unpack_from("<I", note, 4)[0]]
    return int(text) if text.isdigit() else None


def own_frames(data: bytes, places: np.ndarray) -> np.ndarray | None:
    """The frames as (frames, length) if each has this writer's length and header, byte by byte."""
    if (places[:, 1] != _LENGTH).any():
        return None
    flat = np.frombuffer(data, np.uint8)
    step = _STRIDE
    if (np.diff(places[:, 0]) == step).all():
        first = int(places[0, 0])
        frames = np.lib.stride_tricks.as_strided(flat[first:], (len(places), _LENGTH), (step, 1), writeable=False)
    else:
        frames = flat[places[:, 0][:, None] + np.arange(_LENGTH)]
    return frames if (frames[:, : len(_HEAD)] == np.frombuffer(_HEAD, np.uint8)).all() else None


def decode_frames(frames: np.ndarray) -> np.ndarray:
    """Payload bytes (frames, BLOCKS, 64) of this writer's frames."""
    return _sliced(_decode, frames)


def _decode(frames: np.ndarray) -> np.ndarray:
    at = len(_HEAD)
    coded = np.empty((len(frames), BLOCKS, _CODED + 2), np.uint8)
    coded.reshape(len(frames), -1)[:] = frames[:, at : at + BLOCKS * (_CODED + 2)]
    bits = np.unpackbits(coded[:, :, :_CODED], axis=2).reshape(-1, BLOCKS, 64, 9)
    if bits[..., 0].any() or (coded[:, :, _CODED] != 0xFF).any():
        raise Unreadable("a code that the tables do not have")
    return np.packbits(bits[..., 1:], axis=3)[..., 0]


class Jpeg:
    """A baseline JPEG: its tables, picture size and components, and where the coded data begin."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise Unreadable("not a JPEG")
        self.data, self.quant, self.codes, self.every = data, {}, {}, 0
        self.parts: list[tuple[int, int, int, int]] = []
        at = 2
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 4 > len(data) or data[at] != 0xFF:
                raise Unreadable("not a JPEG segment")
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if len(body) != size - 2:
                raise Unreadable("truncated")
            if marker == 0xDB:
                self._quant(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDD:
                self.every = struct.unpack(">H", body[:2])[0]
            elif marker == 0xC0:
                bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8 or not n or len(body) < 6 + 3 * n or not self.height or not self.width:
                    raise Unreadable("unsupported frame")
                self.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise Unreadable("not baseline")
            elif marker == 0xDA:
                n = body[0]
                self.tables = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)}
                self.start = at
                break
        if not self.parts or any(p[0] not in self.tables or p[3] not in self.quant or not p[1] or not p[2] for p in self.parts):
            raise Unreadable("unsupported scan")

    def _quant(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, to = body[at] >> 4, body[at] & 15
            size = 128 if wide else 64
            if at + 1 + size > len(body):
                raise Unreadable("truncated")
            self.quant[to] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1).astype(np.int64)
            at += 1 + size

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at + 17 <= len(body):
            counts, code, place, table = body[at + 1 : at + 17], 0, at + 17, {}
            for length, n in enumerate(counts, 1):
                for symbol in body[place : place + n]:
                    table[length, code] = symbol
                    code += 1
                place += n
                code <<= 1
            self.codes[body[at] >> 4, body[at] & 15] = table
            at = place

    def luma(self) -> tuple[np.ndarray, np.ndarray]:
        """Quantised coefficients (blocks, 64; zigzag) of the first component, and its pixels (height, width)."""
        data, at, held, n = self.data, self.start, 0, 0
        end = len(data)

        def more() -> None:
            nonlocal at, held, n
            if at >= end:
                raise Unreadable("truncated")
            byte = data[at]
            if byte == 0xFF:
                if data[at + 1 : at + 2] != b"\0":
                    raise Unreadable("truncated")
                at += 1
            at += 1
            held, n = held << 8 | byte, n + 8

        def take(count: int) -> int:
            nonlocal held, n
            while n < count:
                more()
            n -= count
            out = held >> n
            held &= (1 << n) - 1
            return out

        def symbol(table: dict[tuple[int, int], int]) -> int:
            code = 0
            for length in range(1, 17):
                code = code << 1 | take(1)
                if (length, code) in table:
                    return table[length, code]
            raise Unreadable("a code that the tables do not have")

        def signed(size: int) -> int:
            value = take(size) if size else 0
            return value if not size or value >> size - 1 else value - (1 << size) + 1

        h_most, v_most = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:  # one component is not interleaved
            h_most = v_most = 1
            units = [(self.parts[0][0], 1, 1, self.parts[0][3])]
        else:
            units = self.parts
        across, down = -(-self.width // (8 * h_most)), -(-self.height // (8 * v_most))
        h, v = units[0][1], units[0][2]
        coded = np.zeros((down * v, across * h, 64), np.int64)
        last = dict.fromkeys((u[0] for u in units), 0)
        for unit in range(across * down):
            if self.every and unit and unit % self.every == 0:
                held = n = 0
                if data[at : at + 1] != b"\xff" or not 0xD0 <= data[at + 1] <= 0xD7:
                    raise Unreadable("no restart marker")
                at += 2
                last = dict.fromkeys(last, 0)
            for k, (name, hs, vs, _) in enumerate(units):
                dc, ac = (self.codes.get((kind, self.tables[name][kind]), {}) for kind in (0, 1))
                for y in range(vs):
                    for x in range(hs):
                        last[name] += signed(symbol(dc))
                        block = {0: last[name]}
                        place = 1
                        while place < 64:
                            run = symbol(ac)
                            if run == 0:
                                break
                            place += run >> 4
                            if run & 15:
                                block[place] = signed(run & 15)
                            place += 1
                        if place > 64 or max(block) > 63:
                            raise Unreadable("a run past the block")
                        if k == 0:
                            row, col = unit // across * v + y, unit % across * h + x
                            coded[row, col, list(block)] = list(block.values())
        pixels = _pixels((coded * self.quant[units[0][3]]).reshape(-1, 64).astype(np.float64), _EXACT)
        pixels = pixels.reshape(down * v, across * h, 8, 8).swapaxes(1, 2).reshape(down * v * 8, across * h * 8)
        height, width = -(-self.height * v // v_most), -(-self.width * h // h_most)
        return coded.reshape(-1, 64), pixels[:height, :width]


def _basis(units: float | None) -> np.ndarray:
    """64x64 inverse DCT from zigzag coefficients to pixels.

    In whole ``units`` float32 products and sums of this writer's coefficients stay exact in any order.
    """
    u = np.arange(8)
    c = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1.0) / 2
    full = np.einsum("xu,yv->uvxy", c, c).reshape(64, 64)
    zigzag = sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8) if (k // 8 + k % 8) % 2 else (k % 8)))
    return np.rint(full[zigzag] * units).astype(np.float32) if units else full[zigzag]


UNITS = 1024
_BASIS, _EXACT = _basis(UNITS), _basis(None)


def _pixels(coefficients: np.ndarray, basis: np.ndarray, units: float = 1.0) -> np.ndarray:
    """Levels (blocks, 64) from 0 to 255."""
    return np.clip(np.floor(coefficients @ basis / units + 0.5) + 128, 0, 255).astype(np.int64)


def luma_histograms(payload: np.ndarray) -> np.ndarray:
    """Histogram of pixels (frames, BINS) of this writer's frames."""
    out = np.zeros((len(payload), BINS), np.int64)
    for at in range(0, len(payload), 2048):
        part = payload[at : at + 2048]
        value = part.astype(np.float32)
        value[part < 128] -= 255
        level = (_pixels(value.reshape(-1, 64), _BASIS, UNITS) * BINS) >> 8
        level = level.reshape(len(part), -1) + np.arange(len(part))[:, None] * BINS
        out[at : at + len(part)] = np.bincount(level.ravel(), minlength=len(part) * BINS).reshape(-1, BINS)
    return out


def shot_starts(changes: list[float]) -> list[int]:
    """Frames at which a shot begins; ``changes[i]`` is the change from frame i to frame i + 1.

    A change is a cut if it exceeds LEAST and the mean of the recent changes by SIGMAS deviations.
    """
    starts = [0]
    for i, change in enumerate(changes):
        past = changes[max(0, i - RECENT) : i]
        mean = sum(past) / len(past) if past else 0.0
        spread = (sum((x - mean) ** 2 for x in past) / len(past)) ** 0.5 if past else 0.0
        if change > max(LEAST, mean + SIGMAS * spread):
            starts.append(i + 1)
    return starts


_READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<struct<start_ms:long,end_ms:long,frames:int>>, feature string, status string"
_NAMES = [c.split(" ")[0] for c in _READ.replace("array<struct<start_ms:long,end_ms:long,frames:int>>", "array").split(", ")]


def _rate(data: bytes) -> int:
    """Milliseconds of a frame, from the main header; a header without them counts RATE frames a second."""
    at, size = chunks_of(data).get(b"hdrl", (0, 0))
    micros = struct.unpack_from("<I", data, at + 12)[0] if size >= 16 and data[at + 4 : at + 8] == b"avih" else 0
    return micros // 1000 or 1000 // RATE


def _described(file: bytes, hist: np.ndarray, raw: bytes | None) -> tuple:
    """A file's row from its histograms (frames, BINS) and its payload, if it carries one."""
    n, pixels = len(hist), hist.sum(axis=1)
    change = np.abs(np.diff(hist / pixels[:, None], axis=0)).sum(axis=1) / 2.0
    starts, step = shot_starts(change.tolist()), _rate(file)
    clips = [{"start_ms": a * step, "end_ms": b * step, "frames": b - a} for a, b in zip(starts, [*starts[1:], n], strict=True)]
    mean = int(hist.sum(axis=0) @ np.arange(BINS)) // int(pixels.sum())
    feature = f"frames={n};shots={len(clips)};longest={max(c['frames'] for c in clips)};luma={mean}"
    carried = (None, None, None) if raw is None else (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    return (*carried, len(file), hashlib.sha256(file).hexdigest(), clips, feature, "ok")


def _read_one(file: bytes | None) -> tuple:
    """The row of one file: by its writer's layout, else frame by frame, else a status."""
    if file is None:
        return (None,) * (len(_NAMES) - 1) + ("null",)
    try:
        places = frame_places(file)
        frames, size = own_frames(file, places), payload_size(file)
        if frames is not None:
            payload = decode_frames(frames)
            return _described(file, luma_histograms(payload), payload.tobytes()[:size] if size is not None else None)
        levels = [Jpeg(file[a : a + n]).luma()[1] for a, n in places.tolist()]
        return _described(file, np.stack([np.bincount((x.ravel() * BINS) >> 8, minlength=BINS) for x in levels]), None)
    except Unreadable as e:
        why = str(e)
    except (IndexError, struct.error):
        why = "truncated"
    return (None, None, None, len(file), hashlib.sha256(file).hexdigest(), [], None, why)


def _read(files: pd.Series) -> pd.DataFrame:
    """Files of this writer's layout are decoded together, others one by one."""
    rows: list[tuple | None] = [None] * len(files)
    for part in _groups([len(f) if f is not None else 0 for f in files]):
        own: list[tuple[int, bytes, np.ndarray, int]] = []
        for k in range(part.start, part.stop):
            file = bytes(files.iloc[k]) if files.iloc[k] is not None else None
            try:
                frames, size = own_frames(file, frame_places(file)), payload_size(file)
            except (TypeError, Unreadable, IndexError, struct.error):
                frames = size = None
            if frames is None or size is None:
                rows[k] = _read_one(file)
            else:
                own.append((k, file, frames, size))
        if not own:
            continue
        try:
            payload = decode_frames(np.concatenate([f for _, _, f, _ in own]) if len(own) > 1 else own[0][2])
        except Unreadable:  # one of them is damaged
            for k, file, _, _ in own:
                rows[k] = _read_one(file)
            continue
        hist, at = luma_histograms(payload), 0
        for k, file, frames, size in own:
            n = len(frames)
            rows[k] = _described(file, hist[at : at + n], payload[at : at + n].tobytes()[:size])
            at += n
    return pd.DataFrame(rows, columns=_NAMES)


def avi_read(media: Column) -> Column:
    """``struct(payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, clips, feature, status)`` of AVIs.

    status is ``ok``, ``null`` or why a file cannot be read (empty, truncated, no index, not baseline
    ..); then it has no clips and no feature. Payload columns are null for files of other writers.
    """
    return F.pandas_udf(_read, _READ)(media)


def clip_rows(df: DataFrame, media: Column, id_col: str = "doc_id") -> DataFrame:
    """One row per shot: id, clip (from 0), start_ms, end_ms, frames. Null and unreadable media have none; repeated rows have theirs each."""
    return df.select(id_col, F.posexplode(avi_read(media)["clips"]).alias("clip", "c")).select(id_col, "clip", "c.*")


def media_table(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_bytes and what is read back from each row's AVI.

    Null and empty texts are 64 zero bytes. Equal texts have equal values. An empty table stays
    empty; columns of ``df`` with the new names are replaced.
    """
    n = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    out = df.withColumn("n_bytes", n).withColumn("clips", avi_read(avi_store(F.col(text_col))))
    return out.withColumns({c: F.col("clips")[c] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "status", "clips")})
