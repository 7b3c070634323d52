"""The AVI and JPEG decoder against a direct inverse transform, on files of other writers and on damaged ones."""

import hashlib
import math
import struct

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import media

ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8) if (k // 8 + k % 8) % 2 else (k % 8)))


def direct_pixels(coefficients):
    """The inverse transform as its defining sum over frequencies."""
    square = [[0] * 8 for _ in range(8)]
    for k, value in enumerate(coefficients):
        square[ZIGZAG[k] // 8][ZIGZAG[k] % 8] = value
    c = lambda u: math.sqrt(0.5) if u == 0 else 1.0
    out = []
    for y in range(8):
        for x in range(8):
            s = sum(c(u) * c(v) * square[v][u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for u in range(8) for v in range(8)) / 4
            out.append(min(255, max(0, math.floor(s + 0.5) + 128)))
    return out


DC = list(range(12))  # codes of 4 bits
AC = [0, 0xF0, *[r << 4 | s for r in range(16) for s in range(1, 11)]]  # codes of 8 bits


def bits_of(value):
    size = abs(value).bit_length()
    return size, format(value if value >= 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def jpeg(blocks, width, height, quant=None, sampling=((1, 1),), every=0):
    """A baseline JPEG of MCUs: each is a list of (component, 64 zigzag coefficients)."""
    out, bits, last = bytearray(), "", [0] * len(sampling)

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        for k in range(0, len(bits), 8):
            byte = int(bits[k : k + 8], 2)
            out.extend([byte, 0] if byte == 255 else [byte])
        bits = ""

    for nth, unit in enumerate(blocks):
        if every and nth and nth % every == 0:
            flush()
            out.extend([0xFF, 0xD0 + (nth // every - 1) % 8])
            last = [0] * len(sampling)
        for part, block in unit:
            size, more = bits_of(block[0] - last[part])
            last[part] = block[0]
            bits += format(DC.index(size), "04b") + more
            run = 0
            end = max((k for k in range(1, 64) if block[k]), default=0)
            for k in range(1, end + 1):
                if not block[k]:
                    run += 1
                    continue
                while run > 15:
                    bits += format(AC.index(0xF0), "08b")
                    run -= 16
                size, more = bits_of(block[k])
                bits += format(AC.index(run << 4 | size), "08b") + more
                run = 0
            if end < 63:
                bits += format(AC.index(0), "08b")
    flush()
    segment = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    counts = lambda at, n: bytes([n if k == at else 0 for k in range(1, 17)])
    parts = b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling))
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, b"\0" + bytes(quant or [1] * 64)) + segment(0xC0, struct.pack(">BHHB", 8, height, width, len(sampling)) + parts)
    head += segment(0xC4, b"\0" + counts(4, 12) + bytes(DC) + b"\x10" + counts(8, len(AC)) + bytes(AC)) + (segment(0xDD, struct.pack(">H", every)) if every else b"")
    return head + segment(0xDA, bytes([len(sampling)]) + b"".join(bytes([k + 1, 0]) for k in range(len(sampling))) + b"\0\x3f\0") + bytes(out) + b"\xff\xd9"


def avi(frames, micros=40_000):
    chunk = lambda n, b: n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2)
    body, index = b"", b""
    for f in frames:
        index += b"00dc" + struct.pack("<III", 0x10, 4 + len(body), len(f))
        body += chunk(b"00dc", f)
    return chunk(b"RIFF", b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", struct.pack("<14I", micros, *[0] * 13))) + chunk(b"LIST", b"movi" + body) + chunk(b"idx1", index))


def random_blocks(rng, n):
    out = []
    for _ in range(n):
        b = np.zeros(64, int)
        b[0] = rng.integers(-300, 300)
        at = rng.choice(np.arange(1, 64), rng.integers(0, 20), replace=False)
        b[at] = rng.integers(-60, 60, len(at))
        out.append(b.tolist())
    return out


def test_foreign_frames_against_the_direct_transform():
    rng = np.random.default_rng(1)
    for quant, every in ((None, 0), ([1 + k % 5 for k in range(64)], 2)):
        blocks = random_blocks(rng, 6)
        coded, pixels = media.Jpeg(jpeg([[(0, b)] for b in blocks], 20, 13, quant, every=every)).luma()
        assert coded.tolist() == blocks and pixels.shape == (13, 20)
        for k, b in enumerate(blocks):
            want = np.array(direct_pixels([x * q for x, q in zip(b, quant or [1] * 64)])).reshape(8, 8)
            y, x = k // 3 * 8, k % 3 * 8
            assert (pixels[y : y + 8, x : x + 8] == want[: 13 - y, : 20 - x]).all()


def test_colour_frames_give_their_luma():
    rng = np.random.default_rng(2)
    luma, chroma = random_blocks(rng, 8), random_blocks(rng, 4)
    units = [[*((0, b) for b in luma[4 * k : 4 * k + 4]), (1, chroma[2 * k]), (2, chroma[2 * k + 1])] for k in range(2)]
    _, pixels = media.Jpeg(jpeg(units, 32, 16, sampling=((2, 2), (1, 1), (1, 1)))).luma()
    for k, b in enumerate(luma):
        unit, inside = divmod(k, 4)
        y, x = inside // 2 * 8, unit * 16 + inside % 2 * 8
        assert (pixels[y : y + 8, x : x + 8] == np.array(direct_pixels(b)).reshape(8, 8)).all()


def test_own_frames_are_baseline_jpegs():
    text = "Some text of this library, été 漢. " * 70
    file = media._store(media.pd.Series([text]))[0]
    places = media.frame_places(file)
    payload = media.decode_frames(media.own_frames(file, places))
    for (at, n), frame in zip(places.tolist(), payload):
        coded, pixels = media.Jpeg(file[at : at + n]).luma()
        value = frame.astype(int)
        assert (coded == np.where(value < 128, value - 255, value)).all()  # one code at a time gives the same
        assert (pixels[:8, :8].ravel() == direct_pixels(coded[0].tolist())).mean() > 0.9  # whole-number basis: a level off at most
        assert np.abs(pixels[:8, :8].ravel() - direct_pixels(coded[0].tolist())).max() <= 1
    hist = media.luma_histograms(payload)
    assert (hist.sum(axis=1) == media.FRAME).all()


def test_files_of_other_writers_and_damaged_ones(spark):
    dark, light = [[(0, [-900, *[0] * 63])]] * 2, [[(0, [900, *[0] * 63])]] * 2
    foreign = avi([jpeg(dark, 16, 8)] * 5 + [jpeg(light, 16, 8, every=1)] * 4)
    own = media._store(media.pd.Series(["a text " * 400]))[0]
    changed = bytearray(own)
    changed[media.frame_places(own)[1, 0] + len(media._HEAD) - 15] ^= 1  # another table in the second frame only
    progressive = avi([jpeg(dark, 16, 8).replace(b"\xff\xc0", b"\xff\xc2")])
    rows = [foreign, own, bytes(changed), progressive, own[:-300], own[:2000], own[:40], b"", b"RIFF0000AVI ", None, own, avi([]), b"x" * 100]
    df = spark.createDataFrame([(k, bytearray(r) if r is not None else None) for k, r in enumerate(rows)], "doc_id long, m binary")
    got = [r["r"] for r in df.select("doc_id", media.avi_read(F.col("m")).alias("r")).orderBy("doc_id").collect()]
    assert got[0]["status"] == "ok" and [(c["start_ms"], c["end_ms"], c["frames"]) for c in got[0]["clips"]] == [(0, 200, 5), (200, 360, 4)] and got[0]["payload_bytes"] is None
    assert got[1]["status"] == "ok" and got[1] == got[10] and got[1]["payload_sha256"] == hashlib.sha256(media.payload_of("a text " * 400)[0]).hexdigest()
    assert got[2]["status"] != "ok" or got[2]["payload_bytes"] is None
    assert got[3]["status"] == "not baseline" and got[9]["status"] == "null"
    assert all(r["status"] not in ("ok", None) and r["clips"] == [] and r["feature"] is None for r in [got[4], got[5], got[6], got[7], got[8], got[11], got[12]])
    clips = media.clip_rows(df, F.col("m")).collect()
    assert {r["doc_id"] for r in clips} <= {0, 1, 2, 10} and sum(r["frames"] for r in clips if r["doc_id"] == 1) == -(-2816 // media.FRAME)


def test_long_texts_and_clashing_columns(spark):
    text = "long text " * 1_200_000  # 12 MB, more than a group
    df = spark.createDataFrame([(1, text, "x", 1), (2, None, "y", 2), (2, None, "y", 2)], "doc_id long, text string, CLIPS string, n_bytes int")
    got = media.media_table(df).collect()
    raw = text.encode()
    full = raw + bytes(-len(raw) % 64)
    assert got[0]["payload_sha256"] == hashlib.sha256(full).hexdigest() and got[0]["n_bytes"] == len(raw) and got[0]["status"] == "ok"
    assert got[1]["payload_bytes"] == 64 and got[1] == got[2]
