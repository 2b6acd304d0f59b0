"""AVI motion-JPEG as a lossless container of 8-bit samples, and shot detection on its frames.

A payload becomes grey frames, one 8x8 block of baseline JPEG for each sample: the block is flat, so its DC
coefficient alone carries the sample, and with a quantiser of 8 a decoder gives every pixel that very value.
The Huffman tables are chosen so that each block takes ten bits (a code of 9 - c bits for differences of c
bits, then the difference, then one bit that ends the block); equal lengths let whole frames be coded and
decoded as arrays. Any baseline decoder reads the frames. Others' grey baseline frames with arbitrary
tables are read by :func:`decode_frame` as well, block by block.

The RIFF layer is the plain one: ``hdrl`` with ``avih`` and one video stream, ``movi`` with ``00dc`` chunks,
and an ``idx1`` index through which the reader finds the frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.words import documents_only

# The order in which JPEG stores the 64 coefficients of a block, as (row, column) diagonals.
ZIGZAG = [r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))]


@dataclass(frozen=True)
class Avi:
    #: Samples in a row of a frame; a payload is a whole number of rows.
    columns: int = 64
    rows: int = 8
    fps: int = 25
    #: Shot detection: histogram bins, frames of the running window, and how far above it a cut stands.
    bins: int = 16
    history: int = 8
    factor: float = 2.5
    least_difference: float = 0.15


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head(rows: int, columns: int) -> bytes:
    quantiser = _segment(0xDB, b"\x00" + bytes([8] * 64))
    frame = _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 1) + bytes([1, 0x11, 0]))
    # Categories 8, 7, ..., 0 have codes of 1, 2, ..., 9 bits; the end of a block is a code of one bit.
    dc = _segment(0xC4, b"\x00" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    ac = _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00")
    scan = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    return b"\xff\xd8" + quantiser + frame + dc + ac + scan


def _difference_codes() -> np.ndarray:
    """The ten bits of each difference -255..255, at its place plus 255."""
    out = np.zeros(511, np.uint64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        code = (1 << (9 - c)) - 2 if c < 9 else 0  # 8-c ones and a zero
        extra = d if d >= 0 else d + (1 << c) - 1
        out[d + 255] = ((code << c) | extra) << 1
    return out


CODES = _difference_codes()
#: Difference of each ten-bit value; unused values stay far out of range.
DIFFERENCES = np.full(1024, 9999, np.int64)
DIFFERENCES[CODES.astype(np.int64)] = np.arange(-255, 256)
FAST_TABLES = _jpeg_head(1, 1)[:2] + _jpeg_head(1, 1)[2 + 69 + 13 :]


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """A JPEG for each frame of ``samples`` (frames, rows, columns)."""
    frames, rows, columns = samples.shape
    flat = samples.reshape(frames, -1).astype(np.int64) - 128
    codes = CODES[np.diff(flat, axis=1, prepend=0) + 255]
    n = codes.shape[1]
    if n % 4:
        codes = np.concatenate([codes, np.zeros((frames, 4 - n % 4), np.uint64)], axis=1)
    four = codes.reshape(frames, -1, 4)
    words = (four[:, :, 0] << np.uint64(54)) | (four[:, :, 1] << np.uint64(44)) | (four[:, :, 2] << np.uint64(34)) | (four[:, :, 3] << np.uint64(24))
    raw = np.ascontiguousarray(words.astype(">u8").view(np.uint8).reshape(frames, -1, 8)[:, :, :5]).reshape(frames, -1)
    bits = n * 10
    size = -(-bits // 8)
    raw = raw[:, :size].copy()
    if bits % 8:
        raw[:, -1] |= (1 << (8 - bits % 8)) - 1  # padded with ones
    head = _jpeg_head(rows, columns)
    return [head + r.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for r in raw]


def _segments(data: bytes) -> tuple[dict, bytes]:
    """Tables and geometry of a JPEG, and its entropy-coded bytes without stuffing."""
    at, out = 2, {"dc": {}, "ac": {}, "dqt": {}}
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC0:
            out["rows"], out["columns"], out["components"] = struct.unpack_from(">HHB", body, 1)
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xC4:
            while body:
                counts, n = body[1:17], sum(body[1:17])
                code, table, symbols = 0, {}, iter(body[17 : 17 + n])
                for length, many in enumerate(counts, 1):
                    for _ in range(many):
                        table[(length, code)] = next(symbols)
                        code += 1
                    code <<= 1
                out["ac" if body[0] >> 4 else "dc"][body[0] & 15] = table
                body = body[17 + n :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["dqt"][body[0] & 15] = struct.unpack_from(">64H", body, 1) if wide else tuple(body[1:65])
                body = body[129 if wide else 65 :]
        elif marker == 0xDA:
            out["scan"] = body
            return out, data[at : data.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")


def decode_samples(data: bytes) -> np.ndarray | None:
    """Samples (rows, columns) of a frame with this module's own tables, one for each block; else None."""
    head = data[: len(_jpeg_head(1, 1))]
    if head[:2] + head[2 + 69 + 13 :] != FAST_TABLES or head[7:71] != bytes([8] * 64):
        return None
    rows, columns = struct.unpack_from(">HH", head, 71 + 5)
    n = rows // 8 * (columns // 8)
    body = data[len(head) : -2].replace(b"\xff\x00", b"\xff")
    raw = np.frombuffer(body + bytes(-len(body) % 5), np.uint8).reshape(-1, 5).astype(np.int64)
    word = (raw[:, 0] << 32) | (raw[:, 1] << 24) | (raw[:, 2] << 16) | (raw[:, 3] << 8) | raw[:, 4]
    codes = np.stack([word >> 30, word >> 20, word >> 10, word], axis=1).reshape(-1)[:n] & 1023
    return (np.cumsum(DIFFERENCES[codes]) + 128).astype(np.uint8).reshape(rows // 8, columns // 8)


def decode_frame(data: bytes) -> np.ndarray:
    """Pixels of a grey baseline JPEG with any tables."""
    info, body = _segments(data)
    if info["components"] != 1:
        raise ValueError("only grey frames are decoded")
    bits = np.unpackbits(np.frombuffer(body, np.uint8)).tolist()
    dc, ac, quantiser = info["dc"][info["scan"][2] >> 4], info["ac"][info["scan"][2] & 15], info["dqt"][min(info["dqt"])]
    at, before = 0, 0

    def symbol(table: dict) -> int:
        nonlocal at
        code = 0
        for length in range(1, 17):
            code = code << 1 | bits[at]
            at += 1
            if (length, code) in table:
                return table[length, code]
        raise ValueError("a code that the tables don't have")

    def amount(size: int) -> int:
        nonlocal at
        value = 0
        for b in bits[at : at + size]:
            value = value << 1 | b
        at += size
        return value if not size or value >> (size - 1) else value - (1 << size) + 1

    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    down, across = -(-info["rows"] // 8), -(-info["columns"] // 8)
    out = np.zeros((down * 8, across * 8))
    for block in range(down * across):
        flat = np.zeros(64)
        before += amount(symbol(dc))
        flat[0] = before * quantiser[0]
        place = 1
        while place < 64:
            run, size = divmod(symbol(ac), 16)
            if not size:
                if run != 15:
                    break
                place += 16
                continue
            place += run
            flat[ZIGZAG[place]] = amount(size) * quantiser[place]
            place += 1
        y, x = divmod(block, across)
        out[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8] = basis @ flat.reshape(8, 8) @ basis.T
    return np.clip(np.rint(out + 128), 0, 255).astype(np.uint8)[: info["rows"], : info["columns"]]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def write_avi(payload: bytes, settings: Avi) -> bytes:
    """An AVI file that holds ``payload``, a positive multiple of ``columns`` bytes, sample for sample."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, settings.columns)
    rows = min(settings.rows, len(samples))
    frames = -(-len(samples) // rows)
    padded = np.zeros((frames * rows, settings.columns), np.uint8)
    padded[: len(samples)] = samples
    images = encode_frames(padded.reshape(frames, rows, settings.columns))
    width, height = settings.columns * 8, rows * 8
    largest = max(map(len, images))
    avih = struct.pack("<14I", 1_000_000 // settings.fps, largest * settings.fps, 0, 0x10, frames, 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sI2H8I4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, settings.fps, 0, frames, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    header = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    info = b"INFO" + _chunk(b"ICMT", b"samples=%d" % len(payload))
    movi, index = [b"movi"], []
    at = 4
    for image in images:
        index.append(struct.pack("<4s3I", b"00dc", 0x10, at, len(image)))
        movi.append(_chunk(b"00dc", image))
        at += len(movi[-1])
    body = b"AVI " + _chunk(b"LIST", header) + _chunk(b"LIST", info) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def parse_avi(data: bytes) -> dict:
    """fps, samples (None if the file doesn't say) and the frames' bytes, found through ``idx1``, or by walking ``movi`` without one."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out: dict = {"fps": 25.0, "samples": None}
    index, movi = None, None

    def walk(at: int, end: int) -> None:
        nonlocal index, movi
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if name == b"LIST":
                if data[body : body + 4] == b"movi":
                    movi = (body, body + size)
                else:
                    walk(body + 4, body + size)
            elif name == b"strh" and data[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, body + 20)
                out["fps"] = rate / max(1, scale)
            elif name == b"ICMT" and data[body : body + 8] == b"samples=":
                out["samples"] = int(data[body + 8 : body + size])
            elif name == b"idx1":
                index = [struct.unpack_from("<4s3I", data, k) for k in range(body, body + size - 15, 16)]
            at = body + size + size % 2

    walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
    if movi is None:
        raise ValueError("no movi list")
    if index is None:
        index, at = [], movi[0] + 4
        while at + 8 <= movi[1]:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            index.append((name, 0x10, at - movi[0], size))
            at += 8 + size + size % 2
    # Offsets count from the list's type or, in some files, from the start of the file.
    base = movi[0] if index and data[movi[0] + index[0][2] : movi[0] + index[0][2] + 4] == index[0][0] else 0
    out["frames"] = [data[base + at + 8 : base + at + 8 + size] for name, _, at, size in index if name[2:] in (b"dc", b"db")]
    return out


def shots(frames: np.ndarray, settings: Avi) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot. frames: (frames, values).

    A cut stands where the histogram difference exceeds ``least_difference`` and the mean plus ``factor``
    standard deviations of the differences since the last cut, at most ``history`` of them.
    """
    n = len(frames)
    bins = (frames.reshape(n, -1).astype(np.int64) * settings.bins) >> 8
    counts = np.bincount((bins + np.arange(n)[:, None] * settings.bins).reshape(-1), minlength=n * settings.bins).reshape(n, settings.bins)
    differences = (np.abs(np.diff(counts, axis=0)).sum(1) / (2 * bins.shape[1])).tolist()
    starts, recent = [0], []
    for k, d in enumerate(differences, 1):
        mean = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if recent and d > settings.least_difference and d > mean + settings.factor * spread:
            starts.append(k)
            recent = []
        else:
            recent = [*recent, d][-settings.history :]
    return list(zip(starts, [*starts[1:], n], strict=True))


def read_avi(data: bytes, settings: Avi) -> tuple[np.ndarray, float, list[tuple[int, int]]]:
    """Samples in order, frames a second, and shots of an AVI file."""
    parsed = parse_avi(data)
    frames = []
    for image in parsed["frames"]:
        samples = decode_samples(image)
        frames.append(decode_frame(image) if samples is None else samples)
    stack = np.stack(frames)
    flat = stack.reshape(-1)
    return flat[: parsed["samples"]], parsed["fps"], shots(stack, settings)


def payload_of(text: bytes | None) -> bytes:
    body = text or b""
    return body + bytes(-len(body) % 64 if body else 64)


def media_column(docs: DataFrame, settings: Avi | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes (unpadded) and ``media``, an AVI file, of every row. Null and empty texts hold 64 zero bytes."""
    import pyarrow as pa

    settings = settings or Avi()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                bodies = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(b or b"") for b in bodies], pa.int64()), pa.array([write_avi(payload_of(b), settings) for b in bodies], pa.large_binary())], names=["key", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, media binary")
    return made.withColumnRenamed("key", key)


def clips(media: DataFrame, settings: Avi | None = None, key: str = "doc_id") -> DataFrame:
    """``key``, clip, start_s and end_s of every shot of every file."""
    import pyarrow as pa

    settings = settings or Avi()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, starts, ends = [], [], [], []
            for k, (name, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if data is None:
                    continue
                _, fps, found = read_avi(data, settings)
                for number, (a, b) in enumerate(found):
                    keys.append(name)
                    numbers.append(number)
                    starts.append(a / fps)
                    ends.append(b / fps)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(numbers, pa.int64()), pa.array(starts, pa.float64()), pa.array(ends, pa.float64())], names=["key", "clip", "start_s", "end_s"])

    kind = media.schema[key].dataType.simpleString()
    return media.select(F.col(key).alias("key"), "media").mapInArrow(run, f"key {kind}, clip long, start_s double, end_s double").withColumnRenamed("key", key)


def media_digest(docs: DataFrame, settings: Avi | None = None) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every row, from the files read back.

    feature names the frames, the shots and the first twelve shots' start seconds.
    """
    import pyarrow as pa

    settings = settings or Avi()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                samples, fps, found = read_avi(data, settings)
                payload = samples.tobytes()
                feature = f"frames={found[-1][1]};shots={len(found)};cuts=" + ",".join(f"{a / fps:.2f}" for a, _ in found[:12])
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", *DIGEST])

    kind = docs.schema["doc_id"].dataType.simpleString()
    stored = media_column(documents_only(docs, "doc_id", "text"), settings)
    return stored.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


DIGEST = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
