"""Arrays as compressed values, for exchanges between tasks."""

from __future__ import annotations

import numpy as np


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value. Integers are stored by byte planes, which compress well."""
    import zstandard

    parts = [np.array([len(arrays), *(len(a) for a in arrays)], "<i8").tobytes()]
    parts += [np.array([a.dtype.itemsize], np.uint8).tobytes() + np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(value: bytes) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(value), np.uint8)
    count = int(raw[:8].view("<i8")[0])
    lengths = raw[8 : 8 * (count + 1)].view("<i8")
    out, at = [], 8 * (count + 1)
    for n in map(int, lengths):
        width = int(raw[at])
        out.append(np.ascontiguousarray(raw[at + 1 : at + 1 + n * width].reshape(width, n).T).view(f"<u{width}").reshape(n))
        at += 1 + n * width
    return out
