"""Arrays packed into binary values, so that a shuffled row holds thousands of entries."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one compressed value; bytes of equal weight lie together."""
    n = len(arrays[0])
    kinds = "".join(a.dtype.str[1:] for a in arrays).encode()
    body = b"".join(_planes(np.ascontiguousarray(a), n) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<IB", n, len(kinds)) + kinds + body)


def unpack(value: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    n, size = struct.unpack_from("<IB", raw)
    kinds, at, out = raw[5 : 5 + size].decode(), 5 + size, []
    for kind in [kinds[i : i + 2] for i in range(0, size, 2)]:
        width = int(kind[1])
        plane = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(plane.T).reshape(-1).view(f"<{kind}"))
        at += n * width
    return out


def joined(values: list[bytes], like: list[str]) -> list[np.ndarray]:
    """Several packed values end to end; ``like`` has the dtypes for none."""
    if not values:
        return [np.zeros(0, d) for d in like]
    return [np.concatenate(x) for x in zip(*map(unpack, values))]


def _planes(a: np.ndarray, n: int) -> bytes:
    return a.view(np.uint8).reshape(n, a.dtype.itemsize).T.tobytes() if n else b""
