"""Arrays of whole numbers as bytes, no wider than their largest value.

The bytes of one significance stand together and each such plane is compressed alone: upper planes are nearly always
zero, counts are mostly small, and both then take a fraction of a byte. Ascending keys are sent as their first value
and the steps between them.
"""

from __future__ import annotations

import numpy as np
import zstandard

LITTLE = np.dtype("<u8")


def pack(values: np.ndarray) -> bytes:
    """Unsigned values of 64 bits as their number, then the length and the bytes of plane after plane."""
    values = np.ascontiguousarray(values, dtype=LITTLE)
    width = -(-int(values.max()).bit_length() // 8) if len(values) else 0
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    squeeze = zstandard.ZstdCompressor(level=1)
    squeezed = [squeeze.compress(plane) for plane in planes]
    return b"".join([len(values).to_bytes(8, "little"), *(x for s in squeezed for x in (len(s).to_bytes(8, "little"), s))])


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    values = np.zeros((n, 8), dtype=np.uint8)
    stretch = zstandard.ZstdDecompressor()
    plane, at = 0, 8
    while at < len(data):
        end = at + 8 + int.from_bytes(data[at : at + 8], "little")
        values[:, plane] = np.frombuffer(stretch.decompress(data[at + 8 : end]), dtype=np.uint8)
        plane, at = plane + 1, end
    return values.reshape(-1).view(LITTLE)


def pack_ascending(keys: np.ndarray) -> bytes:
    return b"" if not len(keys) else int(keys[0]).to_bytes(8, "little") + pack(np.diff(keys))


def unpack_ascending(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=LITTLE)
    steps = unpack(data[8:])
    keys = np.empty(len(steps) + 1, dtype=LITTLE)
    keys[0] = int.from_bytes(data[:8], "little")
    keys[1:] = steps
    return np.cumsum(keys, out=keys)
