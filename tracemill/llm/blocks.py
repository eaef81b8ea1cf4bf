"""Numbers and words of a block of texts as compact bytes."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa


def squeeze(data: bytes, level: int = 9) -> bytes:
    return pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers under 2^31, byte by byte of equal weight, compressed."""
    return squeeze(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(data: bytes, size: int) -> np.ndarray:
    """The ``size`` numbers behind ``pack``."""
    planes = np.frombuffer(pa.decompress(data, 4 * size, codec="zstd", asbytes=True), np.uint8).reshape(4, size)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(size)


def pack_texts(texts: list[str], level: int = 9) -> bytes:
    """A list of texts as compressed bytes behind their length."""
    data = json.dumps(texts, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")
    return len(data).to_bytes(8, "little") + squeeze(data, level)


def unpack_texts(data: bytes) -> list[str]:
    """The texts behind ``pack_texts``."""
    return json.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))
