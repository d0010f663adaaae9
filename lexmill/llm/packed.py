"""Values on their way between tasks: pickled and compressed."""

from __future__ import annotations

import pickle

import zstandard


def pack(value, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(value, protocol=5))


def unpack(raw: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(raw))
