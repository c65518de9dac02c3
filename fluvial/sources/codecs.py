"""Codecs of array chunks: general compressors, byte and bit shuffles, checksums, and Blosc frames."""

from __future__ import annotations

import bz2
import gzip
import lzma
import math
import struct
import zlib

import numpy as np
import pyarrow as pa

#: Blosc: bits of a frame's flags, compressors by their number there, and when a block is split by bytes of its
#: elements (fixed by the format).
SHUFFLED, PLAIN, BIT_SHUFFLED, WHOLE_BLOCKS = 1, 2, 4, 16
BLOSC_KINDS = {0: "blosclz", 1: "lz4", 2: "snappy", 3: "zlib", 4: "zstd"}
MOST_SPLITS, LEAST_SPLIT = 16, 128


def unshuffled(raw: bytes, width: int) -> bytes:
    """Bytes that stand together by their place in elements of ``width`` bytes, element by element again."""
    n = len(raw) // width
    if width < 2 or not n:
        return raw
    return np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T.tobytes() + raw[n * width :]


def bit_unshuffled(raw: bytes, width: int) -> bytes:
    """The same for bits; elements beyond a multiple of eight stand as they are."""
    n = len(raw) // width // 8 * 8
    if not n:
        return raw
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, n * width).reshape(width * 8, n // 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + raw[n * width :]


def _one(kind: str, raw: bytes, size: int) -> bytes:
    if kind in ("lz4", "snappy", "zstd"):
        return pa.Codec("lz4_raw" if kind == "lz4" else kind).decompress(raw, size, asbytes=True)
    if kind == "zlib":
        return zlib.decompress(raw)
    raise ValueError(f"compressor {kind} is not supported")


def unpack_blosc(frame: bytes) -> bytes:
    """A Blosc frame: blocks, each of one stream or of one a byte of its elements."""
    _, _, flags, width, size, block, packed = struct.unpack("<4B3I", frame[:16])
    if flags & PLAIN:
        return frame[16 : 16 + size]
    kind, count = BLOSC_KINDS.get(flags >> 5, str(flags >> 5)), -(-size // block) if block else 0
    out = []
    for b, at in enumerate(struct.unpack(f"<{count}i", frame[16 : 16 + 4 * count])):
        held = min(block, size - b * block)
        split = not flags & WHOLE_BLOCKS and width <= MOST_SPLITS and block // width >= LEAST_SPLIT and held == block
        streams = []
        for _ in range(width if split else 1):
            (n,) = struct.unpack("<i", frame[at : at + 4])
            part, want = frame[at + 4 : at + 4 + n], held // width if split else held
            streams.append(part if n == want else _one(kind, part, want))
            at += 4 + n
        whole = b"".join(streams)
        out.append(unshuffled(whole, width) if flags & SHUFFLED else bit_unshuffled(whole, width) if flags & BIT_SHUFFLED else whole)
    return b"".join(out)


def _unpack_zstd(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(raw)


def unpack_lz4(raw: bytes) -> bytes:
    """LZ4 behind its size in four bytes."""
    return _one("lz4", raw[4:], struct.unpack("<I", raw[:4])[0])


#: Decoders by the codecs' names in Zarr stores (versions 2 and 3).
DECODERS = {"zlib": zlib.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress, "lzma": lzma.decompress, "zstd": _unpack_zstd, "lz4": unpack_lz4, "blosc": unpack_blosc}


def decoded(kind: str, raw: bytes) -> bytes:
    if kind not in DECODERS:
        raise ValueError(f"codec {kind} is not supported")
    return DECODERS[kind](raw)


def total(shape) -> int:
    return math.prod(int(s) for s in shape)
