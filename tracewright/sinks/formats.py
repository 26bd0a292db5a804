"""Bytes of the file formats, in pieces that tasks make apart and that are joined unread.

A compressed stream is cut into bands.  Each is deflated by itself and ends in a full
flush, so that the next one starts at a byte and needs nothing of what came before; put
one after the other, with an empty last block, they are one stream.  The checksums of the
whole (CRC-32 and Adler-32) are worked out from those of the bands and their lengths.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Fixed values of the formats: an empty last block of deflate; signatures and limits of
# archives; polynomial and modulus of the checksums.
LAST_BLOCK = b"\x03\x00"
CRC_POLYNOMIAL, ADLER_MODULUS = 0xEDB88320, 65521
MOST_32 = 0xFFFFFFFF
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


@dataclass(frozen=True)
class Band:
    """A piece of a stream: its compressed bytes, and length and checksums of what they stand for."""

    data: bytes
    size: int
    crc: int
    adler: int


def band_of(raw: bytes, level: int = 6) -> Band:
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    data = deflate.compress(raw) + deflate.flush(zlib.Z_FULL_FLUSH)
    return Band(data, len(raw), zlib.crc32(raw), zlib.adler32(raw))


def _times(matrix: Sequence[int], vector: int) -> int:
    total = 0
    for row in matrix:
        if vector & 1:
            total ^= row
        vector >>= 1
    return total


@lru_cache(maxsize=256)
def _zeros(size: int) -> tuple[int, ...]:
    """What ``size`` zero bytes do to a CRC-32: a linear map over bits.

    The map of 2^k bytes is that of 2^(k-1) applied twice.  Pieces of a file have few sizes."""
    step = [CRC_POLYNOMIAL, *(1 << i for i in range(31))]  # of one zero bit
    for _ in range(3):
        step = [_times(step, row) for row in step]
    out = [1 << i for i in range(32)]
    while size:
        if size & 1:
            out = [_times(step, row) for row in out]
        step = [_times(step, row) for row in step]
        size >>= 1
    return tuple(out)


def joined_crc(first: int, second: int, second_size: int) -> int:
    """CRC-32 of two pieces put together, from those of the pieces."""
    return _times(_zeros(second_size), first) ^ second


def joined_adler(first: int, second: int, second_size: int) -> int:
    """Adler-32 of two pieces put together, from those of the pieces."""
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    a = (a1 + a2 - 1) % ADLER_MODULUS
    b = (b1 + b2 + (a1 - 1) * second_size) % ADLER_MODULUS
    return b << 16 | a


# --- images


def png_head(height: int, width: int) -> bytes:
    """Up to where the data of an 8-bit RGB image begin, the stream's two first bytes with it."""
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", b"\x78\x9c")


def png_rows(rgb: np.ndarray) -> bytes:
    """Rows of an image as they go into the stream: each after a byte for no filter."""
    h, w, _ = rgb.shape
    return np.concatenate([np.zeros((h, 1), np.uint8), np.asarray(rgb, np.uint8).reshape(h, 3 * w)], axis=1).tobytes()


def png_band(band: Band) -> bytes:
    return _chunk(b"IDAT", band.data)


def png_tail(adler: int) -> bytes:
    return _chunk(b"IDAT", LAST_BLOCK + struct.pack(">I", adler)) + _chunk(b"IEND", b"")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


# --- archives of arrays


def npy_head(kind: np.dtype, shape: tuple[int, ...]) -> bytes:
    """The header of an array file (version 1.0), padded to 64 bytes."""
    text = repr({"descr": np.lib.format.dtype_to_descr(np.dtype(kind)), "fortran_order": False, "shape": tuple(int(n) for n in shape)})
    text += " " * (-(10 + len(text) + 1) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(text)) + text.encode("latin1")


@dataclass(frozen=True)
class Member:
    """A file in an archive: where it starts and what it comes to."""

    name: str
    at: int
    stored: int
    size: int
    crc: int


def zip_member_head(name: str) -> bytes:
    """Before a member's data.  Sizes and checksum follow behind them, with 64 bits."""
    raw = name.encode()
    extra = struct.pack("<HHQQ", 1, 16, 0, 0)
    return struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 8, 0, 0x0021, 0, MOST_32, MOST_32, len(raw), len(extra)) + raw + extra


def zip_member_tail(crc: int, stored: int, size: int) -> bytes:
    return LAST_BLOCK + struct.pack("<IIQQ", 0x08074B50, crc, stored, size)


def zip_directory(members: Iterable[Member], at: int) -> bytes:
    """The archive's directory, which starts at ``at``, in the form for any size."""
    parts, n = [], 0
    for m in members:
        raw = m.name.encode()
        extra = struct.pack("<HHQQQ", 1, 24, m.size, m.stored, m.at)
        parts.append(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 8, 0, 0x0021, m.crc, MOST_32, MOST_32, len(raw), len(extra), 0, 0, 0, 0, MOST_32) + raw + extra)
        n += 1
    body = b"".join(parts)
    end = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(body), at)
    where = struct.pack("<IIQI", 0x07064B50, 0, at + len(body), 1)
    return body + end + where + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), MOST_32, MOST_32, 0)


# --- label volumes


def vti_head(extent: tuple[int, int], spacing: tuple[float, float], size: int) -> bytes:
    """Up to the raw data of a VTK ImageData file with one 32-bit integer per cell."""
    h, w = extent
    whole = f"0 {h} 0 {w} 0 1"
    return (
        '<?xml version="1.0"?>\n<VTKFile type="ImageData" version="1.0" byte_order="LittleEndian" header_type="UInt64">\n'
        f'<ImageData WholeExtent="{whole}" Origin="0 0 0" Spacing="{spacing[0]} {spacing[1]} 1.0">\n<Piece Extent="{whole}">\n'
        '<CellData Scalars="label">\n<DataArray type="Int32" Name="label" format="appended" offset="0"/>\n</CellData>\n</Piece>\n</ImageData>\n'
        '<AppendedData encoding="raw">\n_'
    ).encode() + struct.pack("<Q", size)


VTI_TAIL = b"\n</AppendedData>\n</VTKFile>\n"
