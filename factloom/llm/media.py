"""Media columns: binary payloads as Netpbm or BMP images, decoded to arrays.

The codecs are exact: what ``decode`` returns has the very samples that
``encode_*`` stored. Features come from an area resize (integral images, so
every source sample counts) and a difference hash; thumbnails are NPY tiles.

Defined results: null or empty text is stored as one row of spaces; a text of
any length is stored whole (one image row for each 192 bytes); equal texts
give equal values; repeated rows are each processed; an empty table gives an
empty result; other columns are ignored, whatever they are called. Without a
format, an odd CRC-32 of the payload chooses BMP and an even one PPM.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

#: Bytes of one stored row: 64 pixels of three samples.
ROW_BYTES = 192
#: Size of the NPY thumbnail tile.
TILE = (8, 9)

_HEADER = re.compile(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """uint8 (h, w) as PGM, (h, w, 3) as PPM."""
    h, w = pixels.shape[:2]
    return b"P%d\n%d %d\n255\n" % (5 if pixels.ndim == 2 else 6, w, h) + np.ascontiguousarray(pixels).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """uint8 (h, w, 3) as an uncompressed 24-bit BMP: bottom row first, BGR, rows padded to 4 bytes."""
    h, w = pixels.shape[:2]
    rows = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    le = lambda x, n: int(x).to_bytes(n, "little")
    info = le(40, 4) + le(w, 4) + le(h, 4) + le(1, 2) + le(24, 2) + le(0, 4) + le(rows.size, 4) + le(2835, 4) * 2 + le(0, 8)
    return b"BM" + le(54 + rows.size, 4) + le(0, 4) + le(54, 4) + info + rows.tobytes()


def decode(media: bytes) -> np.ndarray:
    """The pixels of a binary Netpbm (P5, P6) or a 24-bit BMP."""
    if media[:2] == b"BM":
        at, w, h = (int.from_bytes(media[i : i + 4], "little", signed=i > 10) for i in (10, 18, 22))
        if int.from_bytes(media[28:30], "little") != 24 or int.from_bytes(media[30:34], "little"):
            raise ValueError("only uncompressed 24-bit BMP is read")
        rows = np.frombuffer(media, np.uint8, abs(h) * ((3 * w + 3) // 4 * 4), at).reshape(abs(h), -1)[:, : 3 * w].reshape(abs(h), w, 3)
        return rows[:: -1 if h > 0 else 1, :, ::-1]
    m = _HEADER.match(media)
    if not m or m[4] != b"255":
        raise ValueError("neither binary Netpbm of 8 bits nor BMP")
    w, h = int(m[2]), int(m[3])
    shape = (h, w) if m[1] == b"5" else (h, w, 3)
    return np.frombuffer(media, np.uint8, int(np.prod(shape)), m.end()).reshape(shape)


def area_resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each cell's source area, from one integral image; cell edges may cut samples."""
    h, w = gray.shape
    integral = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(gray, 0, dtype=np.float64), 1, out=integral[1:, 1:])

    def at(total: np.ndarray, edge: np.ndarray) -> np.ndarray:
        i = np.minimum(edge.astype(np.int64), len(total) - 2)
        return total[i] + (total[i + 1] - total[i]) * (edge - i)[:, None]

    ys, xs = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    corners = at(at(integral, ys).T, xs).T
    cells = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return cells / (h / height * (w / width))


def difference_hash(small: np.ndarray) -> str:
    """A bit for each horizontal neighbour pair that gets brighter, as hex."""
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def gray(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else pixels.sum(2, dtype=np.uint16)


def npy_tile(small: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, small.round().astype(np.uint16), allow_pickle=False)
    return out.getvalue()


def tile_of(npy: bytes) -> np.ndarray:
    """The samples of an NPY tile."""
    return np.load(io.BytesIO(npy), allow_pickle=False)


def store(payload: bytes, fmt: str | None = None) -> bytes:
    """The payload, a positive multiple of 192 bytes, as an image of 64 pixels a row."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES // 3, 3)
    fmt = fmt or ("ppm", "bmp")[zlib.crc32(payload) & 1]
    return encode_bmp(pixels) if fmt == "bmp" else encode_netpbm(pixels)


def pad(text: bytes) -> bytes:
    return text + b" " * (-len(text) % ROW_BYTES or (0 if text else ROW_BYTES))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fmt: str | None = None, blobs: bool = False) -> DataFrame:
    """Store each whole text as an image, read it back and describe what was read.

    The image read back is resized and written as an NPY tile; ``feature`` is the
    difference hash of the tile's samples, ``tile_sha256`` the digest of its bytes.
    With ``blobs`` the stored image and its tile are returned as well.
    """

    def kernel(texts: pa.Array) -> list[pa.Array]:
        rows = []
        for t in texts.cast(pa.large_binary()):
            raw = t.as_py()
            media = store(pad(raw), fmt)
            pixels = decode(media)
            back = np.ascontiguousarray(pixels).tobytes()
            tile = npy_tile(area_resize(gray(pixels), *TILE))
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(tile_of(tile)), hashlib.sha256(tile).hexdigest(), *((media, tile) if blobs else ())))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *((pa.binary(), pa.binary()) if blobs else ()))
        return [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]

    fields = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, tile_sha256 string" + ", media binary, tile binary" * blobs
    return map_texts(docs, text_col, kernel, fields, [id_col])
