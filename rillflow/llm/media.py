"""Media columns: Netpbm and BMP images as numpy arrays, area-resized tiles in NPY form, difference hashes.

Readers take binary and plain Netpbm (P1-P6, maxval up to 255) and uncompressed 8- and 24-bit BMP.
Resizing integrates each target cell over the image's integral image, fractional edges included, so
the cost does not depend on the scale.  All functions work on one image and need a few times its bytes.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import map_columns, texts_of

PIXELS_PER_ROW = 64
CHANNELS = 3
ROW_BYTES = PIXELS_PER_ROW * CHANNELS
TILE = 16


def write_netpbm(pixels: np.ndarray) -> bytes:
    """P5 for (h, w), P6 for (h, w, 3), 8 bits a sample."""
    magic = b"P5" if pixels.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (magic, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def _netpbm_header(data: bytes, count: int) -> tuple[list[int], int]:
    """The first ``count`` header numbers after the magic and the offset of what follows; comments are skipped."""
    numbers, at = [], 2
    while len(numbers) < count:
        c = data[at : at + 1]
        if not c:
            raise ValueError("truncated Netpbm header")
        if c == b"#":
            at = data.index(b"\n", at) + 1
        elif c.isspace():
            at += 1
        else:
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            if end == at:
                raise ValueError("bad Netpbm header")
            numbers.append(int(data[at:end]))
            at = end
    return numbers, at


def read_netpbm(data: bytes) -> np.ndarray:
    """(h, w) or (h, w, 3) uint8; bitmaps become 0 (black) and 255 (white)."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    bitmap, depth = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    header, at = _netpbm_header(data, 2 if bitmap else 3)
    w, h = header[:2]
    if not bitmap and not 0 < header[2] < 256:
        raise ValueError("only 8-bit Netpbm images are supported")
    if kind == b"P4":
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, (w + 7) // 8)
        return np.where(np.unpackbits(rows, axis=1)[:, :w] == 1, 0, 255).astype(np.uint8)
    if kind == b"P1":
        bits = np.frombuffer(data[at:], np.uint8)
        bits = bits[(bits == 48) | (bits == 49)][: w * h] - 48
        return np.where(bits.reshape(h, w) == 1, 0, 255).astype(np.uint8)
    if kind in (b"P2", b"P3"):
        flat = np.array(data[at:].split()[: w * h * depth], dtype=np.int64).astype(np.uint8)
    else:
        flat = np.frombuffer(data, np.uint8, w * h * depth, at + 1)
    return flat.reshape((h, w, 3) if depth == 3 else (h, w))


def write_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed 24-bit BMP, bottom-up rows of BGR padded to four bytes."""
    h, w = pixels.shape[:2]
    stride = (3 * w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    body = rows.tobytes()
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(body), 0, 0, 54, 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def read_bmp(data: bytes) -> np.ndarray:
    """(h, w, 3) uint8 from an uncompressed 8-bit (palette) or 24-bit BMP, either row order."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    offset, header, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (8, 24):
        raise ValueError("only uncompressed 8- and 24-bit BMP images are supported")
    up, h = h > 0, abs(h)
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, h * stride, offset).reshape(h, stride)
    rows = rows[::-1] if up else rows
    if bits == 24:
        return np.ascontiguousarray(rows[:, : 3 * w].reshape(h, w, 3)[:, :, ::-1])
    used = struct.unpack_from("<I", data, 46)[0] or 256
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + header).reshape(used, 4)[:, 2::-1]
    return np.ascontiguousarray(palette[rows[:, :w]])


def decode(data: bytes) -> np.ndarray:
    return read_bmp(data) if data[:2] == b"BM" else read_netpbm(data)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell, as float64 of shape (height, width, channels).

    Of the integral image only the rows beside the target's edges are kept: sums of the bands between
    them, carried on downwards and then across.
    """
    cube = pixels[:, :, None] if pixels.ndim == 2 else pixels
    h, w, depth = cube.shape
    down, across = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    low = np.minimum(down.astype(np.int64), h - 1)
    kept = np.unique(np.concatenate((low, low + 1)))  # from 0 to h
    integral = np.zeros((len(kept), w + 1, depth), np.int64)
    for i, (top, bottom) in enumerate(zip(kept[:-1], kept[1:])):
        integral[i + 1, 1:] = integral[i, 1:] + cube[top:bottom].sum(axis=0, dtype=np.int64)
    np.cumsum(integral, axis=1, out=integral)

    def between(table: np.ndarray, first: np.ndarray, part: np.ndarray, axis: int) -> np.ndarray:
        part = part.reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
        return np.take(table, first, axis) * (1 - part) + np.take(table, first + 1, axis) * part

    left = np.minimum(across.astype(np.int64), w - 1)
    sums = between(between(integral, np.searchsorted(kept, low), down - low, 0), left, across - left, 1)
    return np.diff(np.diff(sums, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 8 cells of the grey image is darker than its right neighbour."""
    grey = area_resize(pixels, 8, 9).mean(axis=2)
    return np.packbits(np.round(grey[:, 1:], 6) > np.round(grey[:, :-1], 6)).tobytes().hex()


def npy_tile(pixels: np.ndarray, size: int = TILE) -> bytes:
    """The image resized to size x size as a .npy file of uint8."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.round(area_resize(pixels, size, size)).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def text_payload(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, then spaces up to a positive multiple of a pixel row."""
    raw = (text or "").encode()
    rows = max(1, -(-len(raw) // ROW_BYTES))
    return len(raw), raw.ljust(rows * ROW_BYTES, b" ")


def text_images(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """Each whole text as an image: doc_id, n_bytes, kind, media (bytes), tile (.npy bytes), dhash.

    Payloads with an odd CRC-32 become BMP, others P6 Netpbm, so equal texts have equal images, whatever
    their doc_ids.  A null or empty text is one row of spaces, a null doc_id stays null.  Repeated rows
    give repeated rows; an empty table gives none; further columns are not read.  A very long text is one
    tall image: memory is a few times its bytes and, beside it, a slice of rows (``common.SLICE_BYTES``).
    """

    def images(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "kind", "media", "tile", "dhash")}
        for doc_id, text in zip(rows["doc_id"], rows["text"]):
            n, payload = text_payload(text)
            pixels = np.frombuffer(payload, np.uint8).reshape(-1, PIXELS_PER_ROW, CHANNELS)
            bmp = zlib.crc32(payload) % 2 == 1
            media = write_bmp(pixels) if bmp else write_netpbm(pixels)
            back = decode(media)
            for k, v in (("doc_id", doc_id), ("n_bytes", n), ("kind", "bmp" if bmp else "ppm"), ("media", media), ("tile", npy_tile(back, tile)), ("dhash", difference_hash(back))):
                out[k].append(v)
        return out

    return map_columns(texts_of(docs), images, "doc_id long, n_bytes long, kind string, media binary, tile binary, dhash string", 256)


def media_digests(images: DataFrame) -> DataFrame:
    """What the stored bytes hold when read back: payload, its tail, the stored form and the features."""

    def digests(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256")}
        for doc_id, n, media, tile, dhash in zip(rows["doc_id"], rows["n_bytes"], rows["media"], rows["tile"], rows["dhash"]):
            payload = decode(media).tobytes()
            values = (doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), dhash, hashlib.sha256(tile).hexdigest())
            for k, v in zip(out, values):
                out[k].append(v)
        return out

    return map_columns(images, digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string", 256)
