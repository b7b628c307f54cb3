"""Raster work in NumPy, run inside Arrow batches: resampling, crop clean-up, edge scans."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Pages narrower than the limit are resampled to the target width; crops are enlarged, and marks below the level are dark.
NARROW, TARGET_WIDTH, CROP_SCALE, DARK, HOLLOW_SHARE, CLOSINGS, PAPER = 2800, 3500, 3, 80, 0.10, 4, 240


def _lanczos(n_in: int, n_out: int, a: int = 3) -> np.ndarray:
    """The resampling matrix along one axis, with the kernel widened when shrinking."""
    scale = max(n_in / n_out, 1.0)
    at = (np.arange(n_out) + 0.5) * n_in / n_out - 0.5
    x = (np.arange(n_in)[None, :] - at[:, None]) / scale
    w = np.where(np.abs(x) < a, np.sinc(x) * np.sinc(x / a), 0.0)
    return w / w.sum(1, keepdims=True)


def resample(image: np.ndarray, height: int, width: int) -> np.ndarray:
    rows, cols = _lanczos(image.shape[0], height), _lanczos(image.shape[1], width)
    out = np.tensordot(rows, image.astype(np.float64), (1, 0))
    out = np.moveaxis(np.tensordot(cols, out, (1, 1)), 0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def upscaled(image: np.ndarray) -> tuple[np.ndarray, int | None]:
    """(image, its height if it was enlarged)."""
    h, w = image.shape[:2]
    if w >= NARROW:
        return image, None
    height = round(h * TARGET_WIDTH / w)
    return resample(image, height, TARGET_WIDTH), height


def grey(image: np.ndarray) -> np.ndarray:
    return np.rint(image[..., :3].astype(np.float64) @ np.array([0.2126, 0.7152, 0.0722])).astype(np.uint8)


def _window(image: np.ndarray, pick) -> np.ndarray:
    p = np.pad(image, 1, mode="edge")
    h, w = image.shape
    return pick([p[i : i + h, j : j + w] for i in range(3) for j in range(3)])


def clean_crop(crop: np.ndarray) -> np.ndarray:
    """Enlarges a crop and fills hollow digits by a closing of its dark parts, unless it has dark parts enough."""
    big = resample(crop, crop.shape[0] * CROP_SCALE, crop.shape[1] * CROP_SCALE)
    g = grey(big)
    if (g < DARK).mean() > HOLLOW_SHARE:
        return big
    closed = g
    for pick in (np.minimum.reduce, np.maximum.reduce):
        for _ in range(CLOSINGS):
            closed = _window(closed, pick)
    big = big.copy()
    big[(closed < DARK) & (g >= DARK)] = 0
    return big


def region(image: np.ndarray, x: int, y: int, half_w: int, half_h: int) -> np.ndarray | None:
    """The box around a point, or None where it would leave the page."""
    h, w = image.shape[:2]
    if x < half_w or y < half_h or x + half_w >= w or y + half_h >= h:
        return None
    return image[y - half_h : y + half_h, x - half_w : x + half_w]


def ink_span(image: np.ndarray, row: int, start: int, stop: int) -> tuple[int, int] | None:
    """The first and last column of a row that are not paper."""
    ink = np.flatnonzero((image[row, start:stop, :3] < PAPER).any(-1))
    return (start + int(ink[0]), start + int(ink[-1])) if len(ink) else None


def png(image: np.ndarray) -> bytes:
    """A PNG file of an RGB image: 8 bits a channel, rows without a filter."""
    h, w = image.shape[:2]
    rows = np.zeros((h, 1 + 3 * w), np.uint8)
    rows[:, 1:] = image[..., :3].reshape(h, -1)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


class Decoder:
    """Decodes PNG (8 or 16 bits, not interlaced) and BMP (24 or 32 bits, not compressed) files to RGB. ValueError for others."""

    def decode(self, data: bytes) -> np.ndarray:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png_pixels(data)
        if data[:2] == b"BM":
            return _bmp_pixels(data)
        raise ValueError("an image of another format than PNG and BMP needs a decoder of its own")


def _png_pixels(data: bytes) -> np.ndarray:
    at, parts, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        at += size + 12
    if head is None or not parts:
        raise ValueError("a PNG file without pixels")
    width, height, bits, colour, _, _, interlaced = head
    if interlaced or bits not in (8, 16) or colour not in CHANNELS or (colour == 3 and palette is None):
        raise ValueError("a PNG file of a kind that needs a decoder of its own")
    step = CHANNELS[colour] * bits // 8
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.uint8)
    for y in range(height):
        above = out[y] = _unfiltered(rows[y, 0], rows[y, 1:], above, step)
    pixels = out.reshape(height, width, step)[..., :: bits // 8]  # of 16 bits the upper 8
    if colour == 3:
        return palette[pixels[..., 0]]
    return np.ascontiguousarray(np.repeat(pixels[..., :1], 3, -1) if colour in (0, 4) else pixels[..., :3])


CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # of the PNG colour types


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes without its filter (PNG specification, section 9)."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), 0, np.uint8).ravel()
    if kind == 2:
        return row + above
    if kind not in (3, 4):
        raise ValueError("a PNG file with an unknown filter")
    line, up, out = row.tolist(), above.tolist(), [0] * len(row)
    for i, x in enumerate(line):
        a, b = (out[i - step] if i >= step else 0), up[i]
        if kind == 3:
            out[i] = (x + (a + b) // 2) & 255
            continue
        c = up[i - step] if i >= step else 0
        pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        out[i] = (x + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
    return np.array(out, np.uint8)


def _bmp_pixels(data: bytes) -> np.ndarray:
    start, = struct.unpack_from("<I", data, 10)
    width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if bits not in (24, 32) or packed not in (0, 3) or width <= 0:
        raise ValueError("a BMP file of a kind that needs a decoder of its own")
    line = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, abs(height) * line, start).reshape(abs(height), line)[:, : width * bits // 8]
    pixels = rows.reshape(abs(height), width, bits // 8)[..., 2::-1]
    return np.ascontiguousarray(pixels[::-1] if height > 0 else pixels)
