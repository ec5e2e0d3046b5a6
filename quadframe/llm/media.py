"""Media columns: Netpbm and BMP bytes to numpy arrays, thumbnails, NPY tiles and difference hashes."""

from __future__ import annotations

import io
import struct

import numpy as np


class BadImage(ValueError):
    """The bytes are no image this module reads."""


# ---------------------------------------------------------------- Netpbm
def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """``count`` numbers after the magic, and the place after the one white-space byte that ends them."""
    at, numbers = 2, []
    while len(numbers) < count:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            if data[at] == 35:
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            at += 1
        start = at
        while at < len(data) and 48 <= data[at] <= 57:
            at += 1
        if start == at or at - start > 9:
            raise BadImage("a Netpbm header needs numbers")
        numbers.append(int(data[start:at]))
    return numbers, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array (height, width) or (height, width, 3), uint8 or uint16; bitmaps give 0 and 255."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise BadImage("not Netpbm")
    bitmap, colour, plain = kind in (b"P1", b"P4"), kind in (b"P3", b"P6"), kind in (b"P1", b"P2", b"P3")
    numbers, at = _header(data, 2 if bitmap else 3)
    width, height, most = numbers[0], numbers[1], 1 if bitmap else numbers[2]
    if not (width and height and 0 < most < 65536):
        raise BadImage("a side or the maximum is 0 or too large")
    shape = (height, width, 3) if colour else (height, width)
    n = height * width * (3 if colour else 1)
    if plain:
        if n > len(data):
            raise BadImage("too few samples")
        text = b"\n".join(x.split(b"#")[0] for x in data[at - 1 :].split(b"\n"))
        digits = [bytes([c]) for c in text if c in b"01"] if bitmap else text.split()
        if len(digits) < n:
            raise BadImage("too few samples")
        if not all(x.isdigit() and len(x) < 10 for x in digits[:n]):
            raise BadImage("a sample is no number")
        flat = np.array([int(x) for x in digits[:n]], np.int64)
    elif bitmap:
        row = (width + 7) // 8
        if len(data) - at < row * height:
            raise BadImage("too few samples")
        flat = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at).reshape(height, row), axis=1)[:, :width].reshape(-1)
    else:
        kind_of = np.dtype("u1" if most < 256 else ">u2")
        if len(data) - at < n * kind_of.itemsize:
            raise BadImage("too few samples")
        flat = np.frombuffer(data, kind_of, n, at)
    if flat.size and int(flat.max()) > most:
        raise BadImage("a sample is above the maximum")
    if bitmap:
        return np.where(flat.reshape(shape), 0, 255).astype(np.uint8)
    return flat.reshape(shape).astype(np.uint8 if most < 256 else np.uint16)


def encode_pgm(samples: np.ndarray) -> bytes:
    """8-bit (height, width) samples as binary PGM."""
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + np.ascontiguousarray(samples, np.uint8).tobytes()


# ---------------------------------------------------------------- BMP
def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits, and 8-bit RLE, top row first: (height, width) uint8 if the palette is of
    greys alone, whatever the samples, else (height, width, 3)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise BadImage("not BMP")
    at, size, width, height, _, bits, packing = struct.unpack_from("<10xIIiiHHI", data)
    colours = struct.unpack_from("<I", data, 46)[0]
    down, height = height < 0, abs(height)
    if size < 40 or width <= 0 or not height or (bits, packing) not in {(1, 0), (4, 0), (8, 0), (24, 0), (32, 0), (8, 1)}:
        raise BadImage("a BMP of a kind that is not read")
    if packing == 1:
        # a run makes at most 255 samples of two bytes; a header that asks for far more is not believed
        if width * height > 256 * len(data):
            raise BadImage("too few runs")
        indexes = _run_lengths(data[at:], width, height)
    else:
        row = (width * bits + 31) // 32 * 4
        if len(data) - at < row * height:
            raise BadImage("too few samples")
        rows = np.frombuffer(data, np.uint8, row * height, at).reshape(height, row)
        if bits >= 24:
            pixels = rows[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1]
            return np.ascontiguousarray(pixels if down else pixels[::-1])
        if bits == 8:
            indexes = rows[:, :width]
        elif bits == 4:
            indexes = np.stack([rows >> 4, rows & 15], 2).reshape(height, -1)[:, :width]
        else:
            indexes = np.unpackbits(rows, axis=1)[:, :width]
    n = colours or 1 << bits
    if n > 256 or len(data) < 14 + size + 4 * n:
        raise BadImage("the palette is cut off")
    palette = np.frombuffer(data, np.uint8, 4 * n, 14 + size).reshape(n, 4)[:, 2::-1]
    if indexes.size and int(indexes.max()) >= n:
        raise BadImage("a sample is beyond the palette")
    pixels = palette[:, 0][indexes] if (palette == palette[:, :1]).all() else palette[indexes]
    return np.ascontiguousarray(pixels if down else pixels[::-1])


def _run_lengths(data: bytes, width: int, height: int) -> np.ndarray:
    out, x, y, at = np.zeros((height, width), np.uint8), 0, 0, 0
    while at + 1 < len(data):
        n, value = data[at], data[at + 1]
        at += 2
        if n:
            out[min(y, height - 1), x : x + n] = value
            x += n
        elif value == 0:
            x, y = 0, y + 1
        elif value == 1:
            return out
        elif value == 2:
            if at + 2 > len(data):
                break
            x, y, at = x + data[at], y + data[at + 1], at + 2
        else:
            if at + value > len(data):
                break
            part = np.frombuffer(data, np.uint8, value, at)[: max(0, width - x)]
            out[min(y, height - 1), x : x + len(part)] = part
            x, at = x + value, at + value + value % 2
        if y >= height:
            return out
    raise BadImage("the runs have no end")


def encode_bmp(pixels: np.ndarray) -> bytes:
    """(height, width) uint8 as an 8-bit grey BMP, (height, width, 3) as a 24-bit one; bottom row first."""
    height, width = pixels.shape[:2]
    grey = pixels.ndim == 2
    row = (width * (1 if grey else 3) + 3) // 4 * 4
    body = np.zeros((height, row), np.uint8)
    body[:, : width * (1 if grey else 3)] = (pixels if grey else pixels[:, :, ::-1].reshape(height, -1))[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1) * np.array([1, 1, 1, 0], np.uint8) if grey else np.zeros(0, np.uint8)
    at = 54 + palette.size
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", at + body.size, 0, 0, at, 40, width, height, 1, 8 if grey else 24, 0, body.size, 2835, 2835, 0, 0) + palette.tobytes() + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


# ---------------------------------------------------------------- features
#: Luma weights of red, green and blue.
LUMA = np.array([0.299, 0.587, 0.114])


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of ``samples`` over each cell of a ``height`` by ``width`` grid, cells of fractional sides included; of
    colour samples their luma.

    The integral image is read at fractional corners, where it is linear between whole ones, so a cell costs
    four reads however large it is; it also enlarges.  Only the rows that are read are made, from
    sums of the strips between them, so a large image needs no second one.
    """
    h, w = samples.shape[:2]

    def along(n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(cells + 1) * (n / cells)
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, at - low

    y, fy = along(h, height)
    x, fx = along(w, width)
    needed = np.unique(np.r_[0, y, y + 1])
    exact = np.uint64 if samples.dtype.kind in "bu" else np.float64
    strips = np.stack([samples[a:b].sum(axis=0, dtype=exact) for a, b in zip(needed[:-1], needed[1:])]).astype(np.float64)
    strips = strips @ LUMA if samples.ndim == 3 else strips
    integral = np.zeros((len(needed), w + 1))
    np.cumsum(np.cumsum(strips, axis=0), axis=1, out=integral[1:, 1:])
    place = np.searchsorted(needed, y)
    rows = integral[place] * (1 - fy)[:, None] + integral[np.searchsorted(needed, y + 1)] * fy[:, None]
    corners = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    return np.diff(np.diff(corners, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(samples: np.ndarray, side: int = 8) -> str:
    """``side * side`` bits: whether each cell of a side by side + 1 thumbnail is darker than its right neighbour."""
    small = np.round(area_resize(samples, side, side + 1), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(samples: np.ndarray, side: int = 8) -> bytes:
    """The area-resized ``side`` by ``side`` tile, rounded to uint8, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(samples, side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()
