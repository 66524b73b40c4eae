"""The TIFF format: strips or tiles; plain, LZW or Deflate, with predictors; classic and big files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..operators.grid import BandError, Georef

NODATA = -9999
#: Fixed values of the TIFF format: sample format and bits of each pixel type; bytes and struct codes of each field type.
KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
_FIELDS = {1: (1, "B"), 2: (1, ""), 3: (2, "H"), 4: (4, "I"), 5: (8, ""), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946


@dataclass(frozen=True)
class Raster:
    values: np.ndarray
    nodata: float | None
    row0: int
    col0: int
    geo: Georef


def encode(values: np.ndarray, row0: int = 0, col0: int = 0, geo: Georef = Georef(), compression: int = DEFLATE) -> bytes:
    """A little-endian TIFF of one strip, with the place of its upper left corner."""
    kind = next(k for k, v in KINDS.items() if np.dtype(v) == values.dtype.newbyteorder("="))
    h, w = values.shape
    strip = values.astype(values.dtype.newbyteorder("<")).tobytes()
    strip = zlib.compress(strip, 6) if compression == DEFLATE else strip
    shorts = {258: [kind[1]], 259: [compression], 262: [1], 277: [1], 339: [kind[0]]} | ({34735: [*geo.keys]} if geo.keys else {})
    longs = {256: [w], 257: [h], 273: [0], 278: [h], 279: [len(strip)]}
    doubles = {33550: [geo.width, geo.height, 0.0], 33922: [0.0, 0.0, 0.0, geo.x + col0 * geo.width, geo.y - row0 * geo.height, 0.0]} | ({34736: [*geo.doubles]} if geo.doubles else {})
    texts = {42113: str(NODATA)} | ({34737: geo.names} if geo.names else {})
    fields = [(t, 3, len(v), struct.pack(f"<{len(v)}H", *v)) for t, v in shorts.items()] + [(t, 4, len(v), struct.pack(f"<{len(v)}I", *v)) for t, v in longs.items()]
    fields += [(t, 12, len(v), struct.pack(f"<{len(v)}d", *v)) for t, v in doubles.items()] + [(t, 2, len(v) + 1, v.encode() + b"\0") for t, v in texts.items()]
    fields.sort()
    at, extra, entries = 8 + 2 + 12 * len(fields) + 4, [], []
    for tag, type_, n, data in fields:
        place = data.ljust(4, b"\0")
        if len(data) > 4:
            place = struct.pack("<I", at)
            extra.append(data + b"\0" * (len(data) & 1))
            at += len(extra[-1])
        entries.append([tag, struct.pack("<HHI", tag, type_, n), place])
    next(e for e in entries if e[0] == 273)[2] = struct.pack("<I", at)
    return b"".join([b"II*\0", struct.pack("<IH", 8, len(fields)), *(x for e in entries for x in e[1:]), b"\0" * 4, *extra, strip])


def fields(data) -> tuple[str, dict[int, tuple | bytes]]:
    """Byte order and the fields of the first directory; data is bytes or anything that gives bytes for slices."""

    def at_(place: int, code: str) -> tuple:
        return struct.unpack(order + code, data[place : place + struct.calcsize(order + code)])

    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    version = at_(2, "H")[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    word, count, entry, top = ("I", "H", 12, 4) if version == 42 else ("Q", "Q", 20, 8)
    (at,) = at_(top, word)
    (n_fields,) = at_(at, count)
    found: dict[int, tuple | bytes] = {}
    for i in range(n_fields):
        here = at + struct.calcsize(count) + entry * i
        tag, type_, n = at_(here, "HH" + word)
        size, code = _FIELDS.get(type_, (1, ""))
        here += 4 + struct.calcsize(word)
        if size * n > struct.calcsize(word):
            (here,) = at_(here, word)
        raw = data[here : here + size * n]
        found[tag] = struct.unpack(order + code * n, raw) if code else raw
    return order, found


def unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the highest bit first; 256 clears the table, 257 ends."""
    table, out, bits, held, width, last = [bytes([i]) for i in range(256)] + [b"", b""], [], 0, 0, 9, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if last is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out.append(word)
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _block(raw: bytes, compression: int, predictor: int, shape: tuple[int, int, int], kind: np.dtype) -> np.ndarray:
    """A strip or tile of (rows, columns, samples)."""
    if compression in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompress(raw)
    elif compression == LZW:
        raw = unlzw(raw)
    elif compression != PLAIN:
        raise ValueError(f"compression {compression} is not read")
    h, w, n = shape
    raw = raw[: h * w * n * kind.itemsize]
    if predictor == 3:  # bytes of floats, highest first, apart and differenced
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(h, -1, n), axis=1, dtype=np.uint8).reshape(h, kind.itemsize, w * n)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(shape)
    values = np.frombuffer(raw, kind).reshape(shape)
    return np.cumsum(values.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else values


def georef(tags: dict) -> tuple[Georef, int, int]:
    """Where the grid lies, and row and column of the upper left corner in it."""
    width, height = tags.get(33550, (1.0, 1.0))[:2]
    tie = tags.get(33922, (0.0,) * 6)
    x, y = tie[3] - tie[0] * width, tie[4] + tie[1] * height
    col0, row0 = int(np.floor(x / width + 1e-6)), int(np.floor(-y / height + 1e-6))
    near = lambda v: 0.0 if abs(v) < 1e-6 else v
    names = tags.get(34737, b"")
    return Georef(near(x - col0 * width), near(y + row0 * height), width, height, tags.get(34735, ()), tags.get(34736, ()), names.rstrip(b"\0").decode("latin-1")), row0, col0


def decode(data: bytes, band: int = 1) -> tuple[np.ndarray, float | None, int, int]:
    """Values of a band, nodata, and the row and column of the upper left corner."""
    got = raster(data, band)
    return got.values, got.nodata, got.row0, got.col0


@dataclass(frozen=True)
class Block:
    """A strip or tile of a file, or some rows of one: where its bytes are, and which cells it has."""

    at: int
    size: int
    row: int
    col: int
    rows: int
    cols: int


#: Strips and tiles as they are, without compression, are cut into blocks of about so many bytes.
PLAIN_BLOCK = 8 << 20


class Layout:
    """What the fields of a file say of its blocks."""

    def __init__(self, order: str, tags: dict):
        one = lambda tag, default: tags.get(tag, (default,))[0]
        self.tags, self.width, self.height, self.bands = tags, one(256, 0), one(257, 0), one(277, 1)
        self.kind = np.dtype(KINDS[one(339, 1), one(258, 8)]).newbyteorder(order)
        self.compression, self.predictor, self.apart = one(259, 1), one(317, 1), one(284, 1) == 2
        self.nodata = float(tags[42113].rstrip(b"\0 ")) if 42113 in tags else None
        self.geo, self.row0, self.col0 = georef(tags)

    def blocks(self, band: int = 1) -> Iterator[Block]:
        """The blocks that hold a band, in order."""
        if not 1 <= band <= self.bands:
            raise BandError(f"no band {band}: the file has {self.bands}")
        tags, tiled, w, h = self.tags, 322 in self.tags, self.width, self.height
        bw, bh = (tags.get(322, (w,))[0], tags.get(323, (h,))[0]) if tiled else (w, min(tags.get(278, (h,))[0], h))
        offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
        across, down = -(-w // bw), -(-h // bh)
        line = bw * self.kind.itemsize * (1 if self.apart else self.bands)
        for i in range(across * down):
            at = i + (band - 1) * across * down if self.apart else i
            r, c = i // across * bh, i % across * bw
            rows = bh if tiled else min(bh, h - r)  # the last strip is shorter
            if self.compression == PLAIN and self.predictor < 3:
                step = max(1, PLAIN_BLOCK // line)
                for k in range(0, rows, step):
                    n = min(step, rows - k)
                    yield Block(offsets[at] + k * line, n * line, r + k, c, n, bw)
            else:
                yield Block(offsets[at], sizes[at], r, c, rows, bw)

    def values(self, raw: bytes, block: Block, band: int = 1) -> np.ndarray:
        """The cells of a block that lie in the image."""
        got = _block(raw, self.compression, self.predictor, (block.rows, block.cols, 1 if self.apart else self.bands), self.kind)
        return got[: max(0, self.height - block.row), : self.width - block.col, 0 if self.apart else band - 1]

    def there(self, values: np.ndarray) -> np.ndarray:
        """Which cells have a value."""
        some = ~np.isnan(values) if self.kind.kind == "f" else np.ones(values.shape, bool)
        if self.nodata is not None:  # as the file's pixel type has it
            some &= values != np.array(self.nodata).astype(self.kind.newbyteorder("="))
        return some


def raster(data: bytes, band: int = 1) -> Raster:
    """One band of a file."""
    found = Layout(*fields(data))
    values = np.zeros((found.height, found.width), found.kind.newbyteorder("="))
    for b in found.blocks(band):
        part = found.values(data[b.at : b.at + b.size], b, band)
        values[b.row : b.row + part.shape[0], b.col : b.col + part.shape[1]] = part
    return Raster(values, found.nodata, found.row0, found.col0, found.geo)
