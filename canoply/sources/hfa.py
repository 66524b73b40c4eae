"""The HFA format (Erdas Imagine, .img): a tree of typed nodes, a dictionary of their types, and a map of blocks.

Files are written plain, with blocks of 64 x 64 cells and their place on the map; read are also files of run-length blocks. The
layout of cells is that of ``tiff.Layout``, so ranges of blocks are read the same way. Coordinate systems stay behind: their nodes
hold projections by name and parameters, for which there is no register here.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..operators.grid import BandError, Georef
from .tiff import NODATA, Block

#: Fixed values of the format: mark, numbers of pixel types, cells of a block's side, and the dictionary of node types.
MARK, SIDE = b"EHFA_HEADER_TAG\0", 64
KINDS = {3: "u1", 4: "i1", 5: "<u2", 6: "<i2", 7: "<u4", 8: "<i4", 9: "<f4", 10: "<f8"}
DICTIONARY = (
    "{1:lversion,1:LfreeList,1:LrootEntryPtr,1:sentryHeaderLength,1:LdictionaryPtr,}Ehfa_File,"
    "{1:Lnext,1:Lprev,1:Lparent,1:Lchild,1:Ldata,1:ldataSize,64:cname,32:ctype,1:tmodTime,}Ehfa_Entry,"
    "{16:clabel,1:LheaderPtr,}Ehfa_HeaderTag,"
    "{1:lwidth,1:lheight,1:e3:thematic,athematic,fft of real-valued data,layerType,1:e13:u1,u2,u4,u8,s8,u16,s16,u32,s32,f32,f64,c64,c128,pixelType,1:lblockWidth,1:lblockHeight,}Eimg_Layer,"
    "{1:sfileCode,1:Loffset,1:lsize,1:e2:false,true,logvalid,1:e2:no compression,ESRI GRID compression,compressionType,}Edms_VirtualBlockInfo,"
    "{1:lmin,1:lmax,}Edms_FreeIDList,"
    "{1:lnumvirtualblocks,1:lnumobjectsperblock,1:lnextobjectnum,1:e2:no compression,RLC compression,compressionType,0:poEdms_VirtualBlockInfo,blockinfo,0:poEdms_FreeIDList,freelist,1:tmodTime,}Edms_State,"
    "{1:dx,1:dy,}Eprj_Coordinate,{1:dwidth,1:dheight,}Eprj_Size,"
    "{0:pcproName,1:*oEprj_Coordinate,upperLeftCenter,1:*oEprj_Coordinate,lowerRightCenter,1:*oEprj_Size,pixelSize,0:pcunits,}Eprj_MapInfo,"
    "{1:*bvalueBD,}Eimg_NonInitializedValue,."
)


@dataclass
class Node:
    name: str
    kind: str
    data: bytes
    children: list[Node]


def _written(root: Node, at: int) -> bytes:
    """The entries and data of a tree, from place at on."""
    out: list[bytes] = []

    def put(node: Node, at: int, parent: int, prev: int, last: bool) -> int:
        data = node.data(at + 128) if callable(node.data) else node.data
        end = at + 128 + len(data)
        first = end if node.children else 0
        slot = len(out)
        out.append(b"")
        before, places = 0, []
        for k, child in enumerate(node.children):
            places.append(end)
            end = put(child, end, at, before, k == len(node.children) - 1)
            before = places[-1]
        out[slot] = struct.pack("<5Ii64s32sI4x", 0 if last else end, prev, parent, first, at + 128 if data else 0, len(data), node.name.encode(), node.kind.encode(), 0) + data
        return end

    put(root, at, 0, 0, True)
    return b"".join(out)


def encode(values: np.ndarray, row0: int = 0, col0: int = 0, geo: Georef = Georef()) -> bytes:
    """A file of one layer, with the place of its upper left corner."""
    number = next(k for k, v in KINDS.items() if np.dtype(v) == values.dtype.newbyteorder("<"))
    h, w = values.shape
    down, across = -(-h // SIDE), -(-w // SIDE)
    full = np.full((down * SIDE, across * SIDE), np.array(NODATA).astype(values.dtype))
    full[:h, :w] = values
    body = full.reshape(down, SIDE, across, SIDE).transpose(0, 2, 1, 3).astype(KINDS[number]).tobytes()
    size, n = len(body) // (down * across), down * across
    left, top = geo.x + col0 * geo.width, geo.y - row0 * geo.height

    def tree(first: int) -> Node:
        state = struct.pack("<iiiH", n, n, 0, 0) + struct.pack("<II", n, 0) + b"".join(struct.pack("<hIihh", 0, first + k * size, size, 1, 0) for k in range(n)) + struct.pack("<III", 0, 0, 0)
        corner = lambda at, x, y: struct.pack("<IIdd", 1, at + 8, x, y)

        def place(at: int) -> bytes:
            name, units = b"Unknown\0", b"meters\0"
            out = struct.pack("<II", len(name), at + 8) + name
            for x, y in ((left + geo.width / 2, top - geo.height / 2), (left + (w - 0.5) * geo.width, top - (h - 0.5) * geo.height), (geo.width, geo.height)):
                out += corner(at + len(out), x, y)
            return out + struct.pack("<II", len(units), at + len(out) + 8) + units

        def nothing(at: int) -> bytes:  # a table of one double
            return struct.pack("<IIiihhd", 1, at + 8, 1, 1, 10, 0, float(NODATA))

        layer = Node("Layer_1", "Eimg_Layer", struct.pack("<iiHHii", w, h, 1, number, SIDE, SIDE), [Node("RasterDMS", "Edms_State", state, []), Node("Eimg_NonInitializedValue", "Eimg_NonInitializedValue", nothing, []), Node("Map_Info", "Eprj_MapInfo", place, [])])
        return Node("root", "root", b"", [layer])

    start = 20 + 18
    words = DICTIONARY.encode() + b"\0"
    entries = start + len(words)
    length = len(_written(tree(0), entries))
    head = MARK + struct.pack("<I", 20) + struct.pack("<iIIhI", 1, 0, entries, 128, start)
    return b"".join([head, words, _written(tree(entries + length), entries), body])


def nodes(data, at: int) -> Iterator[Node]:
    """The nodes at a place and beside it, with what is below them."""
    while at:
        after, _, _, child, place, size, name, kind = struct.unpack("<5Ii64s32s", data[at : at + 120])
        text = lambda b: b.split(b"\0")[0].decode("latin-1")
        yield Node(text(name), text(kind), data[place : place + size] if place and size > 0 else b"", list(nodes(data, child)) if child else [])
        at = after


def unrun(raw: bytes, n: int, kind: np.dtype) -> np.ndarray:
    """The n values of a run-length block: their least, runs and their lengths, and values of some bits above the least."""
    least, runs, place, bits = struct.unpack_from("<iiiB", raw)
    several = runs != -1
    counts, at = [], 13
    for _ in range(runs if several else 0):
        more, count = raw[at] >> 6, raw[at] & 63
        for b in raw[at + 1 : at + 1 + more]:
            count = count << 8 | b
        counts.append(count)
        at += 1 + more
    held, m = raw[place if several else 13 :], len(counts) if several else n
    if bits == 0:
        found = np.zeros(m, np.int64)
    elif bits < 8:
        every = np.unpackbits(np.frombuffer(held, np.uint8), bitorder="little")[: m * bits].reshape(m, bits)
        found = (every.astype(np.int64) << np.arange(bits)).sum(axis=1)
    else:
        found = np.frombuffer(held, f">u{bits // 8}", m).astype(np.int64)
    found = found + least
    found = np.repeat(found, counts)[:n] if several else found
    return found.astype(np.uint32).view(np.float32) if kind.kind == "f" and kind.itemsize == 4 else found.astype(kind)


class Layout:
    """What the nodes of a file say of its blocks, as ``tiff.Layout`` does."""

    def __init__(self, data):
        (start,) = struct.unpack("<I", data[16:20])
        _, _, root, _, _ = struct.unpack("<iIIhI", data[start : start + 18])
        self.layers = [x for top in nodes(data, root) for x in top.children if x.kind == "Eimg_Layer"]
        if not self.layers:
            raise ValueError("no layer in the file")
        self.width, self.height = struct.unpack_from("<ii", self.layers[0].data)
        self.bands, self.nodata, self.geo, self.row0, self.col0 = len(self.layers), None, Georef(), 0, 0
        for node in self.layers[0].children:
            if node.kind == "Eprj_MapInfo":
                self._place(node.data)
            if node.kind == "Eimg_NonInitializedValue" and len(node.data) >= 28 and struct.unpack_from("<h", node.data, 16)[0] == 10:
                (self.nodata,) = struct.unpack_from("<d", node.data, 20)

    def _place(self, data: bytes) -> None:
        at = 8 + struct.unpack_from("<I", data)[0]
        (x, y), (width, height) = struct.unpack_from("<dd", data, at + 8), struct.unpack_from("<dd", data, at + 56)
        left, top = x - width / 2, y + height / 2
        near = lambda v: 0.0 if abs(v) < 1e-6 else v
        self.col0, self.row0 = int(np.floor(left / width + 1e-6)), int(np.floor(-top / height + 1e-6))
        self.geo = Georef(near(left - self.col0 * width), near(top + self.row0 * height), width, height)

    def blocks(self, band: int = 1) -> Iterator[Block]:
        if not 1 <= band <= self.bands:
            raise BandError(f"no band {band}: the file has {self.bands}")
        w, h, _, number, bw, bh = struct.unpack_from("<iiHHii", self.layers[band - 1].data)
        if number not in KINDS:
            raise ValueError(f"pixel type {number} is not read")
        self.kind = np.dtype(KINDS[number])
        state = next(x for x in self.layers[band - 1].children if x.kind == "Edms_State").data
        (n,) = struct.unpack_from("<I", state, 14)
        info = np.frombuffer(state, np.dtype([("file", "<i2"), ("at", "<u4"), ("size", "<i4"), ("valid", "<u2"), ("packed", "<u2")]), n, 22)
        across = -(-w // bw)
        self.packed = set(info["at"][info["packed"] == 1].tolist())
        for k in np.flatnonzero(info["valid"] == 1).tolist():
            yield Block(int(info["at"][k]), int(info["size"][k]), k // across * bh, k % across * bw, bh, bw)

    def values(self, raw: bytes, block: Block, band: int = 1) -> np.ndarray:
        n = block.rows * block.cols
        got = unrun(raw, n, self.kind) if block.at in self.packed else np.frombuffer(raw, self.kind, n)
        return got.reshape(block.rows, block.cols)[: max(0, self.height - block.row), : self.width - block.col]

    def there(self, values: np.ndarray) -> np.ndarray:
        some = ~np.isnan(values) if self.kind.kind == "f" else np.ones(values.shape, bool)
        return some if self.nodata is None else some & (values != np.array(self.nodata).astype(self.kind))
