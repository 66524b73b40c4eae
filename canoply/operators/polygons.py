"""Crown polygons: edges that no neighbour of the same crown shares, traced into rings, as WKB."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wkb
from .crowns import per_crown, placed, rooted
from .grid import Georef


def edges(owned: DataFrame) -> DataFrame:
    """(crown_id, y, x, side): boundary edges; side h runs from (y, x) to (y, x+1), v to (y+1, x).

    Each cell gives its four edges; one that two cells of a crown give lies inside.
    """

    def edge(dy: int, dx: int, side: str):
        return F.struct((F.col("row") + dy).alias("y"), (F.col("col") + dx).alias("x"), F.lit(side).alias("side"))

    four = F.explode(F.array(edge(0, 0, "h"), edge(1, 0, "h"), edge(0, 0, "v"), edge(0, 1, "v")))
    dealt = owned.select("crown_id", four.alias("e")).select("crown_id", "e.*")
    return dealt.groupBy("crown_id", "y", "x", "side").count().where("count = 1").drop("count")


#: Steps (x, y) of directed sides in rising order; after each its turns to keep to the same cell where cells touch only at a corner.
_STEPS = np.array([(-1, 0), (0, -1), (0, 1), (1, 0)])
_TURNS = np.array([[_STEPS.tolist().index([*t]) for t in ((dy, -dx), (dx, dy), (-dy, dx))] for dx, dy in _STEPS.tolist()])


def outlines(stack: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Closed rings around the masks of a stack (n, h, w) with a margin of one cell: the mask's number and corners (x, y), the first again at the end.

    Each cell has four directed sides with the cell on their left. A side's successor is looked up; rings are the cycles, told apart and
    ranked by pointer jumping. A ring begins at its least corner, and rings come by mask and first corner.
    """
    m = stack[:, 1:-1, 1:-1]
    sides = ((m & ~stack[:, :-2, 1:-1], (1, 0)), (m & ~stack[:, 1:-1, 2:], (1, 1)), (m & ~stack[:, 1:-1, :-2], (0, 0)), (m & ~stack[:, 2:, 1:-1], (0, 1)))  # top, right, left, bottom
    found = [(k, x + at[0], y + at[1], np.full(len(k), d)) for d, (inside, at) in enumerate(sides) for k, y, x in [np.nonzero(inside)]]
    k, x, y, d = (np.concatenate(c) for c in zip(*found))
    if not len(k):
        return []
    order = np.lexsort((d, y, x, k))
    k, x, y, d = k[order], x[order], y[order], d[order]
    each = np.arange(len(k))
    at = np.full((4, len(stack), m.shape[1] + 1, m.shape[2] + 1), -1)
    at[d, k, y, x] = each
    ends = k, y + _STEPS[d, 1], x + _STEPS[d, 0]
    after = np.full(len(k), -1)
    for turn in range(3):
        after = np.where(after < 0, at[(_TURNS[d, turn], *ends)], after)
    ring, hop = each, after
    while True:
        least = np.minimum(ring, ring[hop])
        if (least == ring).all() and (ring[after] == ring).all():
            break
        ring, hop = least, hop[hop]
    last = after == ring
    hop, left = np.where(last, each, after), (~last).astype(np.int64)  # sides up to the ring's last
    while (hop[hop] != hop).any():
        left, hop = left + left[hop], hop[hop]
    before = np.empty_like(after)
    before[after] = each
    corner = np.flatnonzero(d != d[before])
    corner = corner[np.lexsort((-left[corner], ring[corner]))]
    xy = np.column_stack([x, y])
    starts = np.flatnonzero(np.r_[True, ring[corner][1:] != ring[corner][:-1]])
    return [(int(k[c[0]]), xy[np.r_[c, c[:1]]]) for c in np.split(corner, starts[1:])]


def rings(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """The rings around one mask, as lists of corners."""
    return [list(map(tuple, ring.tolist())) for _, ring in outlines(mask[None])]


def area2(ring: np.ndarray) -> int:
    """Twice the signed area in raster coordinates; positive for outer rings here."""
    x, y = np.asarray(ring).T
    return int((x[1:] * y[:-1] - x[:-1] * y[1:]).sum())


def multipolygon(parts: list[list[np.ndarray]], geo: Georef | None = None) -> bytes:
    """Little-endian WKB of polygons, each an outer ring and its holes; on the map if geo is given."""
    corner, cell = ((geo.x, geo.y), (geo.width, -geo.height)) if geo else ((0.0, 0.0), (1.0, 1.0))
    out = [struct.pack("<BII", 1, 6, len(parts))]
    for polygon in parts:
        out.append(struct.pack("<BII", 1, 3, len(polygon)))
        for ring in polygon:
            out.append(struct.pack("<I", len(ring)))
            out.append((np.asarray(ring, "<f8") * cell + corner).tobytes())
    return b"".join(out)


def _holds(ring: np.ndarray, p: tuple[float, float]) -> bool:
    (x0, y0), y1 = ring[:-1].T, ring[1:, 1]
    return bool((((y0 > p[1]) != (y1 > p[1])) & (p[0] < x0)).sum() % 2)


def polygons(owned: DataFrame, remove_holes: bool = False, dangles: bool = False, geo: Georef | None = None) -> DataFrame:
    """crown_id, n_parts, n_holes, area, perimeter, geom for each crown, in cells or on the map that geo gives.

    dangles: crowns first lose what isn't connected to their tops, in the same pass (cells then have top_row and top_col).
    """
    wide, high = (geo.width, geo.height) if geo else (1.0, 1.0)
    schema = "crown_id long, n_parts long, n_holes long, area double, perimeter double, geom binary"

    def trace(stack, ids, row0, col0, rows):
        found = []
        stack = rooted(stack, ids, row0, col0, rows) if dangles else stack
        by_crown: list[list[np.ndarray]] = [[] for _ in ids]
        for k, ring in outlines(stack):
            by_crown[k].append(ring)
        for own, crown, r, c in zip(by_crown, ids.tolist(), (row0 + 1).tolist(), (col0 + 1).tolist(), strict=True):
            outer, holes = [], []
            for ring in own:
                ring = ring + (c, r)
                (outer if area2(ring) > 0 else holes).append(ring)
            parts = [[ring] for ring in outer]
            if not remove_holes:
                for hole in holes:
                    inner = hole[0][0] + 0.5, hole[0][1] + 0.5
                    owner = next((p for p in parts if _holds(p[0], inner)), parts[0])
                    owner.append(hole)
            area = sum(area2(ring) for p in parts for ring in p) / 2
            length = sum(np.abs(np.diff(ring, axis=0)).sum(axis=0) @ (wide, high) for p in parts for ring in p)
            found.append((crown, len(parts), sum(len(p) - 1 for p in parts), area * wide * high, float(length), multipolygon(parts, geo)))
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.table([pa.array(x) for x in zip(*found)], names=names)

    return per_crown(placed(owned), schema, trace)


def ring_texts(shapes: DataFrame) -> DataFrame:
    """(crown_id, ring) for each ring of shapes (crown_id, geom) in cells: its corners as "x y,x y", from the least on."""

    def told(it):
        for b in it:
            crown, text = [], []
            for k, geom in zip(b.column("crown_id").to_pylist(), b.column("geom").to_pylist(), strict=True):
                for ring in wkb.rings_of(geom):
                    crown.append(k)
                    text.append(",".join(f"{x:g} {y:g}" for x, y in ring.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(crown, pa.int64()), pa.array(text, pa.string())], names=["crown_id", "ring"])

    return shapes.select("crown_id", "geom").mapInArrow(told, "crown_id long, ring string")


def with_attributes(shapes: DataFrame, found: DataFrame) -> DataFrame:
    """Polygons with the attributes of their crown's top."""
    extra = [c for c in found.columns if c not in shapes.columns and c != "top_id"]
    return shapes.join(found.select(F.col("top_id").alias("crown_id"), *extra), "crown_id")
