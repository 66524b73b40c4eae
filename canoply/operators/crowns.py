"""Tree crowns: a bounded flood fill from every top, one owner a cell, and what follows from it.

Fills ignore each other, so a fill needs only the cells within its radius: cells are dealt to tiles
with a halo of the largest radius, and each tile fills its own tops in one stack of small windows. That
is one shuffle, whatever the radius; growing by joins would take a shuffle a ring. Overlaps are settled
by an aggregation over cells.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grid import known, tiled
from .tops import by_height

#: (least height in mm, fraction in percent, radius in cells)
CLASSES = ((5000, 50, 3), (12000, 55, 4), (20000, 60, 5))
TILE = 64
_STACK = 1 << 22  # cells of windows that are filled at once


def crown_class(found: DataFrame, classes: Sequence[tuple] = CLASSES, on: str = "z") -> DataFrame:
    """tops with fraction and radius of the class of their height; tops below all classes go."""
    z = F.col(on)
    return found.withColumn("fraction", by_height(z, classes, 1).cast("long")).withColumn("radius", by_height(z, classes, 2).cast("double")).where("radius is not null")


def grow(inside: np.ndarray, seed: np.ndarray, corners: bool = False) -> np.ndarray:
    """Of a stack of masks (n, h, w) the cells that a 4-connected path inside joins to the seed (8-connected: corners).

    Runs of cells in a row that touch runs in the next row are linked, and components of runs are found by pointer jumping, so
    the work follows the number of runs and not the length of paths.
    """
    n, h, w = inside.shape
    wide = w + 1  # a column between rows keeps runs apart
    flat = np.zeros((n * h, wide), np.int8)
    flat[:, :w] = inside.reshape(n * h, w)
    flat = flat.ravel()
    turns = np.diff(np.r_[np.int8(0), flat])
    start, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    reach = int(corners)
    lo, hi = np.searchsorted(end, start + wide - reach, "right"), np.searchsorted(start, end + wide + reach, "left")
    hi = np.where(start // wide % h == h - 1, lo, np.maximum(lo, hi))  # the last row of a mask touches no other
    a = np.repeat(np.arange(len(start)), hi - lo)
    b = np.arange(len(a)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    label = np.arange(len(start))
    while True:
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    k, r, c = np.nonzero(seed & inside)
    sown = np.zeros(len(start), bool)
    sown[label[np.searchsorted(start, (k * h + r) * wide + c, "right") - 1]] = True
    live = sown[label]
    steps = np.zeros(len(flat) + 1, np.int8)
    steps[start[live]] += 1
    steps[end[live]] -= 1
    return np.cumsum(steps[:-1], dtype=np.int8).reshape(n, h, wide)[:, :, :w].astype(bool)


def _grid(t: pa.Table, names: Sequence[str]):
    return [t.column(c).to_numpy(zero_copy_only=False) for c in names]


def flood(cells: DataFrame, classed: DataFrame, tile: int = TILE, on: str = "z", radius: float | None = None) -> DataFrame:
    """(top_id, row, col, cell_z, top_z, d2, top_row, top_col) for every cell that joins a top's crown.

    A cell joins if it is 4-connected to the top by cells from fraction times the top's height to that
    height, all within the radius. classed has top_id, row, col, fraction, radius and the height; radius is
    the largest there, and found by a query of its own if it isn't given.
    """
    halo = int(-(-(classed.agg(F.max("radius")).first()[0] or 0 if radius is None else radius) // 1))
    tile = max(tile, halo)
    dealt = tiled(known(cells, on).select("row", "col", F.col(on).alias("z")), tile, halo)
    own = classed.select("top_id", "row", "col", F.col(on).alias("z"), "fraction", "radius", F.floor(F.col("row") / tile).alias("tile_row"), F.floor(F.col("col") / tile).alias("tile_col"))
    schema = "top_id long, row long, col long, cell_z long, top_z long, d2 long, top_row long, top_col long"

    def fill(tops: pa.Table, near: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in schema.split(", ")]
        parts: list[tuple] = []
        if tops.num_rows and near.num_rows:
            row0, col0 = tops.column("tile_row")[0].as_py() * tile - halo, tops.column("tile_col")[0].as_py() * tile - halo
            side = tile + 2 * halo
            height = np.full((side + 2 * halo, side + 2 * halo), np.iinfo(np.int64).min)  # windows never run over
            r, c, z = _grid(near, ("row", "col", "z"))
            height[r - row0 + halo, c - col0 + halo] = z
            ids, tr, tc, tz, fraction, radius = _grid(tops, ("top_id", "row", "col", "z", "fraction", "radius"))
            offset = np.arange(-halo, halo + 1)
            d2 = offset[:, None] ** 2 + offset[None, :] ** 2
            step = max(1, _STACK // d2.size)
            for i in range(0, len(ids), step):
                at = slice(i, i + step)
                rr = (tr[at] - row0 + halo)[:, None, None] + offset[None, :, None]
                cc = (tc[at] - col0 + halo)[:, None, None] + offset[None, None, :]
                h = height[rr, cc]
                top = tz[at][:, None, None]
                low = -(-(fraction[at] * tz[at]) // 100)[:, None, None]
                inside = (h >= low) & (h <= top) & (d2[None] <= (radius[at] ** 2)[:, None, None]) & (h != np.iinfo(np.int64).min)
                k, y, x = np.nonzero(grow(inside, np.broadcast_to(d2 == 0, inside.shape)))
                parts.append((ids[at][k], tr[at][k] + offset[y], tc[at][k] + offset[x], h[k, y, x], tz[at][k], d2[y, x], tr[at][k], tc[at][k]))
        cols = [np.concatenate(p) for p in zip(*parts)] if parts else [np.empty(0, np.int64)] * 8
        return pa.table([pa.array(c.astype(np.int64)) for c in cols], names=names)

    keys = ("tile_row", "tile_col")
    return own.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(fill, schema)


def owners(filled: DataFrame) -> DataFrame:
    """(row, col, crown_id, z, d2, top_row, top_col): the nearest top owns a cell, then the taller, then the lower id."""
    best = F.min(F.struct("d2", (-F.col("top_z")).alias("t"), "top_id", "cell_z", "top_row", "top_col")).alias("b")
    return filled.groupBy("row", "col").agg(best).select("row", "col", F.col("b.top_id").alias("crown_id"), F.col("b.cell_z").alias("z"), "b.d2", "b.top_row", "b.top_col")


def placed(owned: DataFrame) -> DataFrame:
    """The columns that tell crowns and their places."""
    return owned.select("crown_id", "row", "col", *(c for c in ("top_row", "top_col") if c in owned.columns))


def per_crown(cells: DataFrame, schema, work, tile: int = TILE) -> DataFrame:
    """work(stack, ids, row0, col0, rows) for groups of whole crowns that lie near each other.

    stack is (n, h, w) of masks with a margin of one cell, rows the table in the crowns' order. Crowns go to the tile of
    their top where cells have top_row and top_col, else of their corner.
    """
    if {"top_row", "top_col"} <= set(cells.columns):
        dealt = cells.withColumns({"_r": F.floor(F.col("top_row") / tile), "_c": F.floor(F.col("top_col") / tile)})
    else:
        dealt = cells.join(cells.groupBy("crown_id").agg(F.floor(F.min("row") / tile).alias("_r"), F.floor(F.min("col") / tile).alias("_c")), "crown_id")

    def group(t: pa.Table) -> pa.Table:
        t = t.sort_by([("crown_id", "ascending"), ("row", "ascending"), ("col", "ascending")])
        ids, r, c = _grid(t, ("crown_id", "row", "col"))
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        n = np.diff(np.r_[first, len(ids)])
        k = np.repeat(np.arange(len(first)), n)
        row0, col0 = np.minimum.reduceat(r, first) - 1, np.minimum.reduceat(c, first) - 1
        height, width = (r - row0[k]).max() + 2, (c - col0[k]).max() + 2
        out, step = [], max(1, _STACK // int(height * width))
        for i in range(0, len(first), step):
            some = np.flatnonzero((k >= i) & (k < i + step))
            stack = np.zeros((min(step, len(first) - i), height, width), bool)
            stack[k[some] - i, (r - row0[k])[some], (c - col0[k])[some]] = True
            out.append(work(stack, ids[first[i : i + step]], row0[i : i + step], col0[i : i + step], t.take(pa.array(some))))
        return pa.concat_tables(out)

    return dealt.groupBy("_r", "_c").applyInArrow(group, schema)


def rooted(stack: np.ndarray, ids: np.ndarray, row0: np.ndarray, col0: np.ndarray, rows: pa.Table) -> np.ndarray:
    """Of a stack of crowns what is 4-connected to their tops; rows have top_row and top_col."""
    crown, r, c = _grid(rows, ("crown_id", "top_row", "top_col"))
    first = np.searchsorted(crown, ids)
    seeds = np.zeros_like(stack)
    y, x = r[first] - row0, c[first] - col0
    k = np.flatnonzero((y >= 0) & (x >= 0) & (y < stack.shape[1]) & (x < stack.shape[2]))
    seeds[k, y[k], x[k]] = True
    return grow(stack, seeds)


def remove_dangles(owned: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The cells of owned that are 4-connected to their crown's top inside the crown; found has the tops of crowns whose cells don't name them."""
    marked = owned
    if "top_row" not in owned.columns:
        marked = owned.join(found.select(F.col("top_id").alias("crown_id"), F.col("row").alias("top_row"), F.col("col").alias("top_col")), "crown_id")
    names = owned.columns

    def keep(stack, ids, row0, col0, rows):
        r, c, crown = _grid(rows, ("row", "col", "crown_id"))
        k = np.searchsorted(ids, crown)
        return rows.filter(pa.array(rooted(stack, ids, row0, col0, rows)[k, r - row0[k], c - col0[k]])).select(names)

    return per_crown(marked, owned.schema, keep)


def fill_holes(owned: DataFrame, dangles: bool = False) -> DataFrame:
    """(crown_id, row, col): the cells of each crown and of the holes that it closes in; dangles: remove these first, in the same pass.

    Background joins over corners too, as crowns do only over edges.
    """

    def fill(stack, ids, row0, col0, rows):
        stack = rooted(stack, ids, row0, col0, rows) if dangles else stack
        frame = np.zeros_like(stack)
        frame[:, [0, -1], :] = frame[:, :, [0, -1]] = True
        outside = grow(~stack, frame & ~stack, corners=True)
        k, y, x = np.nonzero(~outside)
        return pa.table({"crown_id": ids[k], "row": row0[k] + y, "col": col0[k] + x})

    return per_crown(placed(owned), "crown_id long, row long, col long", fill)


def zonal(owned: DataFrame) -> DataFrame:
    return owned.groupBy("crown_id").agg(F.count("*").alias("n_cells"), F.max("z").alias("max_z"), F.min("z").alias("min_z"), F.sum("z").alias("sum_z"))


def update_heights(found: DataFrame, owned: DataFrame, chm: DataFrame, keep_smoothed: bool = True) -> DataFrame:
    """tops with z from the original heights: the greatest in the crown; their own where there is no crown."""
    original = owned.select("row", "col", "crown_id").join(chm.select("row", "col", F.col("z").alias("_z")), ["row", "col"])
    most = original.groupBy(F.col("crown_id").alias("_c")).agg(F.max("_z").alias("_most"))
    out = found.join(most, F.col("top_id") == F.col("_c"), "left").withColumn("z", F.coalesce("_most", "z")).drop("_c", "_most")
    return out if keep_smoothed else out.drop("zs")


def numbered(owned: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(crown_id, crown_no): the crowns counted from 1 by rising id, for files of 32-bit numbers. Blocks of ids are counted first, then each block alone."""
    ids = owned.select("crown_id").distinct().withColumn("_b", F.floor(F.col("crown_id") / block))
    counts = ids.groupBy("_b").count()
    before = counts.select(F.col("_b").alias("_k"), F.coalesce(F.sum("count").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_n"))
    nth = F.row_number().over(W.partitionBy("_b").orderBy("crown_id"))
    return ids.join(before, F.col("_b") == F.col("_k")).select("crown_id", (F.col("_n") + nth).cast("int").alias("crown_no"))


def raster_i32(owned: DataFrame) -> DataFrame:
    """Crowns as a raster of 32-bit numbers, whatever the size of their ids: (row, col, crown_no)."""
    return owned.select("row", "col", "crown_id").join(numbered(owned), "crown_id").select("row", "col", "crown_no")


def crowns(cells: DataFrame, found: DataFrame, classes: Sequence[tuple] = CLASSES, dangles: bool = True, on: str = "z") -> DataFrame:
    """(row, col, crown_id, z, d2) from tops on cells; dangles are removed if asked for."""
    owned = owners(flood(cells, crown_class(found, classes, on), on=on, radius=max(c[2] for c in classes)))
    return remove_dangles(owned, found) if dangles else owned
