"""Tree tops: cells that are highest in the window of their height class.

Cells are dealt to tiles with a halo of the largest half window, one shuffle whatever the windows and
classes; a tile's window maxima and counts are separable passes over its own small array, so neither
the raster's frame nor a long row has to fit in a task. ``windows`` gives the same figures by range
frames over the dense frame, built-in functions only; it needs three shuffles and is the cross-check.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import grid
from .grid import Frame, dense, known, tiled

#: (threshold in mm, window)
CLASSES = ((5000, 3), (12000, 5), (20000, 7))
TILE = 256


def by_height(z: Column, classes: Sequence[tuple], place: int = 1) -> Column:
    """What the class with the largest threshold not above z has at a place; null below all."""
    out = F.lit(None)
    for c in sorted(classes):
        out = F.when(z >= c[0], F.lit(c[place])).otherwise(out)
    return out


def height_class(cells: DataFrame, classes: Sequence[tuple[int, int]] = CLASSES, on: str = "z") -> DataFrame:
    return cells.withColumn("window", by_height(F.col(on), classes).cast("long")).where("window is not null")


def windows(cells: DataFrame, sizes: Sequence[int], on: str = "z") -> DataFrame:
    """The dense frame with top_<w> and n_<w>: greatest value and number of cells in the w x w window."""
    full = dense(cells)

    def frame(part: str, order: str, w: int):
        return W.partitionBy(part).orderBy(order).rangeBetween(-(w // 2), w // 2)

    sizes = sorted(set(sizes))
    full = full.select("*", *(F.max(on).over(frame("row", "col", w)).alias(f"top_{w}") for w in sizes), *(F.count(on).over(frame("row", "col", w)).alias(f"n_{w}") for w in sizes))
    kept = [c for c in full.columns if not c.startswith(("top_", "n_"))]
    return full.select(*kept, *(F.max(f"top_{w}").over(frame("col", "row", w)).alias(f"top_{w}") for w in sizes), *(F.sum(f"n_{w}").over(frame("col", "row", w)).alias(f"n_{w}") for w in sizes))


def _slide(a: np.ndarray, w: int, join, axes: tuple[int, ...] = (0, 1)) -> np.ndarray:
    """join over the w x w window around each cell of a, or along some axes; beyond the edge there is nothing."""
    for axis in axes:
        a = np.moveaxis(a, axis, 0)
        out = a.copy()
        for d in range(1, w // 2 + 1):
            join(out[d:], a[:-d], out=out[d:])
            join(out[:-d], a[d:], out=out[:-d])
        a = np.moveaxis(out, 0, axis)
    return a


def _earlier(a: np.ndarray, w: int) -> np.ndarray:
    """The greatest of a among the places of the w x w window that come before its centre, row by row."""
    out, rows = np.full_like(a, np.iinfo(np.int64).min), _slide(a, w, np.maximum, (1,))
    for d in range(1, w // 2 + 1):
        np.maximum(out[d:], rows[:-d], out=out[d:])
        np.maximum(out[:, d:], a[:, :-d], out=out[:, d:])
    return out


def candidates(cells: DataFrame, classes: Sequence[tuple[int, int]] = CLASSES, max_nulls: float | None = None, on: str = "z", tile: int = TILE, frame: Frame | None = None, settled: bool = False) -> DataFrame:
    """Cells that no cell of their class window exceeds, with window and n, the number of cells there.

    With a limit on nulls also cells and nulls: the window's places in the raster's frame (looked up unless it is given),
    and how many of them are empty. A null height is nodata; of doubled cells the highest counts. settled: of candidates of equal height the
    one with the lowest (row, col) stays, judged by the loser's window; a tile then has a halo of two half windows, so that it knows
    the candidates around its own.
    """
    cells = known(cells, on)
    if max_nulls is not None and frame is None:
        frame = grid.frame(cells) or Frame(0, 0, 0, 0)
    half = max(w for _, w in classes) // 2
    halo = 2 * half if settled else half
    tile = max(tile, 2 * halo)
    limits = np.array([t for t, _ in sorted(classes)])
    sizes = np.array([w for _, w in sorted(classes)], np.int64)
    limit = None if max_nulls is None else round(max_nulls * 1_000_000)
    more = ["window", "n"] + ([] if limit is None else ["cells", "nulls"])
    names = [*cells.columns, *more]
    schema = cells.select("*", *(F.lit(0).cast("long").alias(c) for c in more)).schema

    def find(t: pa.Table) -> pa.Table:
        r0, c0 = (t.column(c)[0].as_py() * tile - halo for c in ("tile_row", "tile_col"))
        t = t.sort_by([("row", "ascending"), ("col", "ascending"), (on, "descending")])
        row, col = (t.column(c).to_numpy() for c in ("row", "col"))
        once = np.r_[True, (row[1:] != row[:-1]) | (col[1:] != col[:-1])]
        t = t if once.all() else t.filter(pa.array(once))
        row, col, z = (t.column(c).to_numpy() for c in ("row", "col", on))
        row, col = row - r0, col - c0
        height = np.full((tile + 2 * halo,) * 2, np.iinfo(np.int64).min)
        there = np.zeros(height.shape, np.int64)
        height[row, col], there[row, col] = z, 1
        kind = np.searchsorted(limits, z, "right") - 1
        rim = halo - half if settled else halo  # candidates are looked for up to here
        seen = (kind >= 0) & (row >= rim) & (col >= rim) & (row < tile + 2 * halo - rim) & (col < tile + 2 * halo - rim)
        found, n = np.zeros(len(z), bool), np.zeros(len(z), np.int64)
        for w in np.unique(sizes).tolist():
            at = np.flatnonzero(seen & (sizes[kind] == w))
            at = at[_slide(height, w, np.maximum)[row[at], col[at]] == z[at]]
            found[at] = True
            n[at] = _slide(there, w, np.add)[row[at], col[at]]
        r = sizes[kind] // 2
        if limit is not None:
            y, x = row + r0, col + c0
            places = (np.minimum(y + r, frame.r_hi) - np.maximum(y - r, frame.r_lo) + 1) * (np.minimum(x + r, frame.c_hi) - np.maximum(x - r, frame.c_lo) + 1)
            found &= (places - n) * 1_000_000 <= limit * places
        if settled:
            rivals = np.full(height.shape, np.iinfo(np.int64).min)
            rivals[row[found], col[found]] = z[found]
            for w in np.unique(sizes).tolist():
                at = np.flatnonzero(found & (sizes[kind] == w))
                found[at] = _earlier(rivals, w)[row[at], col[at]] != z[at]
        found &= (row >= halo) & (col >= halo) & (row < halo + tile) & (col < halo + tile)
        some, extra = t.filter(pa.array(found)), [sizes[kind[found]], n[found]]
        if limit is not None:
            extra += [places[found], places[found] - n[found]]
        return pa.table([*(some.column(c) for c in cells_names), *map(pa.array, extra)], names=names)

    cells_names = cells.columns
    return tiled(cells, tile, halo).groupBy("tile_row", "tile_col").applyInArrow(find, schema)


def break_ties(found: DataFrame, classes: Sequence[tuple[int, int]] = CLASSES, on: str = "z") -> DataFrame:
    """Of candidates of equal height the one with the lowest (row, col) stays, judged by the loser's window: for candidates that come from elsewhere and as a cross-check, as ``candidates`` settles its own.

    Rivals meet by height and by square of the largest window, so no height gathers all its cells.
    """
    side = max(w for _, w in classes)
    square = lambda c: F.floor(F.col(c) / side)
    near = F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long")))
    rival = found.select(F.col(on).alias("_z"), F.col("row").alias("_row"), F.col("col").alias("_col"), square("row").alias("_r"), square("col").alias("_c"))
    rival = rival.withColumn("_d", near).withColumn("_r", F.col("_r") + F.col("_d")).withColumn("_d", near).withColumn("_c", F.col("_c") + F.col("_d")).drop("_d")
    r = F.expr("window div 2")
    beaten = (
        (F.col(on) == F.col("_z"))
        & (square("row") == F.col("_r"))
        & (square("col") == F.col("_c"))
        & (F.abs(F.col("row") - F.col("_row")) <= r)
        & (F.abs(F.col("col") - F.col("_col")) <= r)
        & (F.struct("_row", "_col") < F.struct("row", "col"))
    )
    return found.join(rival, beaten, "left_anti")


def points(found: DataFrame, n_cols: DataFrame | int | None = None) -> DataFrame:
    """Tops with a stable id, row * columns + col, and x, y of the cell's centre."""
    n = n_cols if n_cols is not None else found.agg((F.max("col") + 1).alias("n_cols"))
    x = (F.col("col") + 0.5).cast("double").alias("x")
    y = (F.col("row") + 0.5).cast("double").alias("y")
    wide = found.withColumn("n_cols", F.lit(n).cast("long")) if isinstance(n, int) else found.crossJoin(F.broadcast(n))
    return wide.select((F.col("row") * F.col("n_cols") + F.col("col")).alias("top_id"), "row", "col", x, y, *(c for c in found.columns if c not in ("row", "col")))


def n_cols(cells: DataFrame) -> DataFrame:
    """One row."""
    return cells.agg((F.max("col") + 1).alias("n_cols"))


def tops(cells: DataFrame, classes: Sequence[tuple[int, int]] = CLASSES, max_nulls: float | None = 0.2, on: str = "z", frame: Frame | None = None) -> DataFrame:
    """Tops of cells; with the frame of the raster at hand, cells are planned once."""
    found = candidates(cells, classes, max_nulls, on, frame=frame, settled=True)
    return points(found, n_cols(cells) if frame is None else frame.c_hi + 1)
