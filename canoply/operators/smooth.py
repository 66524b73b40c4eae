"""Gaussian smoothing in fixed point.

Cells are dealt to tiles with a halo of half a window, one shuffle whatever the window; a tile adds weighted rows and
then columns of its small array, as the kernel is separable. Weights are whole numbers, and the result is renormalised
over the cells that exist.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import known, tiled

UNIT, TILE = 4096, 256


def kernel(window: int, sigma: float) -> list[tuple[int, int]]:
    """(offset, weight); sigma 0 is the identity."""
    if window < 3 or window % 2 == 0:
        raise ValueError("the window must be odd and at least 3")
    if sigma < 0:
        raise ValueError("sigma must not be negative")
    r = window // 2
    if sigma == 0:
        return [(0, UNIT)]
    found = [(d, round(math.exp(-d * d / (2 * sigma * sigma)) * UNIT)) for d in range(-r, r + 1)]
    return [(d, w) for d, w in found if w]


def _along(a: np.ndarray, weights: list[tuple[int, int]]) -> np.ndarray:
    """Weighted sums of rows of a; beyond the edge there is nothing."""
    out = np.zeros_like(a)
    for d, w in weights:
        if d < 0:
            out[-d:] += w * a[:d]
        else:
            out[: len(a) - d] += w * a[d:]
    return out


def gaussian(cells: DataFrame, window: int = 3, sigma: float = 0.8, tile: int = TILE) -> DataFrame:
    """(row, col, z, zs) for each cell of (row, col, z); a null z is nodata, and of doubled cells the greatest z counts."""
    weights = kernel(window, sigma)
    halo = max(abs(d) for d, _ in weights)
    tile = max(tile, 2 * halo)

    def smoothed(t: pa.Table) -> pa.Table:
        r0, c0 = (t.column(c)[0].as_py() * tile - halo for c in ("tile_row", "tile_col"))
        row, col, z = (t.column(c).to_numpy() for c in ("row", "col", "z"))
        side = tile + 2 * halo
        height, there = np.full((side, side), np.iinfo(np.int64).min), np.zeros((side, side), np.int64)
        np.maximum.at(height, (row - r0, col - c0), z)
        there[row - r0, col - c0] = 1
        own = there.astype(bool)
        height[~own] = 0
        num, den = (_along(_along(a, weights)[halo : halo + tile].T, weights)[halo : halo + tile].T for a in (height, there))
        r, c = np.nonzero(own[halo : halo + tile, halo : halo + tile])
        n, d = num[r, c], den[r, c]
        zs = np.where(n < 0, -(-n // d), n // d)  # towards zero
        return pa.table({"row": r + r0 + halo, "col": c + c0 + halo, "z": height[r + halo, c + halo], "zs": zs})

    dealt = tiled(known(cells).select(*(F.col(c).cast("long").alias(c) for c in ("row", "col", "z"))), tile, halo)
    return dealt.groupBy("tile_row", "tile_col").applyInArrow(smoothed, "row long, col long, z long, zs long")


def phase(chm: DataFrame, existing: DataFrame | None, do_smoothing: bool, window: int = 3, sigma: float = 0.8) -> DataFrame:
    """The smoothed raster: computed, or the one at hand if smoothing is off (else the heights themselves)."""
    if do_smoothing:
        return gaussian(chm, window, sigma)
    return existing if existing is not None else chm.withColumn("zs", F.col("z"))
