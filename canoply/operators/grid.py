"""Rasters as tables of cells (row, col, z): a missing cell is nodata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class BandError(ValueError):
    """The raster has no such band."""


@dataclass(frozen=True)
class Frame:
    """The bounds of a raster."""

    r_lo: int
    r_hi: int
    c_lo: int
    c_hi: int


@dataclass(frozen=True)
class Georef:
    """Where the grid lies: the corner of cell (0, 0), the size of a cell, and the coordinate system as GeoTIFF has it."""

    x: float = 0.0
    y: float = 0.0
    width: float = 1.0
    height: float = 1.0
    keys: tuple[int, ...] = ()
    doubles: tuple[float, ...] = ()
    names: str = ""

    @property
    def epsg(self) -> int | None:
        """The code of the coordinate system, projected or else geographic."""
        found = {k: v for k, at, n, v in zip(*(self.keys[i::4] for i in range(4)), strict=True) if at == 0}
        return found.get(3072) or found.get(2048)

    def xy(self, row: Column, col: Column) -> tuple[Column, Column]:
        return F.lit(self.x) + col * F.lit(self.width), F.lit(self.y) - row * F.lit(self.height)

    def place(self, points: DataFrame) -> DataFrame:
        """points (row, col) with x and y of the cell's centre on the map."""
        x, y = self.xy(F.col("row") + 0.5, F.col("col") + 0.5)
        return points.withColumns({"x": x, "y": y})


def frame(cells: DataFrame) -> Frame | None:
    """The bounds as numbers, so that later steps need no pass over the raster for them; None for an empty raster."""
    row = bounds(cells).first()
    return None if row.r_lo is None else Frame(*row)


def known(cells: DataFrame, on: str = "z") -> DataFrame:
    """The cells with a value: null is nodata as much as a missing cell."""
    return cells.where(F.col(on).isNotNull())


def scan(cells: DataFrame, band: int = 1) -> DataFrame:
    """One band of a raster; the filter reaches the file scan."""
    if not 1 <= band <= 999:
        raise BandError(f"band {band} is not from 1 to 999")
    return cells.where(F.col("band") == band).drop("band") if "band" in cells.columns else cells


def bounds(cells: DataFrame) -> DataFrame:
    """One row: r_lo, r_hi, c_lo, c_hi."""
    return cells.agg(F.min("row").alias("r_lo"), F.max("row").alias("r_hi"), F.min("col").alias("c_lo"), F.max("col").alias("c_hi"))


def dense(cells: DataFrame) -> DataFrame:
    """Every cell of the bounding frame, with z null where there is none, and the frame's bounds."""
    frame = bounds(cells).where("r_lo is not null").withColumn("row", F.explode(F.sequence("r_lo", "r_hi")))
    grid = frame.withColumn("col", F.explode(F.sequence("c_lo", "c_hi")))
    return grid.join(cells, ["row", "col"], "left")


def to_float(cells: DataFrame, name: str) -> DataFrame:
    """The form of the smoothed raster in files: metres as 32-bit floats."""
    return cells.select("row", "col", (F.col(name) / 1000).cast("float").alias(name))


def tiled(cells: DataFrame, tile: int, halo: int) -> DataFrame:
    """cells with tile_row, tile_col, once for each tile whose frame, widened by halo, holds the cell."""

    def around(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)))

    return cells.withColumn("tile_row", around("row")).withColumn("tile_col", around("col"))
