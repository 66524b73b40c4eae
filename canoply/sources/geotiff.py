"""GeoTIFF and HFA files as Spark tables of cells.

A raster is written as a mosaic: one file for each tile, so no task holds more than one tile. Files are raw
bytes that Spark's text writer puts down, on any file system and under its commit protocol (the byte after the
last strip is no part of the image). Files are read by ranges of their blocks (``blocks``), so their size doesn't matter.
Cells are numbered from the coordinate origin, so the tiles of a mosaic fit together; what is left of a cell at the
corner is in the Georef.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Georef
from . import blocks, hfa
from .blocks import Window
from .tiff import DEFLATE, NODATA, PLAIN, Raster, decode, encode, fields, raster, unlzw

__all__ = ["DEFLATE", "NODATA", "PLAIN", "Raster", "Window", "decode", "encode", "fields", "heights", "placed", "raster", "read", "unlzw", "write"]


def write(cells: DataFrame, path: str, name: str, kind: str = "f4", tile: int = 512, mode: str = "overwrite", geo: Georef = Georef(), compression: int = DEFLATE, driver: str = "GTiff") -> None:
    """(row, col, name) as one file a tile; a null is nodata. driver: GTiff or HFA."""
    if driver not in ("GTiff", "HFA"):
        raise ValueError(f"no writer for {driver}")
    dealt = cells.select("row", "col", F.col(name).alias("v"), F.floor(F.col("row") / tile).alias("_r"), F.floor(F.col("col") / tile).alias("_c")).where("v is not null")

    def file(t: pa.Table) -> pa.Table:
        r0, c0 = t.column("_r")[0].as_py() * tile, t.column("_c")[0].as_py() * tile
        values = np.full((tile, tile), NODATA, np.dtype(kind))
        values[t.column("row").to_numpy() - r0, t.column("col").to_numpy() - c0] = t.column("v").to_numpy(zero_copy_only=False)
        data = hfa.encode(values, r0, c0, geo) if driver == "HFA" else encode(values, r0, c0, geo, compression)
        return pa.table({"value": pa.array([data], pa.binary())})

    raw = dealt.groupBy("_r", "_c").applyInArrow(file, "value binary").select(F.col("value").cast("string"))
    raw.write.mode(mode).option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def read(spark: SparkSession, path: str, band: int = 1, window: Window = Window(), task_bytes: int = blocks.TASK_BYTES) -> DataFrame:
    """(row, col, value double) of all files under path; nodata cells are missing. Of a window only the blocks that it meets are read."""
    return blocks.table(spark, path, "cells", band, task_bytes, window)


def heights(spark: SparkSession, path: str, band: int = 1, name: str = "z", window: Window = Window()) -> DataFrame:
    """(row, col, name): metres of a raster as whole millimetres."""
    return read(spark, path, band, window).select("row", "col", F.round(F.col("value") * 1000).cast("long").alias(name))


def placed(spark: SparkSession, path: str) -> Georef:
    """Where the grid of the files under path lies; they must agree. Only the heads of the files are read."""
    found = blocks.table(spark, path, "place").distinct().take(2)
    if len(found) > 1:
        raise ValueError("the files of a mosaic lie on different grids")
    return Georef(*(tuple(v) if isinstance(v, list) else v for v in found[0])) if found else Georef()
