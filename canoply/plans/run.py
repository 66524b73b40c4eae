"""A run: the phases that a configuration turns on, one after the other, on tables or from file to file.

Each phase is written before the next one begins and is read again, so that progress is told and a wish to
cancel is asked for after work is done, and no phase is computed twice. A phase under way tells how far its jobs are, and
an event stops it: its jobs end and what it has begun to write goes. ``run`` hands on tables in the shared folder of the cluster, ``run_files`` the files of the configuration.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import Config
from ..operators import crowns, grid, polygons, smooth, tops
from ..sources import crs, geotiff, vector
from ..streaming.progress import Clock, Watch

class Cancelled(RuntimeError):
    """The run was cancelled before its last phase."""


@dataclass(frozen=True)
class Result:
    smoothed: DataFrame | None = None
    tops: DataFrame | None = None
    crowns: DataFrame | None = None
    shapes: DataFrame | None = None


def _mm(metres: float) -> int:
    return round(metres * 1000)


def _nothing(*_) -> None:
    return None


def shared(spark: SparkSession, tag: str) -> str:
    """A new folder name where the cluster shares files; without spark.checkpoint.dir in a temporary one if Spark runs on this machine alone."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="canoply-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/canoply-{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df written and read again."""
    path = shared(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@dataclass
class Callbacks:
    """What a run calls. cancelled: asked after each phase. told: share of phases done, and a message. step: share of the phase under way.

    stop, once set, ends the phase under way; tick: seconds between looks at its jobs.
    """

    cancelled: Callable[[], bool] = lambda: False
    told: Callable[[float, str], None] = _nothing
    step: Callable[[float, str], None] = _nothing
    stop: threading.Event | None = None
    tick: float = 0.2


class Phases:
    """Counts the phases of a run, tells their progress and end, and asks whether to go on."""

    def __init__(self, spark: SparkSession, config: Config, calls: Callbacks):
        self.all, self.done = sum([config.do_smoothing, config.do_tops, config.do_crowns]), 0
        self.spark, self.calls, self.stop = spark, calls, calls.stop or threading.Event()

    @contextmanager
    def phase(self, message: str, *outputs: str) -> Iterator[None]:
        """The block is one phase; outputs go if it is stopped."""
        try:
            with Watch(self.spark, message, lambda x: self.calls.step(x, message), self.stop, self.calls.tick):
                yield
        except Exception as e:
            if not self.stop.is_set():
                raise
            for path in outputs:
                if path:
                    remove(self.spark, path)
            raise Cancelled(message) from e
        self.done += 1
        self.calls.told(self.done / self.all, message)
        if self.done < self.all and (self.stop.is_set() or self.calls.cancelled()):
            raise Cancelled(message)


def find(config: Config, heights: DataFrame, frame: grid.Frame | None) -> DataFrame:
    return tops.tops(heights, [(_mm(t), w) for t, w in config.top_thresholds], config.max_nulls, on="zs", frame=frame)


def grown(config: Config, heights: DataFrame, found: DataFrame, geo: grid.Georef = grid.Georef()) -> DataFrame:
    """Crowns; the radii of config are in the units of the map, and cells must be square there."""
    if abs(abs(geo.width) - abs(geo.height)) > 1e-6 * abs(geo.width):
        raise ValueError("a radius needs square cells")
    classes = [(_mm(t), round(f * 100), r / abs(geo.width)) for t, f, r in config.crown_thresholds]
    return crowns.crowns(heights, found, classes, config.remove_dangles, on="zs")


def run(config: Config, chm: DataFrame, smoothed: DataFrame | None = None, found: DataFrame | None = None, cancelled: Callable[[], bool] = lambda: False, told: Callable[[float, str], None] = _nothing, calls: Callbacks | None = None) -> Result:
    """The results of config on chm (row, col, z in mm, and band if there are several).

    smoothed and found are what earlier runs made, for phases that are off. Thresholds are in metres, radii in cells.
    """
    config.check()
    chm = grid.known(grid.scan(chm, config.band))
    phases = Phases(chm.sparkSession, config, calls or Callbacks(cancelled, told))
    heights = smooth.phase(chm, smoothed, config.do_smoothing, config.window, config.sigma)
    if config.do_smoothing:
        with phases.phase("smoothed"):
            heights = kept(heights, "smoothed")
    if config.do_tops:
        with phases.phase("tops found"):
            found = kept(find(config, heights, grid.frame(heights)), "tops")
    owned = shapes = None
    if config.do_crowns:
        with phases.phase("crowns grown"):
            owned = kept(grown(config, heights, found), "crowns")
            if config.update_heights:
                found = crowns.update_heights(found, owned, chm, config.keep_smoothed)
            if config.polygons:
                shapes = kept(polygons.with_attributes(polygons.polygons(owned, config.remove_holes), found.select("top_id", F.col("z").alias("top_z"))), "shapes")
            owned = owned.drop("top_row", "top_col")
    return Result(heights if config.do_smoothing else None, found, owned, shapes)


_TOPS = "top_id long, row long, col long, z long, zs long"


def _write_raster(cells: DataFrame, name: str, kind: str, path: str, driver: str, geo: grid.Georef) -> None:
    geotiff.write(cells, path, name, kind, geo=geo, driver=driver)


def read_tops(spark: SparkSession, config: Config) -> DataFrame:
    """The tops that an earlier run wrote, by their driver."""
    if config.tops_driver == "SQLite":
        return vector.read_sqlite(spark, config.tops, "tops", _TOPS)
    names = {x.split()[0]: x.split()[1] for x in _TOPS.split(", ")}
    return vector.read_shapefile(spark, config.tops, names).drop("geom")


def run_files(spark: SparkSession, config: Config, cancelled: Callable[[], bool] = lambda: False, told: Callable[[float, str], None] = _nothing, clock: Callable[[float], None] = _nothing, limit: int = vector.SHAPEFILE_LIMIT, calls: Callbacks | None = None) -> Config:
    """A run from the canopy heights that config names to the files it names; gives config with the outputs as they came to be.

    Rasters are GeoTIFF or HFA mosaics in metres, a folder each; databases hold geometry on the map, and radii are in its units. A Shapefile that would pass the
    limit becomes SQLite, and if tops do, so do crowns. clock is told the seconds since the beginning, every second.
    """
    config.check_files()
    phases, geo = Phases(spark, config, calls or Callbacks(cancelled, told)), geotiff.placed(spark, config.original)
    with Clock(clock):
        if config.do_smoothing:
            with phases.phase("smoothed", config.smoothed):
                chm = geotiff.heights(spark, config.original, config.band)
                made = grid.to_float(smooth.gaussian(chm, config.window, config.sigma), "zs")
                _write_raster(made, "zs", "f4", config.smoothed, config.smoothed_driver, geo)
        over = False
        if config.do_tops:
            with phases.phase("tops found", config.tops, vector.as_sqlite(config.tops)):
                heights = _heights(spark, config)
                found = kept(find(config, heights, grid.frame(heights)), "tops")
                config, over = _write_tops(config, found, geo, limit)
        if config.do_crowns:
            outputs = [config.crowns_raster, *([config.crowns, vector.as_sqlite(config.crowns)] if config.polygons else [])]
            with phases.phase("crowns grown", *outputs):
                if not config.do_tops:
                    heights = _heights(spark, config)
                found = read_tops(spark, config)
                owned = kept(grown(config, heights, found, geo), "crowns")
                numbers = kept(crowns.numbered(owned), "numbers")
                raster = owned.join(numbers, "crown_id").select("row", "col", "crown_no")
                _write_raster(raster, "crown_no", "i4", config.crowns_raster, config.crowns_raster_driver, geo)
                if config.polygons:
                    updated = kept(crowns.update_heights(found, owned, heights.select("row", "col", "z"), config.keep_smoothed), "tops") if config.update_heights else found
                    shapes = polygons.with_attributes(polygons.polygons(owned, config.remove_holes, geo=geo).join(numbers, "crown_id"), updated.select("top_id", F.col("z").alias("top_z")))
                    columns = ["crown_id", "crown_no", "n_parts", "n_holes", "area", "perimeter", "top_z", "geom"]
                    shapes, size = vector.measured(shapes.select(columns))
                    shapes = kept(shapes, "shapes")
                    path, driver = vector.write(shapes, config.crowns, config.crowns_driver, "crowns", limit, crs.prj(geo), geo.epsg, over, size.get)
                    config = replace(config, crowns=path, crowns_driver=driver)
                if config.update_heights:  # last, as it replaces what an earlier phase has written
                    updated = updated if config.polygons else kept(crowns.update_heights(found, owned, heights.select("row", "col", "z"), config.keep_smoothed), "tops")
                    config, _ = _write_tops(config, updated, geo, limit)
    return config


def _heights(spark: SparkSession, config: Config) -> DataFrame:
    """Smoothed heights (zs), or the original ones if there are none, with the original ones (z) where there are any."""
    smoothed = geotiff.heights(spark, config.smoothed, 1, "zs") if config.smoothed else geotiff.heights(spark, config.original, config.band, "zs")
    heights = smoothed.join(geotiff.heights(spark, config.original, config.band), ["row", "col"], "left").withColumn("z", F.coalesce("z", "zs"))
    return kept(heights, "heights")


def _write_tops(config: Config, found: DataFrame, geo: grid.Georef, limit: int) -> tuple[Config, bool]:
    """config with the database of tops as it came to be, and whether it ran over."""
    zs = F.col("zs") if "zs" in found.columns else F.lit(None).cast("long").alias("zs")
    placed = geo.place(found)
    made = placed.select("top_id", "row", "col", "z", zs, vector.point_wkb(F.col("x"), F.col("y")).alias("geom"))
    path, driver = vector.write(made, config.tops, config.tops_driver, "tops", limit, crs.prj(geo), geo.epsg)
    return replace(config, tops=path, tops_driver=driver), driver != config.tops_driver
