"""The configuration of a run: an immutable record, read from and written to settings files."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import settings


class InvalidConfig(ValueError):
    """A phase lacks an input, an output or valid thresholds."""


@dataclass(frozen=True)
class Config:
    settings_file: str = ""
    build_index: bool = False
    table_cache: int = 0
    row_cache: int = 0
    original: str = ""
    band: int = 1
    smoothed: str = ""
    smoothed_driver: str = "GTiff"
    tops: str = ""
    tops_driver: str = "SQLite"
    crowns_raster: str = ""
    crowns_raster_driver: str = "GTiff"
    crowns: str = ""
    crowns_driver: str = "SQLite"
    do_smoothing: bool = False
    window: int = 3
    sigma: float = 0.8
    do_tops: bool = False
    top_thresholds: tuple[tuple[float, int], ...] = ()
    max_nulls: float = 0.2
    do_crowns: bool = False
    crown_thresholds: tuple[tuple[float, float, float], ...] = ()
    update_heights: bool = False
    polygons: bool = False
    remove_holes: bool = False
    remove_dangles: bool = False
    keep_smoothed: bool = False

    def check(self) -> None:
        """Raise InvalidConfig if this can't run."""
        if not (self.do_smoothing or self.do_tops or self.do_crowns):
            raise InvalidConfig("no phase is on")
        if not 1 <= self.band <= 999:
            raise InvalidConfig("the band must be from 1 to 999")
        if not self.original:
            raise InvalidConfig("no canopy heights are named")
        if self.do_smoothing and (self.window < 3 or self.window % 2 == 0 or not 0 <= self.sigma <= 100):
            raise InvalidConfig("the smoothing window must be odd and at least 3, sigma from 0 to 100")
        if self.do_tops and not (self.top_thresholds and all(t > 0 and w >= 3 and w % 2 for t, w in self.top_thresholds)):
            raise InvalidConfig("the thresholds of tops are not valid")
        if self.do_crowns and not (self.crown_thresholds and all(min(x) > 0 and x[1] <= 1 for x in self.crown_thresholds)):
            raise InvalidConfig("the thresholds of crowns are not valid")
        if self.do_crowns and not (self.do_tops or self.tops):
            raise InvalidConfig("crowns need tops")

    def check_files(self) -> None:
        """Raise InvalidConfig if a phase of a run over files lacks a file: the rule of phases.can_run, and polygons need a database."""
        self.check()
        missing = [
            (self.do_smoothing or self.do_tops) and not self.smoothed and "the smoothed raster",
            (self.do_tops or self.do_crowns) and not self.tops and "the database of tops",
            self.do_crowns and not self.crowns_raster and "the raster of crowns",
            self.do_crowns and self.polygons and not self.crowns and "the database of crowns",
        ]
        if any(missing):
            raise InvalidConfig("not named: " + ", ".join(m for m in missing if m))


#: The key of each field in settings files.
FIELD_KEYS = {
    "settings_file": "settingsFile", "build_index": "buildIndex", "table_cache": "tableCacheSize", "row_cache": "rowCacheSize",
    "original": "originalCHM", "band": "originalCHMBand", "smoothed": "smoothedCHM", "smoothed_driver": "smoothedCHMDriver", "tops": "treetopsDatabase", "tops_driver": "treetopsDatabaseDriver", "crowns_raster": "crownsRaster",
    "crowns_raster_driver": "crownsRasterDriver", "crowns": "crownsDatabase", "crowns_driver": "crownsDatabaseDriver", "do_smoothing": "doSmoothing", "window": "smoothWindowSize", "sigma": "smoothSigma", "do_tops": "doTops",
    "top_thresholds": "topsThresholds", "max_nulls": "topsMaxNulls", "do_crowns": "doCrowns", "crown_thresholds": "crownsThresholds", "update_heights": "crownsUpdateHeights", "polygons": "crownsDoDatabase",
    "remove_holes": "crownsRemoveHoles", "remove_dangles": "crownsRemoveDangles", "keep_smoothed": "crownsKeepSmoothed",
}


def _records(text: str, size: int) -> tuple:
    numbers = []
    for part in text.split(","):
        try:
            numbers.append(float(part))
        except ValueError:
            break
    return tuple(tuple(numbers[i : i + size]) for i in range(0, len(numbers) // size * size, size))


def _number(text: str, pattern: str) -> float:
    found = re.match(pattern, text)
    return float(found[1]) if found else 0.0


def updated(config: Config, pairs: dict[str, str]) -> Config:
    """config with the values of a settings file; a missing list is emptied, other missing keys change nothing."""
    new: dict = {}
    for f in fields(Config):
        text = pairs.get(FIELD_KEYS[f.name])
        if f.name == "settings_file":  # the file doesn't rename itself
            continue
        if f.name.endswith("thresholds"):
            records = _records(text or "", 2 if f.name == "top_thresholds" else 3)
            new[f.name] = tuple((t, int(w)) for t, w in records) if f.name == "top_thresholds" else records
        elif text is not None:
            kind = type(f.default)
            new[f.name] = {str: lambda t: t, bool: lambda t: t[:1] in ("t", "T", "1"), int: lambda t: int(_number(t, settings.INT)), float: lambda t: _number(t, settings.FLOAT)}[kind](text)
    return replace(config, **new)


def read(spark: SparkSession, path: str, current: Config = Config(), on_existing: str = "open") -> Config:
    """The configuration in a settings file; ``reset`` leaves the file's values aside."""
    if on_existing not in ("open", "reset"):
        raise ValueError("on_existing is open or reset")
    if on_existing == "reset":
        return Config()
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    return updated(current, {r.key: r.value for r in settings.parse(lines).where(F.col("key").isin(*FIELD_KEYS.values())).collect()})  # known keys only


def lines(spark: SparkSession, config: Config) -> DataFrame:
    """The settings file of config, one line a row."""

    def text(value) -> str:
        if isinstance(value, bool):
            return str(int(value))
        if isinstance(value, float):
            return f"{value:.6f}"
        if isinstance(value, tuple):
            return ",".join(f"{x:g}" for record in value for x in record)
        return str(value)

    return spark.createDataFrame([(f"{FIELD_KEYS[f.name]}:{text(getattr(config, f.name))}",) for f in fields(Config)], "line string")
