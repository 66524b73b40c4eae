"""Settings files: key:value lines, typed getters with the number rules of C's atoi and atof, defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The keys that a settings file has, with their kinds.
KEYS = {
    "settingsFile": "string", "buildIndex": "bool", "tableCacheSize": "int", "rowCacheSize": "int", "originalCHM": "string", "originalCHMBand": "int", "smoothedCHM": "string", "smoothedCHMDriver": "string",
    "treetopsDatabase": "string", "treetopsDatabaseDriver": "string", "crownsRaster": "string", "crownsRasterDriver": "string", "crownsDatabase": "string", "crownsDatabaseDriver": "string",
    "doSmoothing": "bool", "smoothWindowSize": "int", "smoothSigma": "double", "doTops": "bool", "topsThresholds": "list", "topsMaxNulls": "double", "doCrowns": "bool", "crownsThresholds": "list",
    "crownsUpdateHeights": "bool", "crownsDoDatabase": "bool", "crownsRemoveHoles": "bool", "crownsRemoveDangles": "bool", "crownsKeepSmoothed": "bool",
}
INT, FLOAT = r"^\s*([+-]?\d+)", r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


PAIR, LONGEST = r"([^:]*):([^\n]*)\n", 1023


def parse(lines: DataFrame, by: Sequence[str] = (), longest: int | None = LONGEST) -> DataFrame:
    """(*by, key, value) of lines (*by, line_no, value): a key runs to the next colon and its value to the end of that line; the last one of a key wins.

    So a line without a colon becomes part of the key after it, and what follows the last value, if anything, is a key without a value; keys may be
    empty. A field of more than longest characters is cut there and ends the reading, as in the files that this is for; None: no limit. by names
    what tells files apart: each is read as one text of its own, so tables of many files spread over tasks.
    """
    by = list(by)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("value", F.lit("")).alias("v")))), lambda x: F.concat(x["v"], F.lit("\n"))), "")
    text = lines.groupBy(*by).agg(joined.alias("t"))
    found = F.arrays_zip(F.regexp_extract_all("t", F.lit(PAIR), 1).alias("k"), F.regexp_extract_all("t", F.lit(PAIR), 2).alias("v"))
    left = F.regexp_replace("t", PAIR, "")
    rest = F.when(left != "", F.array(F.struct(left.alias("k"), F.lit("").alias("v")))).otherwise(F.array())
    pairs = text.select(*by, F.concat(found, rest).alias("p"))
    if longest is None:
        pairs, key, value = pairs.select(*by, F.posexplode("p").alias("n", "x")), F.col("x.k"), F.col("x.v")
    else:
        pairs = pairs.withColumn("long", F.transform("p", lambda x: (F.length(x["k"]) > longest) | (F.length(x["v"]) > longest)))
        end = F.array_position("long", True)  # 0: none
        pairs = pairs.select(*by, F.posexplode(F.when(end > 0, F.slice("p", 1, end.cast("int"))).otherwise(F.col("p"))).alias("n", "x"))
        key, value = F.left("x.k", F.lit(longest)), F.when(F.length("x.k") > longest, F.lit("")).otherwise(F.left("x.v", F.lit(longest)))
    return pairs.select(*by, "n", key.alias("key"), value.alias("value")).groupBy(*by, "key").agg(F.max_by("value", "n").alias("value"))


def to_lines(pairs: DataFrame) -> DataFrame:
    return pairs.select(*(c for c in pairs.columns if c not in ("key", "value")), F.concat_ws(":", "key", F.coalesce("value", F.lit(""))).alias("line"))


def as_int(v: Column, default: Column | int = 0) -> Column:
    """Null (no such key): the default; no number at the front: 0; out of range: the nearest."""
    digits = F.regexp_extract(v, INT, 1)
    number = F.coalesce(digits.try_cast("double"), F.lit(0.0))
    held = F.least(F.greatest(number, F.lit(-2147483648.0)), F.lit(2147483647.0)).cast("int")
    return F.when(v.isNull(), F.lit(default) if isinstance(default, int) else default).otherwise(held)


def as_double(v: Column, default: Column | float = 0.0) -> Column:
    return F.when(v.isNull(), F.lit(default) if isinstance(default, float) else default).otherwise(F.coalesce(F.regexp_extract(v, FLOAT, 1).try_cast("double"), F.lit(0.0)))


def as_bool(v: Column, default: Column | bool = False) -> Column:
    return F.when(v.isNull(), F.lit(default) if isinstance(default, bool) else default).otherwise(F.substring(v, 1, 1).isin("t", "T", "1"))


def as_string(v: Column, default: Column | str = "") -> Column:
    return F.coalesce(v, F.lit(default) if isinstance(default, str) else default)


def load(pairs: DataFrame, current: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, key, value) for each known key of current (*by, key, value): a missing key keeps its value; by tells files apart.

    The two threshold lists are emptied where they are missing. settingsFile is never read.
    """
    at = [*by, "key"]
    new = pairs.select(*at, F.col("value").alias("_new"))
    lists = [k for k, kind in KEYS.items() if kind == "list"]
    got = F.when(F.col("key") == "settingsFile", F.col("value")).when(F.col("key").isin(lists), F.coalesce("_new", F.lit(""))).otherwise(F.coalesce("_new", "value"))
    return current.join(new, at, "left").select(*at, got.alias("value"))


def on_existing(pairs: DataFrame, current: DataFrame, defaults: DataFrame, choice: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, key, value) after a settings file that exists was named: "open" loads it over current, "reset" leaves it aside for the defaults."""
    if choice not in ("open", "reset"):
        raise ValueError("the choice is open or reset")
    return load(pairs, current, by) if choice == "open" else defaults.select(*by, "key", "value")


def save(config: DataFrame) -> DataFrame:
    """Lines of a typed config (one column a key, one row or more): bools as 0/1, doubles with six decimals."""

    def text(name: str, kind: str) -> Column:
        c = F.col(name)
        return {"bool": c.cast("int").cast("string"), "double": F.format_string("%.6f", c)}.get(kind, c.cast("string"))

    known = [(k, v) for k, v in KEYS.items() if k in config.columns]
    others = [c for c in config.columns if c not in KEYS]
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.coalesce(text(k, v), F.lit("")).alias("value")) for k, v in known)))
    return config.select(*others, pairs.alias("p")).select(*others, F.concat_ws(":", "p.key", "p.value").alias("line"))


def last_dir(path: Column) -> Column:
    """The parent of a path with a file name that has an extension, else the path."""
    return F.when(path.rlike(r"[^/]*\.[^/]*$"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(path)


def default_outputs(path: Column, driver: Column, default: str = "GTiff") -> Column:
    """Names made from the input's stem, and the driver, with the default for an empty one."""
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    named = [F.concat(stem, F.lit(x)).alias(n) for n, x in (("smoothed", "_smoothed.tif"), ("tops", "_tops.sqlite"), ("crowns_raster", "_crowns.tif"), ("crowns_database", "_crowns.sqlite"))]
    return F.struct(*named, F.coalesce(F.nullif(driver, F.lit("")), F.lit(default)).alias("driver"))


#: The drivers and the endings of their files.
DRIVERS = (("GTiff", "raster", ("tif", "tiff")), ("HFA", "raster", ("img",)), ("ESRI Shapefile", "vector", ("shp",)), ("SQLite", "vector", ("sqlite",)), ("PNG", "raster", ("png",)), ("GeoJSON", "vector", ("json",)))
#: The drivers that outputs may have.
OFFERED = {"raster": ("GTiff", "HFA"), "vector": ("ESRI Shapefile", "SQLite")}


def drivers(spark, kind: str) -> DataFrame:
    known = spark.createDataFrame([(n, k, e) for n, k, ends in DRIVERS for e in ends], "driver string, kind string, extension string")
    return known.where((F.col("kind") == kind) & F.col("driver").isin(*OFFERED[kind])).select("driver", "extension")


def driver_after(path: Column, driver: Column) -> Column:
    """The driver choice after a path changed: reset to empty unless the ending is one of the driver's."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    fits = [(driver == n) & ending.isin(*ends) for n, _, ends in DRIVERS]
    kept = fits[0]
    for f in fits[1:]:
        kept = kept | f
    return F.when(kept, driver).otherwise(F.lit(""))


RASTER_FILES, VECTOR_FILES = r"\.(tif|tiff|dat)$", r"\.(sqlite|shp)$"


def file_kind(path: Column) -> Column:
    return F.when(path.rlike(RASTER_FILES), "raster").when(path.rlike(VECTOR_FILES), "vector").otherwise("other")


def strip_prefix(text: Column) -> Column:
    """An error message without a leading library type; the blank after it stays."""
    return F.regexp_replace(text, r"^boost::\S*(?=\s)", "")
