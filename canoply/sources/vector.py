"""Vector sinks: Spatialite databases and Shapefiles of points and polygons as raw bytes, and the choice between them by size.

Each partition of a table makes a database, or a Shapefile of four parts (.shp, .shx, .dbf, .prj where a coordinate
system is known). Tables are dealt to partitions of bounded bytes first, so no task holds more. Geometry travels as WKB in a column; databases
hold it in Spatialite's form, with its tables and an R*-tree. Sizes are those of the encoded records, summed while a table is written.
"""

from __future__ import annotations

import sqlite3
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.wkb import rings_of

#: Bytes that a Shapefile can hold, and of a point and its record.
SHAPEFILE_LIMIT, POINT_RECORD = 2 * 1000**3, 28
#: Bytes of geometry and attributes in a file that a task writes.
FILE_BYTES = 256 << 20


def point_wkt(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), F.format_string("%.1f", x), F.lit(" "), F.format_string("%.1f", y), F.lit(")"))


def format_after(n_records: Column, bytes_a_record: int, driver: Column, limit: int | Column = SHAPEFILE_LIMIT) -> Column:
    """The driver that a result of so many records gets: a Shapefile over the limit becomes SQLite."""
    return F.when((driver == "ESRI Shapefile") & (n_records * bytes_a_record > limit), F.lit("SQLite")).otherwise(driver)


def crowns_format(tops: Column, crowns: Column) -> Column:
    """If tops ran over, so do crowns."""
    return F.when((tops == "SQLite") & (crowns == "ESRI Shapefile"), F.lit("SQLite")).otherwise(crowns)


_SQL = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "string": "TEXT", "binary": "BLOB"}


def _raw(rows: DataFrame, path: str, mode: str) -> None:
    rows.select(F.col("value").cast("string")).write.mode(mode).option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def _polygon_places(wkb: bytes) -> list[int]:
    """Where the polygons of a multipolygon begin."""
    (n,), at, out = struct.unpack_from("<I", wkb, 5), 9, []
    for _ in range(n):
        out.append(at)
        (rings,) = struct.unpack_from("<I", wkb, at + 5)
        at += 9
        for _ in range(rings):
            at += 4 + 16 * struct.unpack_from("<I", wkb, at)[0]
    return out


def box_of(wkb: bytes) -> tuple[float, float, float, float]:
    """xmin, ymin, xmax, ymax of a point or multipolygon."""
    if wkb[1] == 1:
        return (*struct.unpack_from("<2d", wkb, 5),) * 2
    every = np.concatenate(rings_of(wkb))
    return (*every.min(axis=0).tolist(), *every.max(axis=0).tolist())


def to_spatialite(wkb: bytes, srid: int = 0) -> bytes:
    """A little-endian WKB point or multipolygon in Spatialite's form: marks, system and box before it, each part marked, an end."""
    body = bytearray(wkb[1:])
    for at in _polygon_places(wkb) if wkb[1] == 6 else []:
        body[at - 1] = 0x69
    return struct.pack("<BBi4dB", 0, 1, srid, *box_of(wkb), 0x7C) + bytes(body) + b"\xfe"


def from_spatialite(blob: bytes) -> bytes:
    """The WKB of what to_spatialite makes."""
    body = bytearray(b"\x01" + blob[39:-1])
    if body[1] == 6:
        (n,), at = struct.unpack_from("<I", body, 5), 9
        for _ in range(n):
            body[at] = 1
            (rings,) = struct.unpack_from("<I", body, at + 5)
            at += 9
            for _ in range(rings):
                at += 4 + 16 * struct.unpack_from("<I", body, at)[0]
    return bytes(body)


def _layer(db: sqlite3.Connection, table: str, kind: int, srid: int, srtext: str) -> None:
    """Spatialite's tables for the geometry of one table."""
    db.execute("CREATE TABLE spatial_ref_sys (srid INTEGER NOT NULL PRIMARY KEY, auth_name TEXT NOT NULL, auth_srid INTEGER NOT NULL, ref_sys_name TEXT, proj4text TEXT NOT NULL, srtext TEXT)")
    db.execute("CREATE TABLE geometry_columns (f_table_name TEXT NOT NULL, f_geometry_column TEXT NOT NULL, geometry_type INTEGER NOT NULL, coord_dimension INTEGER NOT NULL, srid INTEGER NOT NULL, spatial_index_enabled INTEGER NOT NULL, PRIMARY KEY (f_table_name, f_geometry_column))")
    db.execute("INSERT INTO spatial_ref_sys VALUES (?, ?, ?, ?, ?, ?)", (srid, "epsg" if srid else "NONE", srid, srtext.split('"')[1] if '"' in srtext else "", "", srtext))
    db.execute("INSERT INTO geometry_columns VALUES (?, 'geom', ?, 2, ?, 1)", (table, kind, srid))
    db.execute(f'CREATE VIRTUAL TABLE "idx_{table}_geom" USING rtree(pkid, xmin, xmax, ymin, ymax)')


def write_sqlite(df: DataFrame, path: str, table: str, mode: str = "overwrite", srid: int = 0, srtext: str = "") -> None:
    """One database file for each partition of df; a column geom (WKB) becomes a Spatialite layer. (SQLite ignores the byte after its last page.)"""
    names = df.columns
    kinds = [_SQL.get(t, "TEXT") for _, t in df.dtypes]
    layout = ", ".join(f'"{n}" {k}' for n, k in zip(names, kinds, strict=True))
    insert = f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(names))})'

    def file(it):
        db = sqlite3.connect(":memory:")
        db.execute(f'CREATE TABLE "{table}" ({layout})')
        layered, n = False, 0
        for b in it:
            columns = {c: b.column(c).to_pylist() for c in names}
            geom = columns.get("geom", [])
            first = next((g for g in geom if g is not None), None)
            if "geom" in columns and not layered and first is not None:
                _layer(db, table, first[1], srid, srtext)
                layered = True
            if "geom" in columns:
                columns["geom"] = [None if g is None else to_spatialite(g, srid) for g in geom]
            db.executemany(insert, zip(*columns.values(), strict=True))
            boxes = ((n + i + 1, box_of(g)) for i, g in enumerate(geom) if g is not None)
            if layered:
                db.executemany(f'INSERT INTO "idx_{table}_geom" VALUES (?, ?, ?, ?, ?)', ((i, x0, x1, y0, y1) for i, (x0, y0, x1, y1) in boxes))
            n += b.num_rows
        db.commit()
        yield pa.RecordBatch.from_arrays([pa.array([db.serialize()], pa.binary())], names=["value"])

    _raw(df.mapInArrow(file, "value binary"), path, mode)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """The rows of all database files under path; the geometry of a layer as WKB."""
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(it):
        for b in it:
            for x in b.column("content"):
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(x.as_buffer())[: x.as_buffer().size // 512 * 512])
                known = db.execute("SELECT count(*) FROM sqlite_master WHERE name = 'geometry_columns'").fetchone()[0]
                layers = {c for (c,) in db.execute("SELECT f_geometry_column FROM geometry_columns WHERE f_table_name = ?", (table,))} if known else set()
                found = db.execute(f'SELECT {", ".join(chr(34) + n + chr(34) for n in names)} FROM "{table}"')
                while got := found.fetchmany(1 << 15):
                    columns = [[None if v is None else from_spatialite(v) for v in c] if n in layers else c for n, c in zip(names, zip(*got, strict=True), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(rows, schema)


def point_wkb(x: Column, y: Column) -> Column:
    """Little-endian WKB of a point. Spark has no bytes of doubles, so a small Arrow function makes them."""

    @F.arrow_udf("binary")
    def made(x: pa.Array, y: pa.Array) -> pa.Array:
        rec = np.zeros(len(x), np.dtype([("order", "u1"), ("kind", "<u4"), ("xy", "<f8", 2)]))
        rec["order"], rec["kind"] = 1, 1
        rec["xy"] = np.column_stack([x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)])
        return pa.array([r.tobytes() for r in rec], pa.binary())

    return made(x, y)


def point_xy(geom: Column) -> tuple[Column, Column]:
    """x and y of WKB points."""

    @F.arrow_udf("array<double>")
    def taken(geom: pa.Array) -> pa.Array:
        xy = np.frombuffer(b"".join(g[5:21] for g in geom.to_pylist()), "<f8")
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(xy) + 1, 2, dtype=np.int32)), pa.array(xy))

    both = taken(geom)
    return both[0].alias("x"), both[1].alias("y")


def _signed(ring: np.ndarray) -> float:
    x, y = ring.T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def shp(shapes: list[bytes]) -> tuple[bytes, bytes]:
    """The .shp and .shx bytes of WKB points or multipolygons; outer rings run clockwise on the map, holes against it."""
    kind, records, boxes = 1, [], []
    for wkb in shapes:
        if wkb[1] == 1:
            xy = np.frombuffer(wkb, "<f8", 2, 5)
            records.append(struct.pack("<i", 1) + xy.tobytes())
            boxes.append((*xy, *xy))
        else:
            kind, rings = 5, rings_of(wkb)
            hole = [i > 0 for k in _rings_a_polygon(wkb) for i in range(k)]
            rings = [r[::-1] if (_signed(r) > 0) != h else r for r, h in zip(rings, hole, strict=True)]
            every = np.concatenate(rings)
            box = (*every.min(axis=0), *every.max(axis=0))
            starts = np.cumsum([0, *map(len, rings)])
            records.append(struct.pack("<i4d2i", 5, *box, len(rings), len(every)) + starts[:-1].astype("<i4").tobytes() + every.astype("<f8").tobytes())
            boxes.append(box)
    size = np.array([len(r) // 2 for r in records], np.int64)
    at = 50 + np.cumsum(size + 4) - size - 4
    b = np.array(boxes, float).reshape(-1, 4)
    box = (*b[:, :2].min(axis=0), *b[:, 2:].max(axis=0)) if len(b) else (0.0,) * 4

    def head(words: int) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i4d4d", 1000, kind, *box, 0, 0, 0, 0)

    body = b"".join(struct.pack(">2i", i + 1, n) + r for i, (n, r) in enumerate(zip(size.tolist(), records, strict=True)))
    index = np.column_stack([at, size]).astype(">i4").tobytes()
    return head(50 + len(body) // 2) + body, head(50 + 4 * len(records)) + index


def _rings_a_polygon(wkb: bytes) -> list[int]:
    (n,), at, out = struct.unpack_from("<I", wkb, 5), 9, []
    for _ in range(n):
        (k,) = struct.unpack_from("<I", wkb, at + 5)
        out.append(k)
        at += 9
        for _ in range(k):
            at += 4 + 16 * struct.unpack_from("<I", wkb, at)[0]
    return out


def dbf(columns: dict[str, list]) -> bytes:
    """The .dbf bytes of number columns, 18 digits wide; a fraction has six digits, a null is blank."""
    n = len(next(iter(columns.values()))) if columns else 0
    whole = {c: all(v is None or float(v).is_integer() for v in vs) for c, vs in columns.items()}
    out = [struct.pack("<4BIHH20x", 3, 124, 1, 1, n, 33 + 32 * len(columns), 1 + 18 * len(columns))]
    out += [struct.pack("<11scI2B14x", c[:10].encode(), b"N", 0, 18, 0 if whole[c] else 6) for c in columns]

    def text(c: str, v) -> bytes:
        told = b"" if v is None else b"%d" % int(v) if whole[c] else b"%.6f" % v
        if len(told) > 18:
            raise ValueError(f"{c}: {v} is wider than 18 digits")
        return told.rjust(18)

    body = [b" " + b"".join(text(c, v) for c, v in zip(columns, row, strict=True)) for row in zip(*columns.values(), strict=True)]
    return b"".join([*out, b"\r", *body, b"\x1a"])


def write_shapefile(shapes: DataFrame, path: str, attributes: tuple[str, ...] = ("top_id", "z"), mode: str = "overwrite", prj: str = "") -> None:
    """Shapes (geom as WKB, or x and y of points; attributes): a .shp, .shx and .dbf file for each partition with rows, in folders of these names; .prj if given."""
    if "geom" not in shapes.columns:
        shapes = shapes.withColumn("geom", point_wkb(F.col("x"), F.col("y")))

    def files(it):
        got = [b for b in it if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            parts = [*shp(t.column("geom").to_pylist()), dbf({c: t.column(c).to_pylist() for c in attributes}), prj.encode()]
            keep = 4 if prj else 3
            yield pa.RecordBatch.from_arrays([pa.array(["shp", "shx", "dbf", "prj"][:keep]), pa.array(parts[:keep], pa.binary())], names=["part", "value"])

    rows = shapes.select("geom", *attributes).mapInArrow(files, "part string, value binary")
    rows.select("part", F.col("value").cast("string")).write.mode(mode).partitionBy("part").option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def read_shapefile(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Geometry (WKB) and attributes of the Shapefiles under path; names: Spark type of each attribute, in the files' order."""

    def unpack(shp_: bytes, dbf_: bytes) -> list[tuple]:
        (n,), (top, width) = struct.unpack_from("<I", dbf_, 4), struct.unpack_from("<HH", dbf_, 8)
        rows, at = [], 100
        for i in range(n):
            words = struct.unpack_from(">i", shp_, at + 4)[0]
            rec = shp_[at + 8 : at + 8 + 2 * words]
            at += 8 + 2 * words
            line = dbf_[top + width * i + 1 : top + width * (i + 1)]
            values = [line[18 * k : 18 * k + 18].strip() for k in range(len(names))]
            rows.append((_wkb(rec), *(None if not v else float(v) if kind == "double" else int(v) for v, kind in zip(values, names.values(), strict=True))))
        return rows

    schema = "geom binary, " + ", ".join(f"{c} {k}" for c, k in names.items())
    kinds = [pa.binary(), *(pa.float64() if k == "double" else pa.int64() for k in names.values())]

    def rows(t: pa.Table) -> pa.Table:
        part = dict(zip(t.column("part").to_pylist(), t.column("content").to_pylist(), strict=True))
        got = unpack(part["shp"], part["dbf"]) if {"shp", "dbf"} <= set(part) else []
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*got, strict=True) if got else [[]] * len(kinds), kinds, strict=True)], names=["geom", *names])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    number = F.regexp_extract("path", "part-([0-9]+)-", 1)
    return files.select(number.alias("n"), F.regexp_extract("path", "part=([a-z]+)", 1).alias("part"), "content").groupBy("n").applyInArrow(rows, schema)


def _wkb(record: bytes) -> bytes:
    """A record of a .shp file as WKB; a ring that runs clockwise begins a polygon."""
    if struct.unpack_from("<i", record)[0] == 1:
        return struct.pack("<BI", 1, 1) + record[4:20]
    n, m = struct.unpack_from("<2i", record, 36)
    starts = [*np.frombuffer(record, "<i4", n, 44).tolist(), m]
    points = np.frombuffer(record, "<f8", 2 * m, 44 + 4 * n).reshape(-1, 2)
    parts: list[list[np.ndarray]] = []
    for i, j in zip(starts[:-1], starts[1:], strict=True):
        ring = points[i:j]
        if _signed(ring) < 0 or not parts:
            parts.append([ring])
        else:
            parts[-1].append(ring)
    out = [struct.pack("<BII", 1, 6, len(parts))]
    for p in parts:
        out.append(struct.pack("<BII", 1, 3, len(p)))
        out += [struct.pack("<I", len(r)) + r.tobytes() for r in p]
    return b"".join(out)


def shp_record(geom: Column) -> Column:
    """Bytes of a record of a .shp file for a WKB point or multipolygon: of the latter, WKB without the heads of its polygons, and a box."""
    count = F.conv(F.hex(F.concat(*(F.substring(geom, k, 1) for k in (9, 8, 7, 6)))), 16, 10).cast("long")
    return F.when(F.substring(geom, 2, 1) == F.lit(b"\x01"), F.lit(POINT_RECORD)).otherwise(43 + F.length(geom) - 9 * count)


def measured(df: DataFrame) -> tuple[DataFrame, Observation]:
    """df, and what is observed while it is written: n records and their bytes in a .shp and a .dbf file."""
    seen = Observation()
    wide = 1 + 18 * (len(df.columns) - 1)
    return df.observe(seen, F.count("*").alias("n"), F.coalesce(F.sum(shp_record(F.col("geom"))), F.lit(0)).alias("shp"), (F.count("*") * wide).alias("dbf")), seen


def write(df: DataFrame, path: str, driver: str, table: str, limit: int = SHAPEFILE_LIMIT, prj: str = "", epsg: int | None = None, over: bool = False, size: dict | None = None, file_bytes: int = FILE_BYTES) -> tuple[str, str]:
    """df (geom as WKB and attributes) by its driver; a Shapefile of which a file would pass the limit becomes SQLite. over: an output before it did.

    size is what ``measured`` observed (looked up unless it is given). Gives path and driver as they came to be; the ending follows the driver.
    """
    if size is None:
        seen_df, seen = measured(df)
        seen_df.write.format("noop").mode("overwrite").save()
        size = seen.get
    heads = 100, 34 + 32 * (len(df.columns) - 1)
    if driver == "ESRI Shapefile" and (over or max(size["shp"] + heads[0], size["dbf"] + heads[1]) > limit):
        driver, path = "SQLite", as_sqlite(path)
    files = -(-(size["shp"] + size["dbf"]) // file_bytes)
    if files > 1:
        df = df.repartition(files)
    if driver == "SQLite":
        write_sqlite(df.withColumn("srid", F.lit(epsg).cast("long")) if epsg else df, path, table, srid=epsg or 0, srtext=prj)
    elif driver == "ESRI Shapefile":
        write_shapefile(df, path, tuple(c for c in df.columns if c != "geom"), prj=prj)
    else:
        raise ValueError(f"no writer for {driver}")
    return path, driver


def as_sqlite(path: str) -> str:
    """The path of a Shapefile that becomes a database."""
    return path.removesuffix(".shp") + ".sqlite" if path else path
