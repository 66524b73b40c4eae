"""Runs from file to file, GeoTIFF forms, Shapefiles and databases."""

from __future__ import annotations

import sqlite3
import struct
import threading
import time
import zlib
from dataclasses import replace

import numpy as np
import pytest
from test_run import FULL

from canoply.operators import crowns, grid, polygons, smooth, tops
from canoply.plans import fixtures
from canoply.plans.run import Callbacks, Cancelled, read_tops, run, run_files
from canoply.sources import geotiff, vector

GEO = grid.Georef(0.25, -0.5, 2.0, 2.0, (1, 1, 0, 1, 3072, 0, 1, 32610))


def lzw(data: bytes) -> bytes:
    """A plain LZW encoder that clears its table now and then."""
    out, bits, n = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            out.append(bits >> (n - 8) & 255)
            n -= 8

    table, width, word = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, 9)
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        put(table[word], width)
        table[word + bytes([b])] = len(table) + 2
        size = len(table) + 2
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size > 4000:
            put(256, width)
            table, width = {bytes([i]): i for i in range(256)}, 9
        word = bytes([b])
    put(table[word], width)
    size = len(table) + 3
    put(257, 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12)
    return bytes(out) + (bytes([bits << (8 - n) & 255]) if n else b"")


def tiled_tiff(values: np.ndarray, tile: int, compression: int, predictor: int, order: str = "<") -> bytes:
    """A file of tiles; the last ones run over the edge."""
    h, w, n = values.shape
    kind = values.dtype.newbyteorder(order)
    blocks = []
    for r in range(0, h, tile):
        for c in range(0, w, tile):
            block = np.zeros((tile, tile, n), values.dtype)
            part = values[r : r + tile, c : c + tile]
            block[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                block[:, 1:] -= block[:, :-1].copy()
            raw = block.astype(kind).tobytes()
            if predictor == 3:
                planes = np.frombuffer(block.astype(values.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(tile, tile * n, kind.itemsize).transpose(0, 2, 1).reshape(tile, -1, n).copy()
                planes[:, 1:] -= planes[:, :-1].copy()
                raw = planes.tobytes()
            blocks.append({1: lambda x: x, 5: lzw, 8: zlib.compress}[compression](raw))
    fmt = {"i": 2, "u": 1, "f": 3}[values.dtype.kind]
    tags = [(256, "H", [w]), (257, "H", [h]), (258, "H", [8 * kind.itemsize] * n), (259, "H", [compression]), (277, "H", [n]), (317, "H", [predictor]), (322, "H", [tile]), (323, "H", [tile]), (324, "I", [0] * len(blocks)), (325, "I", [len(b) for b in blocks]), (339, "H", [fmt] * n)]
    at = 8 + 2 + 12 * len(tags) + 4
    size = sum(len(v) * struct.calcsize(c) for _, c, v in tags if len(v) * struct.calcsize(c) > 4)
    tags[8] = (324, "I", [at + size + sum(len(b) for b in blocks[:i]) for i in range(len(blocks))])
    head, extra = [], b""
    for tag, code, v in tags:
        data = struct.pack(f"{order}{len(v)}{code}", *v)
        if len(data) > 4:
            data, extra = struct.pack(order + "I", at + len(extra)), extra + data
        head.append(struct.pack(order + "HHI", tag, {"H": 3, "I": 4}[code], len(v)) + data.ljust(4, b"\0"))
    return b"".join([b"II" if order == "<" else b"MM", struct.pack(order + "HIH", 42, 8, len(tags)), *head, b"\0" * 4, extra, *blocks])


@pytest.mark.parametrize("compression", [1, 5, 8])
@pytest.mark.parametrize(("kind", "predictor"), [("f4", 1), ("f4", 3), ("f8", 3), ("i2", 2), ("u1", 1)])
def test_tiles_and_compressions(compression, kind, predictor):
    rng = np.random.default_rng(3)
    for n, order in ((1, "<"), (2, ">")):
        values = (rng.integers(0, 40, (70, 45, n)).cumsum(axis=1) % 101).astype(kind)
        data = tiled_tiff(values, 32, compression, predictor, order)
        for band in range(1, n + 1):
            assert (geotiff.decode(data, band)[0] == values[..., band - 1]).all()
    with pytest.raises(grid.BandError):
        geotiff.decode(data, 3)


def test_place_on_the_map():
    values = np.arange(6, dtype="f4").reshape(2, 3)
    for compression in (geotiff.PLAIN, geotiff.DEFLATE):
        got = geotiff.raster(geotiff.encode(values, -700, 300, GEO, compression))
        assert (got.values == values).all() and (got.row0, got.col0) == (-700, 300) and got.geo == GEO and got.geo.epsg == 32610


def test_null_heights_are_nodata(spark):
    rows = [(r, c, 4000) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    without = spark.createDataFrame(rows, "row long, col long, z long")
    with_null = spark.createDataFrame([*rows, (1, 1, None), (0, 0, 3000)], "row long, col long, z long")  # and a doubled cell
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(smooth.gaussian(with_null)) == key(smooth.gaussian(without)) and {r.zs for r in smooth.gaussian(with_null).collect()} == {4000}
    for limit in (0.0, 0.2):
        a, b = (tops.tops(x, ((1000, 3),), limit) for x in (with_null, without))
        assert key(a) == key(b)


def test_shapefiles(spark, tmp_path):
    owned = spark.createDataFrame([(r, c, k) for k, cells in ((3, [(0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (2, 2)]), (9, [(5, 5)])) for r, c in cells], "row long, col long, crown_id long")
    shapes = polygons.polygons(owned, geo=GEO).select("crown_id", "area", "geom").repartition(5)
    vector.write_shapefile(shapes, f"file://{tmp_path}/s", ("crown_id", "area"), prj="LOCAL")
    back = {r.crown_id: r for r in vector.read_shapefile(spark, f"file://{tmp_path}/s", {"crown_id": "long", "area": "double"}).collect()}
    assert {k: r.area for k, r in back.items()} == {3: 32.0, 9: 4.0}
    for r in shapes.collect():
        rings = [sorted(map(tuple, x.tolist())) for x in vector.rings_of(bytes(r.geom))]
        assert [sorted(map(tuple, x.tolist())) for x in vector.rings_of(bytes(back[r.crown_id].geom))] == rings
    assert len(list((tmp_path / "s/part=prj").glob("part*"))) == len(list((tmp_path / "s/part=shp").glob("part*"))) <= 2
    none = shapes.where("false")
    vector.write_shapefile(none, f"file://{tmp_path}/none", ("crown_id",))
    vector.write_sqlite(none, f"file://{tmp_path}/none.sqlite", "crowns")
    assert vector.read_sqlite(spark, f"file://{tmp_path}/none.sqlite", "crowns", "crown_id long, area double, geom binary").count() == 0
    points = tops.points(spark.createDataFrame([(1, 2, 9)], "row long, col long, z long").repartition(4))
    vector.write_shapefile(points, f"file://{tmp_path}/p")
    assert vector.read_shapefile(spark, f"file://{tmp_path}/p", {"top_id": "long", "z": "long"}).select("top_id", "z", *vector.point_xy(vector.F.col("geom"))).collect() == [(5, 9, 2.5, 1.5)]


def test_large_ids_fit_rasters(spark):
    owned = spark.createDataFrame([(0, 0, 5), (0, 1, 1 << 40), (0, 2, 1 << 40), (1, 0, (1 << 40) + 1), (2, 0, 1 << 50)], "row long, col long, crown_id long")
    assert sorted(map(tuple, crowns.raster_i32(owned).collect())) == [(0, 0, 1), (0, 1, 2), (0, 2, 2), (1, 0, 3), (2, 0, 4)]


@pytest.mark.parametrize(("driver", "limit"), [("SQLite", vector.SHAPEFILE_LIMIT), ("ESRI Shapefile", vector.SHAPEFILE_LIMIT), ("ESRI Shapefile", 100)])
def test_run_over_files(spark, data, tmp_path, driver, limit):
    chm = fixtures.chm(spark, f"{data}/sf0.001")
    base = f"file://{tmp_path}"
    geotiff.write(grid.to_float(chm, "z"), f"{base}/chm", "z", tile=40, geo=GEO)
    end = ".shp" if driver != "SQLite" else ".sqlite"
    config = replace(FULL, original=f"{base}/chm", smoothed=f"{base}/smoothed", tops=f"{base}/tops{end}", tops_driver=driver, crowns_raster=f"{base}/raster", crowns=f"{base}/crowns{end}", crowns_driver=driver, crown_thresholds=((5.0, 0.5, 6.0),))  # three cells of two
    told, ticks = [], []
    done = run_files(spark, config, told=lambda s, m: told.append((round(s, 2), m)), clock=ticks.append, limit=limit)
    assert told == [(0.33, "smoothed"), (0.67, "tops found"), (1.0, "crowns grown")] and ticks[0] == 0 and ticks == sorted(ticks) and ticks[-1] > 1
    assert (done.tops_driver, done.crowns_driver) == (("SQLite",) * 2 if limit == 100 else (driver,) * 2) and (done.tops == config.tops) == (limit != 100)
    want = run(FULL, chm)
    found = {r.top_id: r.z for r in read_tops(spark, done).collect()}
    assert found == {r.top_id: r.z for r in want.tops.collect()}
    areas = {r.crown_id: (4 * r.area, r.top_z) for r in want.shapes.collect()}  # cells of two by two
    names = {"crown_id": "long", "crown_no": "long", "n_parts": "long", "n_holes": "long", "area": "double", "perimeter": "double", "top_z": "long"}
    if done.crowns_driver == "SQLite":
        got = vector.read_sqlite(spark, done.crowns, "crowns", ", ".join(f"{k} {v}" for k, v in names.items()) + ", geom binary")
        file = next(f for f in (tmp_path / "crowns.sqlite").glob("part*") if f.stat().st_size)
        db = sqlite3.connect(f"file:{file}?mode=ro", uri=True)
        assert db.execute("SELECT min(srid), max(srid) FROM crowns").fetchone() == (32610, 32610)
    else:
        got = vector.read_shapefile(spark, done.crowns, names)
        for folder in (done.tops, done.crowns):
            parts = [f.read_text() for f in (tmp_path / folder.rpartition("/")[2] / "part=prj").glob("part*")]
            assert parts and all(x.startswith('PROJCS["WGS_1984_UTM_Zone_10N"') and '"Central_Meridian",-123.0' in x for x in parts)
    rows = got.collect()
    assert {r.crown_id: (r.area, r.top_z) for r in rows} == areas
    numbers = {r.crown_id: r.crown_no for r in rows}
    cells = {(r.row, r.col): numbers[r.crown_id] for r in want.crowns.collect()}
    assert {(r.row, r.col): int(r.value) for r in geotiff.read(spark, done.crowns_raster).collect()} == cells
    for r in rows[:20]:
        x, y = vector.rings_of(bytes(r.geom))[0].T
        mine = [k for k, v in cells.items() if v == r.crown_no]
        assert (x.min(), y.max()) == (0.25 + 2 * min(c for _, c in mine), -0.5 - 2 * min(r for r, _ in mine))
    assert geotiff.placed(spark, done.crowns_raster) == geotiff.placed(spark, done.smoothed) == GEO


def test_crowns_of_an_earlier_run(spark, data, tmp_path):
    base = f"file://{tmp_path}"
    geotiff.write(grid.to_float(fixtures.chm(spark, f"{data}/sf0.001"), "z"), f"{base}/chm", "z")
    config = replace(FULL, original=f"{base}/chm", smoothed=f"{base}/smoothed", tops=f"{base}/tops.sqlite", crowns_raster=f"{base}/raster", crowns=f"{base}/crowns.sqlite")
    asked = []
    with pytest.raises(Cancelled):
        run_files(spark, config, cancelled=lambda: asked.append(geotiff.read(spark, config.smoothed).count()) or True)
    assert asked[0] > 0 and not (tmp_path / "tops.sqlite").exists()  # asked after the work of the phase, before the next
    run_files(spark, replace(config, do_smoothing=False, do_crowns=False))
    run_files(spark, replace(config, do_smoothing=False, do_tops=False))
    assert vector.read_sqlite(spark, config.crowns, "crowns", "crown_id long").count() > 50


def test_crowns_are_as_large_on_any_cells(spark, tmp_path):
    """The same cone on cells of 1 and of 0.5: a radius of 5 gives the same area but for the cells on its rim."""
    areas = []
    for size in (1.0, 0.5):
        n = round(20 / size)
        cells = spark.createDataFrame([(r, c, round(20_000 - 1000 * size * float(np.hypot(r - n // 2, c - n // 2)))) for r in range(n + 1) for c in range(n + 1)], "row long, col long, z long")
        base = f"file://{tmp_path}/{size}"
        geotiff.write(grid.to_float(cells, "z"), f"{base}/chm", "z", geo=grid.Georef(0.0, 0.0, size, size))
        config = replace(FULL, original=f"{base}/chm", smoothed=f"{base}/s", tops=f"{base}/t", crowns_raster=f"{base}/r", crowns=f"{base}/c", top_thresholds=((5.0, 3),), crown_thresholds=((5.0, 0.1, 5.0),), max_nulls=1.0)
        done = run_files(spark, config)
        areas.append(vector.read_sqlite(spark, done.crowns, "crowns", "area double").first().area)
    assert all(abs(a - np.pi * 25) < 5 for a in areas)
    with pytest.raises(ValueError, match="square"):
        from canoply.plans.run import grown

        grown(FULL, cells, cells, grid.Georef(0.0, 0.0, 1.0, 2.0))


def test_prj_of_other_systems():
    from canoply.sources import crs

    assert crs.prj(grid.Georef()) == "" and crs.wkt(4326).startswith('GEOGCS["GCS_WGS_1984"') and "10000000.0" in crs.wkt(32719)
    assert crs.wkt(3005).startswith('LOCAL_CS["EPSG:3005"') and crs.prj(grid.Georef(keys=(1, 1, 0, 1, 3072, 0, 1, 32767), names="My grid|")) == 'LOCAL_CS["My grid",UNIT["Meter",1.0]]'


def test_spatialite(spark, tmp_path):
    """A box query by the R*-tree, Spatialite's tables, and files of bounded bytes."""
    owned = spark.createDataFrame([(10 * k + r, 10 * k + c, k) for k in range(40) for r in range(3) for c in range(3) if (r, c) != (1, 1) or k % 2], "row long, col long, crown_id long")
    shapes = polygons.polygons(owned, geo=GEO).select("crown_id", "area", "geom")
    vector.write(shapes, f"file://{tmp_path}/one", "SQLite", "crowns", epsg=32610, prj="PROJCS[\"x\"]", file_bytes=1 << 30)
    vector.write(shapes, f"file://{tmp_path}/many", "SQLite", "crowns", file_bytes=1000)
    file = lambda name: [f for f in (tmp_path / name).glob("part*") if f.stat().st_size]
    assert len(file("many")) > 4 and max(f.stat().st_size for f in file("many")) < max(f.stat().st_size for f in file("one"))
    want = {r.crown_id: bytes(r.geom) for r in shapes.collect()}
    hits = set()
    for f in file("one"):
        db = sqlite3.connect(f"file:{f}?mode=ro", uri=True)
        assert db.execute("SELECT f_geometry_column, geometry_type, srid, spatial_index_enabled FROM geometry_columns").fetchall() == [("geom", 6, 32610, 1)]
        assert db.execute("SELECT srid, ref_sys_name FROM spatial_ref_sys").fetchall() == [(32610, "x")]
        box = (0.25 + 2 * 100, 0.25 + 2 * 131, -0.5 - 2 * 131, -0.5 - 2 * 100)
        near = db.execute("SELECT crown_id, geom FROM crowns WHERE rowid IN (SELECT pkid FROM idx_crowns_geom WHERE xmax >= ? AND xmin <= ? AND ymax >= ? AND ymin <= ?)", box).fetchall()
        for k, blob in near:
            hits.add(k)
            x0, y0, x1, y1 = struct.unpack_from("<4d", blob, 6)
            assert (blob[0], blob[1], blob[38], blob[-1]) == (0, 1, 0x7C, 0xFE) and (x1 - x0, y1 - y0) == (6, 6) and vector.from_spatialite(blob) == want[k]
    assert hits == {10, 11, 12, 13}
    for name in ("one", "many"):
        assert {r.crown_id: bytes(r.geom) for r in vector.read_sqlite(spark, f"file://{tmp_path}/{name}", "crowns", "crown_id long, geom binary").collect()} == want


def test_sizes_are_those_of_the_files(spark, tmp_path):
    owned = spark.createDataFrame([(20 * k + r, c, k) for k in range(9) for r in range(5) for c in range(3 + k) if (r, c) != (1, 1)] + [(500, 0, 3), (500, 2, 3)], "row long, col long, crown_id long")
    shapes = polygons.polygons(owned).select("crown_id", "area", "geom").coalesce(1)
    points = tops.points(spark.createDataFrame([(1, 2, 9), (4, 4, 9)], "row long, col long, z long")).coalesce(1).select("top_id", "z", vector.point_wkb(vector.F.col("x"), vector.F.col("y")).alias("geom"))
    for name, df in (("shapes", shapes), ("points", points)):
        seen_df, seen = vector.measured(df)
        seen_df.write.format("noop").mode("overwrite").save()
        size = seen.get
        assert vector.write(df, f"file://{tmp_path}/{name}.shp", "ESRI Shapefile", "t") == (f"file://{tmp_path}/{name}.shp", "ESRI Shapefile")
        real = {p: sum(f.stat().st_size - 1 for f in (tmp_path / f"{name}.shp/part={p}").glob("part*")) for p in ("shp", "dbf")}
        assert (real["shp"], real["dbf"]) == (size["shp"] + 100, size["dbf"] + 34 + 32 * 2)
        most = max(real.values())
        assert [vector.write(df, f"file://{tmp_path}/{name}{k}.shp", "ESRI Shapefile", "t", k)[1] for k in (most, most - 1)] == ["ESRI Shapefile", "SQLite"]


def test_wide_numbers_fail():
    with pytest.raises(ValueError, match="18 digits"):
        vector.dbf({"id": [1 << 62]})


def test_steps_and_stop(spark, data, tmp_path):
    base = f"file://{tmp_path}"
    geotiff.write(grid.to_float(fixtures.chm(spark, f"{data}/sf0.01"), "z"), f"{base}/chm", "z")
    config = replace(FULL, original=f"{base}/chm", smoothed=f"{base}/smoothed", tops=f"{base}/tops.sqlite", crowns_raster=f"{base}/raster", crowns=f"{base}/crowns.sqlite")
    steps = []
    run_files(spark, config, calls=Callbacks(step=lambda x, m: steps.append((m, x)), tick=0.05))
    for phase in ("smoothed", "tops found", "crowns grown"):
        own = [x for m, x in steps if m == phase]
        assert own[0] == 0 and own[-1] == 1 and own == sorted(own)
        assert phase == "smoothed" or len({x for x in own if 0 < x < 1}) >= 3
    stop, told = threading.Event(), []
    other = replace(config, smoothed=f"{base}/smoothed2", tops=f"{base}/tops2.sqlite", crowns_raster=f"{base}/raster2", crowns=f"{base}/crowns2.sqlite")

    def step(x, message):
        if message == "tops found" and not stop.is_set():
            told.append(time.monotonic())
            stop.set()

    with pytest.raises(Cancelled):
        run_files(spark, other, calls=Callbacks(step=step, stop=stop, tick=0.05))
    assert time.monotonic() - told[0] < 10 and (tmp_path / "smoothed2").exists()
    assert not any((tmp_path / x).exists() for x in ("tops2.sqlite", "raster2", "crowns2.sqlite"))
    assert spark.range(10).count() == 10  # later jobs aren't touched
