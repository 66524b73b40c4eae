"""Queries over the raster operators, with the same results in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import crowns, grid, polygons, smooth, tops
from ..sources import geotiff, vector
from . import fixtures
from .run import shared

MIXED = ((5000, 3), (12000, 5), (20000, 7))
METRES = ((5, 3), (12, 5), (20, 7))
CROWN = ((5000, 50, 3), (12000, 55, 4), (20000, 60, 5))


def _chm(spark, sf_dir: str) -> DataFrame:
    return fixtures.chm(spark, sf_dir)


def _metres(spark, sf_dir: str) -> DataFrame:
    return _chm(spark, sf_dir).withColumn("z", F.expr("z div 1000"))


def _owned(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = _chm(spark, sf_dir)
    t = tops.tops(c, MIXED, None, frame=grid.frame(c))
    return c, t, crowns.crowns(c, t, CROWN, dangles=False)


def chm_scan(spark, sf_dir):
    """Heights through GeoTIFF files and back, and a band of a table."""
    path = shared(spark, "chm")
    geotiff.write(grid.to_float(_chm(spark, sf_dir), "z"), path, "z")
    c = geotiff.heights(spark, path)
    both = c.withColumn("band", F.lit(1)).unionByName(c.select("row", "col", (-F.col("z")).alias("z"), F.lit(2).alias("band")))
    return grid.scan(both, 2)


def smoothed_sink_f32(spark, sf_dir):
    """Smoothed heights through 32-bit files and back."""
    path = shared(spark, "smoothed")
    geotiff.write(grid.to_float(smooth.gaussian(_chm(spark, sf_dir)), "zs"), path, "zs")
    return geotiff.read(spark, path).select("row", "col", F.col("value").cast("float").alias("zs"))


def smooth_gaussian(spark, sf_dir):
    return smooth.gaussian(_chm(spark, sf_dir), 5, 1.2).select("row", "col", "zs")


def smooth_skip(spark, sf_dir):
    return smooth.phase(_chm(spark, sf_dir), None, do_smoothing=False)


def tops_height_class(spark, sf_dir):
    return tops.height_class(_chm(spark, sf_dir), MIXED).select("row", "col", "z", F.col("window").alias("win"))


def tops_local_max(spark, sf_dir):
    return tops.candidates(_chm(spark, sf_dir), MIXED).select("row", "col", "z", F.col("window").alias("win"))


def tops_plateau(spark, sf_dir):
    return tops.candidates(_metres(spark, sf_dir), METRES, settled=True).select("row", "col", "z")


def tops_max_nulls(spark, sf_dir):
    return tops.candidates(_chm(spark, sf_dir), MIXED, 0.0).select("row", "col", "nulls", "cells")


def tops_points(spark, sf_dir):
    return tops.tops(_chm(spark, sf_dir), MIXED, None).select("top_id", "row", "col", "x", "y", "z", vector.point_wkt(F.col("x"), F.col("y")).alias("geom"))


def tops_full(spark, sf_dir):
    c = _chm(spark, sf_dir)
    return tops.tops(smooth.gaussian(c), MIXED, 0.2, on="zs", frame=grid.frame(c)).select("top_id", "row", "col", "z", "zs")


def crowns_class(spark, sf_dir):
    return crowns.crown_class(tops.tops(_chm(spark, sf_dir), MIXED, None), CROWN).select("top_id", "z", "fraction", "radius")


def crowns_flood(spark, sf_dir):
    c = _chm(spark, sf_dir)
    return crowns.flood(c, crowns.crown_class(tops.tops(c, MIXED, None), CROWN), radius=max(x[2] for x in CROWN)).select("top_id", "row", "col", "d2")


def crowns_owner(spark, sf_dir):
    return _owned(spark, sf_dir)[2].select("row", "col", "crown_id", "z", "d2")


def crowns_raster_i32(spark, sf_dir):
    """Crowns through files of 32-bit numbers and back."""
    path = shared(spark, "crowns")
    geotiff.write(crowns.raster_i32(_owned(spark, sf_dir)[2]), path, "crown_no", "i4")
    return geotiff.read(spark, path).select("row", "col", F.col("value").cast("int").alias("crown_no"))


def crowns_remove_dangles(spark, sf_dir):
    _, t, owned = _owned(spark, sf_dir)
    return crowns.remove_dangles(owned, t).select("row", "col", "crown_id")


def crowns_remove_holes(spark, sf_dir):
    owned = _owned(spark, sf_dir)[2]
    return crowns.fill_holes(owned, dangles=True).groupBy("crown_id").agg(F.count("*").alias("area"))


def crowns_zonal(spark, sf_dir):
    return crowns.zonal(_owned(spark, sf_dir)[2])


def crowns_edges(spark, sf_dir):
    return polygons.edges(_owned(spark, sf_dir)[2])


def crowns_polygons(spark, sf_dir):
    return polygons.polygons(_owned(spark, sf_dir)[2], dangles=True)


def crowns_outlines(spark, sf_dir):
    """The rings of the polygons, corner by corner."""
    return polygons.ring_texts(crowns_polygons(spark, sf_dir))


def crowns_shapes(spark, sf_dir):
    """The polygons without their geometry."""
    return crowns_polygons(spark, sf_dir).drop("geom")


def crowns_attributes(spark, sf_dir):
    _, t, owned = _owned(spark, sf_dir)
    shapes = polygons.polygons(owned)
    return polygons.with_attributes(shapes, t).select("crown_id", "area", "perimeter", "row", "col", "z")


def crowns_update_heights(spark, sf_dir):
    return crowns.update_heights(*_smoothed_crowns(spark, sf_dir)).select("top_id", "z", "zs")


def crowns_keep_smoothed(spark, sf_dir):
    return crowns.update_heights(*_smoothed_crowns(spark, sf_dir), keep_smoothed=False).select("top_id", "row", "col", "z")


def _smoothed_crowns(spark, sf_dir):
    c = _chm(spark, sf_dir)
    s = smooth.gaussian(c)
    t = tops.tops(s, MIXED, None, on="zs", frame=grid.frame(c))
    return t, crowns.crowns(s, t, CROWN, dangles=False, on="zs"), c


def vector_sink(spark, sf_dir):
    """Tops through SQLite files, with their geometry, and back. (The files are written when the query is made.)"""
    t = tops.tops(_chm(spark, sf_dir), MIXED, None)
    path = shared(spark, "vector")
    vector.write(t.select("top_id", "row", "col", "z", vector.point_wkb(F.col("x"), F.col("y")).alias("geom")), path, "SQLite", "tops")
    back = vector.read_sqlite(spark, path, "tops", "top_id long, row long, col long, z long, geom binary")
    return back.select("top_id", "row", "col", "z", *vector.point_xy(F.col("geom")))


def vector_format_switch(spark, sf_dir):
    sized = tops.tops(_chm(spark, sf_dir), MIXED, None).agg(F.count("*").alias("n"))
    driver = F.lit("ESRI Shapefile")
    limits = F.explode(F.array(*(F.lit(x).cast("long") for x in (1000, 20_000_000, vector.SHAPEFILE_LIMIT))))
    first = sized.withColumn("size_limit", limits).withColumn("tops_driver", vector.format_after(F.col("n"), vector.POINT_RECORD, driver, F.col("size_limit")))
    return first.withColumn("crowns_driver", vector.crowns_format(F.col("tops_driver"), driver))


QUERIES = {f.__name__: f for f in (
    chm_scan, smoothed_sink_f32, smooth_gaussian, smooth_skip, tops_height_class, tops_local_max, tops_plateau, tops_max_nulls, tops_points, tops_full, crowns_class, crowns_flood, crowns_owner,
    crowns_raster_i32, crowns_remove_dangles, crowns_remove_holes, crowns_zonal, crowns_edges, crowns_polygons, crowns_outlines, crowns_shapes, crowns_attributes, crowns_update_heights, crowns_keep_smoothed, vector_sink, vector_format_switch,
)}


# The same in SQL.


def _case(z: str, classes, place: int) -> str:
    return "CASE " + " ".join(f"WHEN {z} >= {c[0]} THEN {c[place]}" for c in sorted(classes, reverse=True)) + " END"


def _smoothed(window: int, sigma: float) -> str:
    w = ", ".join(f"({d}, {x})" for d, x in smooth.kernel(window, sigma))
    return f"""s AS (SELECT a.row, a.col, a.z, (sum(b.z * k.w * l.w) // sum(k.w * l.w))::BIGINT AS zs
      FROM c a CROSS JOIN (VALUES {w}) k(d, w) CROSS JOIN (VALUES {w}) l(d, w) JOIN c b ON b.row = a.row + k.d AND b.col = a.col + l.d GROUP BY ALL)"""


def _found(source: str = "c", on: str = "z", classes=MIXED) -> str:
    """Common tables: k (classed cells), cand (candidates with nulls and cells), t (tops without null rule)."""
    side = max(w for _, w in classes) // 2
    return f"""b AS (SELECT min(row) AS r_lo, max(row) AS r_hi, min(col) AS c_lo, max(col) AS c_hi FROM {source}),
    k AS (SELECT *, ({_case(on, classes, 1)})::BIGINT AS win FROM {source} WHERE {on} >= {min(classes)[0]}),
    o AS (SELECT x.i AS dr, y.i AS dc FROM range(-{side}, {side + 1}) x(i) CROSS JOIN range(-{side}, {side + 1}) y(i)),
    m AS (SELECT k.row, k.col, max(n.{on}) AS top, count(*) AS n FROM k JOIN o ON abs(dr) <= win // 2 AND abs(dc) <= win // 2 JOIN {source} n ON n.row = k.row + dr AND n.col = k.col + dc GROUP BY ALL),
    cand AS (SELECT k.*, (least(k.row + win // 2, r_hi) - greatest(k.row - win // 2, r_lo) + 1) * (least(k.col + win // 2, c_hi) - greatest(k.col - win // 2, c_lo) + 1) AS cells, n
      FROM k JOIN m ON k.row = m.row AND k.col = m.col CROSS JOIN b WHERE k.{on} = top)"""


def _tops(on: str = "z", where: str = "true") -> str:
    return f"""cand2 AS (SELECT * FROM cand WHERE {where}),
    t AS MATERIALIZED (SELECT a.row * (c_hi + 1) + a.col AS top_id, a.* FROM cand2 a CROSS JOIN b WHERE NOT EXISTS (SELECT 1 FROM cand2 q WHERE q.{on} = a.{on} AND abs(q.row - a.row) <= a.win // 2 AND abs(q.col - a.col) <= a.win // 2
      AND (q.row < a.row OR q.row = a.row AND q.col < a.col)))"""


def _fill(source: str = "c", on: str = "z") -> str:
    return f"""tc AS MATERIALIZED (SELECT *, {_case(on, CROWN, 1)} AS fraction, {_case(on, CROWN, 2)} AS radius FROM t),
    f AS (SELECT top_id, row, col FROM tc UNION
      SELECT f.top_id, n.row, n.col FROM f JOIN tc ON tc.top_id = f.top_id JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) v(dr, dc) ON true JOIN {source} n ON n.row = f.row + v.dr AND n.col = f.col + v.dc
      WHERE n.{on} * 100 >= tc.fraction * tc.{on} AND n.{on} <= tc.{on} AND (n.row - tc.row) ** 2 + (n.col - tc.col) ** 2 <= tc.radius ** 2),
    fd AS (SELECT f.*, ((f.row - tc.row) * (f.row - tc.row) + (f.col - tc.col) * (f.col - tc.col))::BIGINT AS d2, tc.{on} AS top_z FROM f JOIN tc USING (top_id)),
    own AS MATERIALIZED (SELECT fd.row, fd.col, fd.top_id AS crown_id, n.{on} AS z, d2 FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d2, top_z DESC, top_id) AS nth FROM fd) fd JOIN {source} n ON n.row = fd.row AND n.col = fd.col WHERE nth = 1)"""


def _dangles() -> str:
    return """g AS (SELECT top_id AS crown_id, t.row, t.col FROM t UNION SELECT g.crown_id, n.row, n.col FROM g JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) v(dr, dc) ON true
      JOIN own n ON n.crown_id = g.crown_id AND n.row = g.row + v.dr AND n.col = g.col + v.dc)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE c AS MATERIALIZED (" + fixtures.duck_sql(fixtures.CHM) + "), " + ", ".join(parts)


_PLAIN = "WITH c AS (" + fixtures.duck_sql(fixtures.CHM) + ")"
_OWN = _with(_found(), _tops(), _fill())
_EDGES = "e AS (SELECT crown_id, row + dy AS y, col + dx AS x, side FROM own CROSS JOIN (VALUES (0, 0, 'h'), (1, 0, 'h'), (0, 0, 'v'), (0, 1, 'v')) v(dy, dx, side) GROUP BY ALL HAVING count(*) = 1)"
_SMOOTH_OWN = _with(_smoothed(3, 0.8), _found("s", "zs"), _tops("zs"), _fill("s", "zs"))
_UPDATED = ", u AS (SELECT crown_id, max(c.z) AS most FROM own JOIN c USING (row, col) GROUP BY crown_id)"

ORACLES = {
    "chm_scan": f"{_PLAIN} SELECT row, col, -z AS z FROM c",
    "smoothed_sink_f32": _with(_smoothed(3, 0.8)) + " SELECT row, col, (zs / 1000)::FLOAT AS zs FROM s",
    "smooth_gaussian": _with(_smoothed(5, 1.2)) + " SELECT row, col, zs FROM s",
    "smooth_skip": f"{_PLAIN} SELECT row, col, z, z AS zs FROM c",
    "tops_height_class": _with(_found()) + " SELECT row, col, z, win FROM k",
    "tops_local_max": _with(_found()) + " SELECT row, col, z, win FROM cand",
    "tops_plateau": _with("cm AS (SELECT row, col, z // 1000 AS z FROM c)", _found("cm", "z", METRES), _tops()) + " SELECT row, col, z FROM t",
    "tops_max_nulls": _with(_found()) + " SELECT row, col, cells - n AS nulls, cells FROM cand WHERE cells = n",
    "tops_points": _with(_found(), _tops()) + " SELECT top_id, row, col, (col + 0.5)::DOUBLE AS x, (row + 0.5)::DOUBLE AS y, z, 'POINT (' || col || '.5 ' || row || '.5)' AS geom FROM t",
    "tops_full": _with(_smoothed(3, 0.8), _found("s", "zs"), _tops("zs", "(cells - n) * 5 <= cells")) + " SELECT top_id, row, col, z, zs FROM t",
    "crowns_class": _with(_found(), _tops(), _fill()) + " SELECT top_id, z, fraction::BIGINT AS fraction, radius::DOUBLE AS radius FROM tc",
    "crowns_flood": _OWN + " SELECT top_id, row, col, d2 FROM fd",
    "crowns_owner": _OWN + " SELECT row, col, crown_id, z, d2 FROM own",
    "crowns_raster_i32": _OWN + " SELECT row, col, (dense_rank() OVER (ORDER BY crown_id))::INTEGER AS crown_no FROM own",
    "crowns_remove_dangles": _OWN + ", " + _dangles() + " SELECT row, col, crown_id FROM g",
    "crowns_zonal": _OWN + " SELECT crown_id, count(*) AS n_cells, max(z) AS max_z, min(z) AS min_z, sum(z)::BIGINT AS sum_z FROM own GROUP BY crown_id",
    "crowns_edges": _OWN + ", " + _EDGES + " SELECT * FROM e",
    "crowns_shapes": _OWN + ", " + _dangles() + """, n AS (SELECT crown_id, count(*) AS cells FROM g GROUP BY crown_id),
      p AS (SELECT a.crown_id, count(*) AS pairs FROM g a JOIN (VALUES (0, 1), (1, 0)) v(dr, dc) ON true JOIN g b ON b.crown_id = a.crown_id AND b.row = a.row + v.dr AND b.col = a.col + v.dc GROUP BY a.crown_id),
      q AS (SELECT crown_id, count(*) AS blocks FROM (SELECT a.crown_id, a.row, a.col FROM g a JOIN (VALUES (0, 1), (1, 0), (1, 1)) v(dr, dc) ON true
        JOIN g b ON b.crown_id = a.crown_id AND b.row = a.row + v.dr AND b.col = a.col + v.dc GROUP BY ALL HAVING count(*) = 3) GROUP BY crown_id)
      SELECT crown_id, 1::BIGINT AS n_parts, (1 - cells + coalesce(pairs, 0) - coalesce(blocks, 0))::BIGINT AS n_holes, cells::DOUBLE AS area, (4 * cells - 2 * coalesce(pairs, 0))::DOUBLE AS perimeter
      FROM n LEFT JOIN p USING (crown_id) LEFT JOIN q USING (crown_id)""",
    "crowns_outlines": _OWN + ", " + _dangles() + """, d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY crown_id, x, y, dx, dy) AS id, * FROM (
        SELECT crown_id, col + v.ax AS x, row + v.ay AS y, v.dx, v.dy FROM g CROSS JOIN (VALUES (0, 1, 1, 0, -1, 0), (1, 0, 1, 1, 0, -1), (-1, 0, 0, 0, 0, 1), (0, -1, 0, 1, 1, 0)) v(nc, nr, ax, ay, dx, dy)
        WHERE NOT EXISTS (SELECT 1 FROM g o WHERE o.crown_id = g.crown_id AND o.row = g.row - v.nr AND o.col = g.col + v.nc))),
      nx AS MATERIALIZED (SELECT a.id, arg_min(b.id, CASE WHEN (b.dx, b.dy) = (a.dy, -a.dx) THEN 0 WHEN (b.dx, b.dy) = (a.dx, a.dy) THEN 1 ELSE 2 END) AS after
        FROM d a JOIN d b ON b.crown_id = a.crown_id AND b.x = a.x + a.dx AND b.y = a.y + a.dy WHERE (b.dx, b.dy) <> (-a.dx, -a.dy) GROUP BY a.id),
      w AS (SELECT id AS s, id AS at, 0 AS n FROM d UNION ALL SELECT w.s, nx.after, n + 1 FROM w JOIN nx ON nx.id = w.at WHERE nx.after > w.s),
      r AS (SELECT w.s FROM w JOIN nx ON nx.id = w.at WHERE nx.after = w.s),
      e AS (SELECT w.s, w.n, d.crown_id, d.x, d.y FROM w JOIN r USING (s) JOIN d ON d.id = w.at JOIN nx p ON p.after = d.id JOIN d q ON q.id = p.id WHERE (q.dx, q.dy) <> (d.dx, d.dy))
      SELECT crown_id, string_agg(x || ' ' || y, ',' ORDER BY n) || ',' || arg_min(x || ' ' || y, n) AS ring FROM e GROUP BY s, crown_id""",
    "crowns_attributes": _OWN + ", " + _EDGES + """, p AS (SELECT crown_id, count(*) AS perimeter FROM e GROUP BY crown_id), a AS (SELECT crown_id, count(*) AS area FROM own GROUP BY crown_id)
      SELECT crown_id, area::DOUBLE AS area, perimeter::DOUBLE AS perimeter, t.row, t.col, t.z FROM a JOIN p USING (crown_id) JOIN t ON top_id = crown_id""",
    "crowns_update_heights": _SMOOTH_OWN + _UPDATED + " SELECT top_id, coalesce(most, z) AS z, zs FROM t LEFT JOIN u ON crown_id = top_id",
    "crowns_keep_smoothed": _SMOOTH_OWN + _UPDATED + " SELECT top_id, row, col, coalesce(most, z) AS z FROM t LEFT JOIN u ON crown_id = top_id",
    "crowns_remove_holes": _OWN + ", " + _dangles() + """, fr AS (SELECT crown_id, min(row) - 1 AS r0, max(row) + 1 AS r1, min(col) - 1 AS c0, max(col) + 1 AS c1 FROM g GROUP BY crown_id),
      free AS MATERIALIZED (SELECT crown_id, r AS row, q AS col FROM fr, range(r0, r1 + 1) x(r), range(c0, c1 + 1) y(q) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.crown_id = fr.crown_id AND g.row = r AND g.col = q)),
      out AS (SELECT crown_id, r0 AS row, c0 AS col FROM fr UNION SELECT out.crown_id, n.row, n.col FROM out JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1)) v(dr, dc) ON true
        JOIN free n ON n.crown_id = out.crown_id AND n.row = out.row + v.dr AND n.col = out.col + v.dc)
      SELECT crown_id, ((r1 - r0 + 1) * (c1 - c0 + 1) - n)::BIGINT AS area FROM fr JOIN (SELECT crown_id, count(*) AS n FROM out GROUP BY crown_id) USING (crown_id)""",
    "vector_sink": _with(_found(), _tops()) + " SELECT top_id, row, col, z, (col + 0.5)::DOUBLE AS x, (row + 0.5)::DOUBLE AS y FROM t",
    "vector_format_switch": _with(_found(), _tops()) + """, n AS (SELECT count(*) AS n FROM t), l AS (SELECT n, size_limit, CASE WHEN n * 28 > size_limit THEN 'SQLite' ELSE 'ESRI Shapefile' END AS tops_driver
      FROM n CROSS JOIN (VALUES (1000::BIGINT), (20000000), (2000000000)) v(size_limit)) SELECT n, size_limit, tops_driver, tops_driver AS crowns_driver FROM l""",
}
