"""Hand-made grids with known answers, and invariants."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from canoply.operators import crowns, grid, polygons, smooth, tops
from canoply.plans import fixtures
from canoply.sources import geotiff, vector


def cells(spark, text: str, unit: int = 1000):
    rows = [(r, c, int(v) * unit) for r, line in enumerate(text.split()) for c, v in enumerate(line) if v != "."]
    return spark.createDataFrame(rows, "row long, col long, z long")


def places(df, *names):
    return sorted(tuple(r) for r in df.select(*(names or ("row", "col"))).collect())


ONE = ((1000, 3),)


def test_plateau_has_one_top(spark):
    assert places(tops.tops(cells(spark, "11111 16661 11111"), ((2000, 3),), None)) == [(1, 1)]
    assert places(tops.tops(cells(spark, "11111 16661 11111"), ((2000, 5),), None)) == [(1, 1)]


def test_top_at_border_and_below_all_classes(spark):
    assert places(tops.tops(cells(spark, "911 111 119"), ((5000, 3),), None)) == [(0, 0), (2, 2)]
    assert places(tops.tops(cells(spark, "111 121 111"), ((5000, 3),), None)) == []


def test_null_fraction(spark):
    c = cells(spark, "11111 1.9.1 11111")
    assert places(tops.candidates(c, ((5000, 3),), 0.2)) == []
    assert places(tops.candidates(c, ((5000, 3),), 0.3)) == [(1, 2)]


def test_tiles_equal_range_frames(spark, data):
    c = fixtures.chm(spark, f"{data}/sf0.001")
    for tile in (16, 256):
        got = {(r.row, r.col): (r.window, r.n) for r in tops.candidates(c, tops.CLASSES, tile=tile).collect()}
        want = {}
        for r in tops.windows(c, [3, 5, 7]).where("z >= 5000").collect():
            w = 3 if r.z < 12000 else 5 if r.z < 20000 else 7
            if r[f"top_{w}"] == r.z:
                want[r.row, r.col] = (w, r[f"n_{w}"])
        assert got == want


def test_empty_raster(spark):
    none = cells(spark, "...")
    assert tops.tops(none, ONE, 0.2).count() == 0
    assert smooth.gaussian(none).count() == 0
    assert crowns.crowns(none, tops.tops(none, ONE, None), ((1000, 50, 3),)).count() == 0
    assert polygons.polygons(none.withColumnRenamed("z", "crown_id")).count() == 0


def test_smoothing_keeps_constant_fields_and_nodata(spark):
    got = smooth.gaussian(cells(spark, "444 4.4 444"), 5, 1.0)
    assert {r.zs for r in got.collect()} == {4000} and got.count() == 8
    assert {r.zs for r in smooth.gaussian(cells(spark, "123"), 3, 0.0).collect()} == {1000, 2000, 3000}
    with pytest.raises(ValueError):
        smooth.gaussian(cells(spark, "1"), 4, 1.0)


def test_touching_crowns_share_no_cell(spark):
    c = cells(spark, "0000000 0565650 0000000")
    t = tops.tops(c, ((5000, 3),), None)
    owned = crowns.crowns(c, t, ((5000, 80, 3),))
    assert places(owned, "row", "col", "crown_id") == [(1, 1, 9), (1, 2, 9), (1, 3, 9), (1, 4, 11), (1, 5, 11)]


def test_dangle_goes(spark):
    owned = spark.createDataFrame([(0, 0, 0, 9000, 0), (0, 1, 0, 8000, 1), (0, 3, 0, 8000, 9)], "row long, col long, crown_id long, z long, d2 long")
    t = spark.createDataFrame([(0, 0, 0)], "top_id long, row long, col long")
    assert places(crowns.remove_dangles(owned, t)) == [(0, 0), (0, 1)]


def crown_of(spark, text: str):
    return cells(spark, text.replace("#", "1"), 7).withColumnRenamed("z", "crown_id")


@pytest.mark.parametrize(
    ("text", "area", "filled", "perimeter", "holes"),
    [("#", 1, 1, 4, 0), ("### #.# ###", 8, 9, 16, 1), ("#### #..# ####", 10, 12, 20, 1), ("#### #.#. ####", 10, 11, 20, 1), ("##. #.# ###", 7, 8, 16, 1)],
)
def test_polygons(spark, text, area, filled, perimeter, holes):
    owned = crown_of(spark, text)
    got = polygons.polygons(owned).first()
    assert polygons.edges(owned).count() == got.perimeter == perimeter or text in ("#### #.#. ####", "##. #.# ###")
    assert got.area == area
    assert polygons.polygons(owned, remove_holes=True).first().area == crowns.fill_holes(owned).count()


def test_tile_size_and_row_order_do_not_matter(spark, data):
    c = fixtures.chm(spark, f"{data}/sf0.001")
    t = crowns.crown_class(tops.tops(c, tops.CLASSES, None))
    want = places(crowns.flood(c, t), "top_id", "row", "col")
    assert want == places(crowns.flood(c.orderBy("z"), t, tile=17), "top_id", "row", "col")
    seen = {(r.row, r.col): r.z for r in c.collect()}
    owned = crowns.owners(crowns.flood(c, t)).collect()
    top = {r.top_id: r for r in t.collect()}
    assert len({(r.row, r.col) for r in owned}) == len(owned)
    for r in owned:
        p = top[r.crown_id]
        assert r.d2 <= p.radius**2 and seen[r.row, r.col] * 100 >= p.fraction * p.z
    assert {r.crown_id for r in owned if r.d2 == 0} == set(top)


def test_bands(spark):
    with pytest.raises(grid.BandError):
        grid.scan(cells(spark, "1"), 1000)


def test_geotiff_round_trip(spark, tmp_path):
    c = grid.to_float(cells(spark, "123 4.6 789").withColumnRenamed("z", "zs"), "zs")
    geotiff.write(c, f"file://{tmp_path}/t", "zs", tile=2)
    got = geotiff.read(spark, f"file://{tmp_path}/t")
    assert places(got, "row", "col", "value") == [(r, k, float(v)) for r, line in enumerate("123 4.6 789".split()) for k, v in enumerate(line) if v != "."]
    values = np.arange(6, dtype="i4").reshape(2, 3)
    out, nodata, r0, c0 = geotiff.decode(geotiff.encode(values, 5, 7))
    assert (out == values).all() and (nodata, r0, c0) == (-9999, 5, 7)
    with pytest.raises(ValueError):
        geotiff.decode(geotiff.encode(values), band=2)


def test_vector_files(spark, tmp_path):
    t = tops.tops(cells(spark, "0000 0900 0000 0008"), ((5000, 3),), None)
    vector.write_sqlite(t.select("top_id", "z"), f"file://{tmp_path}/q", "tops")
    assert places(vector.read_sqlite(spark, f"file://{tmp_path}/q", "tops", "top_id long, z long"), "top_id", "z") == [(5, 9000), (15, 8000)]
    vector.write_shapefile(t.coalesce(1), f"file://{tmp_path}/s")
    (file,) = (tmp_path / "s/part=shp").glob("part*")
    head = file.read_bytes()
    assert int.from_bytes(head[:4], "big") == 9994 and len(head) == 100 + 2 * 28 + 1


def plain_grow(mask, seeds, corners):
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if corners else [])
    out, todo = np.zeros_like(mask), [p for p in zip(*np.nonzero(mask & seeds))]
    for p in todo:
        out[p] = True
    while todo:
        y, x = todo.pop()
        for dy, dx in steps:
            p = y + dy, x + dx
            if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not out[p]:
                out[p] = True
                todo.append(p)
    return out


@pytest.mark.parametrize("corners", [False, True])
def test_grow(corners):
    rng = np.random.default_rng(4)
    for share in (0.0, 0.3, 0.55, 0.7, 1.0):
        mask, seeds = rng.random((5, 17, 23)) < share, rng.random((5, 17, 23)) < 0.02
        want = np.stack([plain_grow(m, s, corners) for m, s in zip(mask, seeds)])
        assert (crowns.grow(mask, seeds, corners) == want).all()


def test_a_crown_of_radius_499_grows_at_once():
    y, x = np.mgrid[-499:500, -499:500]
    disc = (y * y + x * x <= 499 * 499)[None]
    maze = disc & ((y % 4 > 0) | (x % 40 == np.where(y // 4 % 2, 0, 20)))[None]  # long ways from end to end
    seed = (y * y + x * x == 4)[None] & (x == 0)[None]
    for mask in (disc, maze):
        began = time.perf_counter()
        got = crowns.grow(mask, seed)
        assert time.perf_counter() - began < 0.5 and got[0, 501, 499]
    assert (crowns.grow(disc, seed) == disc).all()


def test_settled_candidates_equal_joined_ones(spark, data):
    metres = fixtures.chm(spark, f"{data}/sf0.001").withColumn("z", F.expr("z div 3000"))
    classes, key = ((1, 3), (4, 7), (6, 5)), lambda df: sorted((r.row, r.col) for r in df.collect())
    for limit in (None, 0.3):
        want = key(tops.break_ties(tops.candidates(metres, classes, limit), classes))
        for tile in (8, 13, 256):
            assert key(tops.candidates(metres, classes, limit, tile=tile, settled=True)) == want
    plan = tops.tops(metres, classes, 0.2, frame=grid.frame(metres))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1


@pytest.mark.parametrize(("window", "sigma", "tile"), [(3, 0.8, 5), (9, 2.0, 16), (31, 9.0, 256), (3, 0.0, 7)])
def test_smoothing_equals_plain_sums(spark, window, sigma, tile):
    rng = np.random.default_rng(window)
    cells = {(int(r), int(c)): int(z) for r, c, z in zip(rng.integers(-20, 20, 500), rng.integers(-20, 20, 500), rng.integers(-5000, 9000, 500))}
    kernel = smooth.kernel(window, sigma)
    want = []
    for (r, c), z in cells.items():
        near = [(cells[r + dr, c + dc], a * b) for dr, a in kernel for dc, b in kernel if (r + dr, c + dc) in cells]
        num, den = sum(v * w for v, w in near), sum(w for _, w in near)
        want.append((r, c, z, abs(num) // den * (1 if num >= 0 else -1)))
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "row long, col long, z long")
    assert sorted(map(tuple, smooth.gaussian(df, window, sigma, tile).collect())) == sorted(want)


def plain_rings(mask):
    """The walk side by side."""
    m = mask[1:-1, 1:-1]
    sides = ((m & ~mask[2:, 1:-1], (0, 1), (1, 0)), (m & ~mask[1:-1, 2:], (1, 1), (0, -1)), (m & ~mask[:-2, 1:-1], (1, 0), (-1, 0)), (m & ~mask[1:-1, :-2], (0, 0), (0, 1)))
    go = {((int(x) + at[0], int(y) + at[1]), step) for inside, at, step in sides for y, x in zip(*np.nonzero(inside), strict=True)}
    out, seen = [], set()
    for start in sorted(go):
        walk, here = [], start
        while here not in seen:
            seen.add(here)
            walk.append(here)
            (x, y), (dx, dy) = here
            end = x + dx, y + dy
            here = end, next(w for w in ((dy, -dx), (dx, dy), (-dy, dx)) if (end, w) in go)
        if walk:
            corners = [p for (p, d), (_, before) in zip(walk, [walk[-1], *walk]) if d != before]
            out.append([*corners, corners[0]])
    return out


def test_outlines_equal_the_plain_walk():
    rng = np.random.default_rng(8)
    stack = np.zeros((40, 15, 19), bool)
    stack[:, 1:-1, 1:-1] = rng.random((40, 13, 17)) < np.linspace(0, 1, 40)[:, None, None]
    found = [[] for _ in stack]
    for k, ring in polygons.outlines(stack):
        found[k].append(list(map(tuple, ring.tolist())))
    assert found == [plain_rings(m) for m in stack]
    big = np.zeros((1, 1001, 1001), bool)
    big[0, 1:-1, 1:-1] = np.hypot(*np.mgrid[-499:500, -499:500]) < 499
    began = time.perf_counter()
    ((_, ring),) = polygons.outlines(big)
    assert time.perf_counter() - began < 1 and polygons.area2(ring) == 2 * big.sum()
