"""HFA files: round trips, run-length blocks, and runs that write them."""

from __future__ import annotations

import struct
from dataclasses import replace

import numpy as np
import pytest
from test_files import GEO
from test_run import FULL

from canoply.operators import grid
from canoply.plans import fixtures
from canoply.plans.run import run_files
from canoply.sources import blocks, geotiff, hfa

PLACE = grid.Georef(0.25, -0.5, 2.0, 2.0)


@pytest.mark.parametrize("kind", ["f4", "i4", "u1", "i2", "f8"])
@pytest.mark.parametrize("shape", [(1, 1), (64, 64), (65, 200)])
def test_round_trip(kind, shape):
    values = np.random.default_rng(2).integers(0, 100, shape).astype(kind)
    data = hfa.encode(values, -700, 300, PLACE)
    found = hfa.Layout(data)
    got = np.zeros(shape, kind)
    for b in found.blocks():
        part = found.values(data[b.at : b.at + b.size], b)
        got[b.row : b.row + part.shape[0], b.col : b.col + part.shape[1]] = part
    assert (got == values).all() and (found.row0, found.col0, found.geo) == (-700, 300, PLACE) and found.nodata == geotiff.NODATA
    with pytest.raises(grid.BandError):
        next(found.blocks(2))


def test_the_tree_is_linked():
    data = hfa.encode(np.ones((70, 70), "f4"), 0, 0, PLACE)
    start, = struct.unpack("<I", data[16:20])
    version, _, root, length, words = struct.unpack("<iIIhI", data[start : start + 18])
    assert (version, length) == (1, 128) and data[words:].startswith(b"{1:lversion") and data[words:].split(b"\0")[0].endswith(b",.")
    (top,) = hfa.nodes(data, root)
    (layer,) = top.children
    assert [x.kind for x in layer.children] == ["Edms_State", "Eimg_NonInitializedValue", "Eprj_MapInfo"]
    at = struct.unpack_from("<I", data, root + 12)[0]
    assert struct.unpack_from("<I", data, at + 8)[0] == root  # a child knows its parent
    second = struct.unpack_from("<I", data, struct.unpack_from("<I", data, at + 12)[0])[0]
    assert struct.unpack_from("<I", data, second + 4)[0] == struct.unpack_from("<I", data, at + 12)[0]  # and its elder


@pytest.mark.parametrize(("bits", "values"), [(0, [5] * 10), (1, [5, 6, 6, 5, 6] * 4), (2, [5, 8, 6, 7] * 3), (4, list(range(5, 20))), (8, [5, 200, 60]), (16, [5, 40_000, 300]), (32, [5, 1 << 20])])
def test_run_length_blocks(bits, values):
    above = [v - 5 for v in values]
    if bits == 0:
        held = b""
    elif bits < 8:
        held = np.packbits(np.array([[v >> k & 1 for k in range(bits)] for v in above], np.uint8).ravel(), bitorder="little").tobytes()
    else:
        held = b"".join(v.to_bytes(bits // 8, "big") for v in above)
    plain = struct.pack("<iiiB", 5, -1, 13, bits) + held
    assert hfa.unrun(plain, len(values), np.dtype("i4")).tolist() == values
    counts = [1 if k % 2 else 300 for k in range(len(values))]
    heads = b"".join(bytes([c]) if c < 64 else bytes([64 | c >> 8, c & 255]) for c in counts)
    runs = struct.pack("<iiiB", 5, len(values), 13 + len(heads), bits) + heads + held
    assert hfa.unrun(runs, sum(counts), np.dtype("i4")).tolist() == np.repeat(values, counts).tolist()


def test_run_writes_hfa(spark, data, tmp_path):
    base = f"file://{tmp_path}"
    geotiff.write(grid.to_float(fixtures.chm(spark, f"{data}/sf0.001"), "z"), f"{base}/chm", "z", tile=100, geo=PLACE)
    named = lambda end: replace(FULL, original=f"{base}/chm", smoothed=f"{base}/s{end}", tops=f"{base}/t{end}", crowns_raster=f"{base}/r{end}", crowns=f"{base}/c{end}")
    both = [run_files(spark, named("tif")), run_files(spark, replace(named("img"), smoothed_driver="HFA", crowns_raster_driver="HFA"))]
    key = lambda path: sorted(map(tuple, geotiff.read(spark, path).collect()))
    for part in ("smoothed", "crowns_raster"):
        a, b = (key(getattr(c, part)) for c in both)
        assert a == b and len(a) > 500
    file = next(f for f in (tmp_path / "simg").glob("part*") if f.stat().st_size)
    assert file.read_bytes().startswith(hfa.MARK) and geotiff.placed(spark, f"{base}/simg") == PLACE
    window = geotiff.read(spark, f"{base}/simg", window=blocks.Window(70, 75, 0, 9)).collect()
    assert sorted(map(tuple, window)) == [r for r in key(f"{base}/stif") if 70 <= r[0] <= 75 and r[1] <= 9]
    assert GEO.epsg == 32610 and geotiff.placed(spark, f"{base}/rimg").keys == ()  # systems stay behind
