"""Rasters read by ranges of blocks."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from test_files import GEO, tiled_tiff

from canoply.sources import blocks, geotiff


def big_tiff(path, height: int, width: int, rows: int, some: dict[tuple[int, int], float]) -> None:
    """A sparse BigTIFF of floats in plain strips; all cells but some are 0, which is nodata."""
    n = -(-height // rows)
    top = 1 << 16
    offsets = [top + k * rows * width * 4 for k in range(n)]
    sizes = [min(rows, height - k * rows) * width * 4 for k in range(n)]
    tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [32]), (259, 3, [1]), (273, 16, offsets), (277, 3, [1]), (278, 4, [rows]), (279, 16, sizes), (339, 3, [3])]
    entries, extra, at = [], b"", 16 + 8 + 20 * (len(tags) + 1) + 8
    for tag, kind, v in tags:
        data = struct.pack(f"<{len(v)}{ {3: 'H', 4: 'I', 16: 'Q'}[kind] }", *v)
        if len(data) > 8:
            entries.append(struct.pack("<HHQQ", tag, kind, len(v), at + len(extra)))
            extra += data
        else:
            entries.append(struct.pack("<HHQ", tag, kind, len(v)) + data.ljust(8, b"\0"))
    entries.append(struct.pack("<HHQ", 42113, 2, 2) + b"0\0".ljust(8, b"\0"))
    head = struct.pack("<2sHHHQQ", b"II", 43, 8, 0, 16, len(entries)) + b"".join(entries) + b"\0" * 8 + extra
    assert len(head) <= top
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(offsets[-1] + sizes[-1])
        for (r, c), v in some.items():
            f.seek(top + (r * width + c) * 4)
            f.write(struct.pack("<f", v))


@pytest.mark.parametrize("rows", [64, 30_000])
def test_three_gigabytes(spark, tmp_path, rows):
    """One strip of 3 GB is cut like many small ones."""
    some = {(0, 0): 1.5, (12_345, 678): 2.5, (29_999, 24_999): 3.5, (15_000, 24_999): 4.5}
    big_tiff(tmp_path / "big.tif", 30_000, 25_000, rows, some)
    read = geotiff.read(spark, f"file://{tmp_path}")
    window = geotiff.read(spark, f"file://{tmp_path}", window=blocks.Window(12_000, 12_500, col_hi=1000))
    assert [tuple(r) for r in window.collect()] == [(12_345, 678, 2.5)]
    if rows == 64:
        assert {(r.row, r.col): r.value for r in read.collect()} == some
    assert len(blocks.Reader({"path": f"file://{tmp_path}", "what": "cells", "band": "1", "task_bytes": str(64 << 20), "row_lo": "0", "row_hi": "9", "col_lo": "0", "col_hi": "9"}).partitions()) == 45


class Counted:
    def __init__(self, data):
        self.data, self.bytes = data, 0

    def __getitem__(self, part):
        got = self.data[part]
        self.bytes += len(got)
        return got


@pytest.mark.parametrize("compression", [1, 8])
def test_a_window_reads_its_blocks(compression):
    values = np.random.default_rng(1).integers(1, 9, (512, 512, 1)).astype("f4")
    data = Counted(tiled_tiff(values, 64, compression, 1))
    got = list(blocks.cells(data, 1, blocks.Window(100, 120, 10, 20)))
    assert sum(b.num_rows for b in got) == 64 * 64 and data.bytes < len(data.data) / 20
    parts = [sum(b.num_rows for b in blocks.cells(data, 1, share=(k, 5))) for k in range(5)]
    assert sum(parts) == 512 * 512 and max(parts) < 60_000


def test_small_files_share_tasks_and_filters_hold(spark, tmp_path):
    values = np.arange(100, dtype="f4").reshape(10, 10) + 1
    for k in range(12):
        (tmp_path / f"t{k}.tif").write_bytes(geotiff.encode(values, 10 * k, 0, GEO))
    (tmp_path / "_SUCCESS").write_bytes(b"x")
    read = geotiff.read(spark, f"file://{tmp_path}")
    assert read.rdd.getNumPartitions() == 1 and read.count() == 1200
    assert geotiff.read(spark, f"file://{tmp_path}", window=geotiff.Window(37, 38, 4, 4)).count() == 2
    assert geotiff.placed(spark, f"file://{tmp_path}") == GEO
    assert geotiff.read(spark, f"file://{tmp_path}/t[01].tif").count() == 200  # a pattern: Spark opens the files
    files = [("a", 10), ("b", 60), ("c", 50), ("d", 250), ("e", 100)]
    assert [(p.files, p.share) for p in blocks.parts(files, 100)] == [(["a", "b"], (0, 1)), (["d"], (0, 3)), (["d"], (1, 3)), (["d"], (2, 3)), (["c"], (0, 1)), (["e"], (0, 1))]
