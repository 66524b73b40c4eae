"""Rasters read by ranges of their blocks: a data source of Spark's in Python.

A partition is a share of a large file's blocks, or several small files, of about ``task_bytes``; it reads the file's fields and offsets,
then the bytes of its blocks one at a time, so a task holds one block whatever the size of the file. Of a window of
rows and columns only the blocks that it meets are read. The window is an option and not a filter that Spark hands down: in Spark 4.1 a
reader keeps what was handed down for one query when the same DataFrame is used in another. (A compressed strip can't be cut, so a file that
is one such strip is one task.)

Ranges are read through Arrow's file systems. Files on others, which only Spark can open, come as binary values, of 2 GB at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import hfa, tiff

TASK_BYTES, HEAD, CELLS = 64 << 20, 64 << 10, 1 << 18
#: Hadoop's names of file systems that Arrow has, and Arrow's.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}
SCHEMAS = {"cells": "row long, col long, value double", "place": "x double, y double, width double, height double, keys array<long>, doubles array<double>, names string"}
_BOUNDS, _FLOAT = ("row_lo", "row_hi", "col_lo", "col_hi"), pa.float64()
_KINDS = {"cells": pa.schema([("row", pa.int64()), ("col", pa.int64()), ("value", _FLOAT)]), "place": pa.schema([*((c, _FLOAT) for c in ("x", "y", "width", "height")), ("keys", pa.list_(pa.int64())), ("doubles", pa.list_(_FLOAT)), ("names", pa.string())])}


class Ranged:
    """Slices of an open file; the first bytes are read once."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()
        self.head = file.read_at(min(HEAD, self.size), 0)

    def __getitem__(self, part: slice) -> bytes:
        lo, hi, _ = part.indices(self.size)
        return self.head[lo:hi] if hi <= len(self.head) else self.file.read_at(max(0, hi - lo), lo)


@dataclass(frozen=True)
class Window:
    """Least and greatest row and col that are asked for."""

    row_lo: float = -np.inf
    row_hi: float = np.inf
    col_lo: float = -np.inf
    col_hi: float = np.inf

    def meets(self, row: int, col: int, rows: int, cols: int) -> bool:
        return row <= self.row_hi and row + rows > self.row_lo and col <= self.col_hi and col + cols > self.col_lo


def layout(data) -> tiff.Layout | hfa.Layout:
    """What a file says of its blocks, by its first bytes."""
    return hfa.Layout(data) if data[: len(hfa.MARK)] == hfa.MARK else tiff.Layout(*tiff.fields(data))


def cells(data, band: int, window: Window = Window(), share: tuple[int, int] = (0, 1)) -> Iterator[pa.RecordBatch]:
    """The cells of a file's blocks that the window meets; of share (k, n) only the k-th of n parts of the blocks."""
    found = layout(data)
    k, n = share
    every = list(found.blocks(band))
    for b in every[len(every) * k // n : len(every) * (k + 1) // n]:
        row0, col0 = b.row + found.row0, b.col + found.col0
        if not window.meets(row0, col0, b.rows, b.cols):
            continue
        values = found.values(data[b.at : b.at + b.size], b, band)
        r, c = np.nonzero(found.there(values))
        for i in range(0, len(r), CELLS):
            at = slice(i, i + CELLS)
            yield pa.RecordBatch.from_arrays([pa.array(r[at] + row0), pa.array(c[at] + col0), pa.array(values[r[at], c[at]].astype(np.float64))], schema=_KINDS["cells"])


def place(data) -> Iterator[pa.RecordBatch]:
    """A row: where the file's grid lies."""
    geo = layout(data).geo
    yield pa.RecordBatch.from_pylist([{**vars(geo), "keys": list(geo.keys), "doubles": list(geo.doubles)}], _KINDS["place"])


def files_under(uri: str) -> list[tuple[str, int]]:
    """Path and size of the files under an URI of Arrow that hold bytes and aren't hidden, in order."""
    fs, base = pafs.FileSystem.from_uri(uri)
    there = fs.get_file_info(base)
    found = [there] if there.is_file else fs.get_file_info(pafs.FileSelector(base, recursive=True))
    hidden = re.compile(r"(^|/)[._][^/]*(/|$)")
    return sorted((f.path, f.size) for f in found if f.is_file and f.size and not hidden.search(f.path[len(base) :]))


@dataclass
class Part(InputPartition):
    """Files, and which share (k, n) of the blocks of each."""

    files: list[str]
    share: tuple[int, int]


def parts(files: list[tuple[str, int]], task_bytes: int) -> list[Part]:
    """Partitions of files (path, size) of about task_bytes: small files together, large ones in shares."""
    out: list[Part] = []
    held, have = [], 0
    for path, size in files:
        n = -(-size // task_bytes)
        if n > 1:
            out += [Part([path], (k, n)) for k in range(n)]
            continue
        if held and have + size > task_bytes:
            out.append(Part(held, (0, 1)))
            held, have = [], 0
        held.append(path)
        have += size
    return out + ([Part(held, (0, 1))] if held else [])


class Blocks(DataSource):
    """Options: path (an URI of Arrow), what (cells or place), band, task_bytes and the bounds of a Window."""

    @classmethod
    def name(cls) -> str:
        return "canoply_raster"

    def schema(self) -> str:
        return SCHEMAS[self.options["what"]]

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.what, self.band, self.task_bytes = options["path"], options["what"], int(options["band"]), int(options["task_bytes"])
        self.window = Window(*(float(options[k]) for k in _BOUNDS))

    def partitions(self) -> list[Part]:
        return parts(files_under(self.path), self.task_bytes if self.what == "cells" else 1 << 62)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for path in partition.files:
            with fs.open_input_file(path) as file:
                data = Ranged(file)
                yield from cells(data, self.band, self.window, partition.share) if self.what == "cells" else place(data)


def arrow_uri(spark: SparkSession, path: str) -> str | None:
    """path as an URI of Arrow; None if Arrow can't open it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    scheme, _, rest = full.partition(":")
    if scheme not in SCHEMES or re.search(r"[*?\[{]", rest):
        return None
    uri = f"{SCHEMES[scheme]}://{rest.removeprefix('//')}"
    try:
        pafs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError):
        return None
    return uri


def table(spark: SparkSession, path: str, what: str, band: int = 1, task_bytes: int = TASK_BYTES, window: Window = Window()) -> DataFrame:
    """The cells of all files under path in a window, or where the files' grids lie."""
    uri = arrow_uri(spark, path)
    if uri:
        spark.dataSource.register(Blocks)
        bounds = {k: str(getattr(window, k)) for k in _BOUNDS}
        found = spark.read.format(Blocks.name()).options(what=what, band=band, task_bytes=task_bytes, **bounds).load(uri)
    else:

        def rows(it):
            for b in it:
                for x in b.column("content"):
                    data = bytes(x.as_buffer())
                    yield from cells(data, band, window) if what == "cells" else place(data)

        found = spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(rows, SCHEMAS[what])
    if window == Window() or what != "cells":
        return found
    return found.where(F.col("row").between(window.row_lo, window.row_hi) & F.col("col").between(window.col_lo, window.col_hi))
