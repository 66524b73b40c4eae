"""A list of files as a one-column table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def add(files: DataFrame, new: DataFrame) -> DataFrame:
    """Without repeats, sorted."""
    return files.unionByName(new).distinct().orderBy("path")


def remove(files: DataFrame, selected: DataFrame) -> DataFrame:
    return files.join(selected, "path", "left_anti")


def clear(files: DataFrame) -> DataFrame:
    return files.limit(0)


def replace(files: DataFrame, new: DataFrame) -> DataFrame:
    """The new list as it is, repeats and order kept."""
    return new.select("path")


def read(files: DataFrame) -> DataFrame:
    """The list as it stands."""
    return files.select("path")
