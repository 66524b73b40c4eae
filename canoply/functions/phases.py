"""Rules between the phases of a run and the options that depend on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a configuration change can touch; a flag's bit is its place.
FLAGS = (
    "SettingsFile", "DoSmoothing", "DoTops", "DoCrowns", "OriginalCHM", "SmoothedCHM", "TopsThresholds", "TreetopsDatabase", "TreetopsDatabaseDriver", "CrownsDoDatabase",
    "CrownsDatabase", "CrownsDatabaseDriver", "CrownsRaster", "CrownsThresholds", "CrownsKeepSmoothed", "TopsDBFormatChanged", "CrownsDBFormatChanged",
)


def after_tops(tops: Column, crowns: Column) -> Column:
    """Crowns after the tops switch changed: off without tops."""
    return tops & crowns


def after_crowns(tops: Column, crowns: Column) -> Column:
    """Tops after the crowns switch changed: on with crowns."""
    return tops | crowns


def shape_options(crowns: Column, database: Column) -> Column:
    """Whether holes and dangles can be chosen."""
    return crowns & database


def can_run(smoothing: Column, tops: Column, crowns: Column, original: Column, smoothed: Column, database: Column, raster: Column, valid_tops: Column, valid_crowns: Column) -> Column:
    """Something is on, and each phase has its inputs, outputs and valid thresholds."""

    def named(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) != ""

    first = ~smoothing | (named(original) & named(smoothed))
    second = ~tops | (named(smoothed) & named(database) & valid_tops)
    third = ~crowns | (named(original) & named(smoothed) & named(database) & named(raster) & valid_crowns)
    return (smoothing | tops | crowns) & first & second & third


def changed(mask: Column) -> Column:
    """The names of the flags in a change mask, in the flags' order."""
    named = F.array(*(F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(FLAGS)))
    return F.array_compact(named)
