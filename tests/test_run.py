"""Whole runs and their configuration."""

from __future__ import annotations

import pytest

from canoply.functions import config
from canoply.plans import fixtures
from canoply.plans.run import Cancelled, run

FULL = config.Config(original="chm", do_smoothing=True, do_tops=True, top_thresholds=((5.0, 3), (12.0, 5)), do_crowns=True, crown_thresholds=((5.0, 0.5, 3.0),), update_heights=True, polygons=True, remove_dangles=True, remove_holes=True, keep_smoothed=True)


def test_run(spark, data):
    told = []
    got = run(FULL, fixtures.chm(spark, f"{data}/sf0.001"), told=lambda s, m: told.append((round(s, 2), m)))
    assert told == [(0.33, "smoothed"), (0.67, "tops found"), (1.0, "crowns grown")]
    tops = {r.top_id: r for r in got.tops.collect()}
    shapes = got.shapes.collect()
    assert shapes and {r.crown_id for r in shapes} <= set(tops) and all(r.top_z == tops[r.crown_id].z for r in shapes)


def test_cancel_and_checks(spark, data):
    with pytest.raises(Cancelled):
        run(FULL, fixtures.chm(spark, f"{data}/sf0.001"), cancelled=lambda: True)
    for change in ({"band": 0}, {"original": ""}, {"window": 4}, {"top_thresholds": ()}, {"crown_thresholds": ((5.0, 0.0, 1.0),)}, {"do_smoothing": False, "do_tops": False, "do_crowns": False}):
        with pytest.raises(config.InvalidConfig):
            config.replace(FULL, **change).check()


def test_settings_round_trip(spark, tmp_path):
    config.lines(spark, FULL).coalesce(1).write.text(f"{tmp_path}/s")
    assert config.read(spark, f"{tmp_path}/s") == FULL
    assert config.read(spark, f"{tmp_path}/s", on_existing="reset") == config.Config()
    assert config.updated(FULL, {}).top_thresholds == () and config.updated(FULL, {"smoothSigma": "1.5x"}).sigma == 1.5
