"""Every query against its SQL counterpart, and the contract of the entry module."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from canoply.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, compare, data, name):
    folder = f"{data}/sf0.001"
    df = registry.QUERIES[name](spark, folder)
    if name in registry.ORACLES:
        n = compare(df, registry.ORACLES[name], folder)
    else:
        n = df.count()
    assert n or name == "filelist_clear"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
