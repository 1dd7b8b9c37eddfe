"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tabwright import catalog
from tools.compare import compare, connect

QUERIES, SQL = catalog.load()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, duck, name):
    note, _, _ = compare(spark, duck, sf, name, QUERIES[name], SQL[name])
    assert note.startswith("ok"), note


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry
    rows = entry.entry(spark).collect()
    assert {r["metric"] for r in rows} == {"accuracy", "log_loss", "roc_auc"}
