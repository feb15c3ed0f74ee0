"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from sql_compare import DATA, compare

from colloquy.plans import catalog

EMPTY_IS_FINE = {"lexicon_offsets", "idle_upsell"}


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, name):
    rows = compare(spark, name, catalog.queries()[name], catalog.oracle_sql()[name], DATA)
    assert rows or name in EMPTY_IS_FINE


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
