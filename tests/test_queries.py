"""Every core query against its SQL; those without SQL give rows."""

from __future__ import annotations

import pytest
from oracle import difference

from quillgraph.plans import catalog


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLES:
        assert difference(df, sf_dir, catalog.ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
