"""Every query with an SQL equivalent gives DuckDB's rows; the others run."""

import pytest
from conftest import same

from stratacast.plans import queries as core

SLOW = {n for n in core.QUERIES if n.startswith("boost_")} - {"boost_bu_objhse_evalhmse_withtemp", "boost_sepagg_objse_evalmse"}


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_matches_duckdb(spark, duck, sf_dir, name):
    same(core.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(core.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES) - SLOW))
def test_runs(spark, sf_dir, name):
    out = core.QUERIES[name](spark, sf_dir).toPandas()
    assert len(out) and not out.isna().any().any()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
