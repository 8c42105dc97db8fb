"""Facts are summed from the sales lines once for each query."""

import pytest

from stratacast.plans import panels, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("make", [panels.daily_facts, panels.monthly_facts, panels.daily_panel, panels.monthly_panel])
def test_facts_and_panels_rest_on_a_written_table(spark, make):
    assert not [f for f in make(spark, SF).inputFiles() if "lineitem" in f]


@pytest.mark.parametrize("name", ["product_table", "forecast_set"])
def test_sales_lines_are_read_once(spark, monkeypatch, name):
    read, plain = [], panels.table

    def counted(spark, sf_dir, name):
        read.append(name)
        return plain(spark, sf_dir, name)

    monkeypatch.setattr(panels, "table", counted)
    out = queries.QUERIES[name](spark, SF)
    assert read.count("lineitem") == 1 and not [f for f in out.inputFiles() if "lineitem" in f]
