"""How often a product is read, counted over every plan that runs, those inside operators too."""

import re

import pytest
from pyspark.sql import DataFrameWriter

from panelgrid.plans.catalog import QUERIES
from panelgrid.plans.views import Views

SF = "/root/testdata/sf0.001"


@pytest.fixture
def scans(monkeypatch):
    """Scans of lineitem in the plans of all written tables; the result is added by the test."""
    texts = []
    real = DataFrameWriter.parquet

    def spy(self, *args, **kwargs):
        texts.append(plan(self._df))
        return real(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    return texts


def plan(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    # a reused part is printed again, but not run again
    return re.sub(r"ReusedExchange.*", "", text)


def count(texts):
    return sum(len(re.findall(r"FileScan parquet [^\n]*lineitem\.parquet", t)) for t in texts)


@pytest.mark.parametrize("name", ["loc_r2_all", "compare_at_locations_all", "product_ranksum_all"])
def test_products_are_read_once_each(spark, scans, name):
    df = QUERIES[name](spark, SF)
    assert count([*scans, plan(df)]) == 3


def test_snap_reads_each_table_twice_at_most(spark, scans):
    from panelgrid.operators import grid
    v = Views(spark, SF)
    df = grid.nearest_snap(v.ens.drop("v"), v.prod_b, ["v"], ["time"])
    assert count([*scans, plan(df)]) == 4
