"""Every registered query: values against its SQL twin, and its plan.

Plans must not hide a Cartesian product or leave the JVM on the data path, neither the last one nor
those of the tables that operators write on the way.
"""

import os
import re

import pytest
from compare import compare, connect
from pyspark.sql import DataFrameWriter

from panelgrid.plans.catalog import ORACLE, QUERIES

SF_DIR = f"/root/testdata/sf{os.environ.get('TEST_SF', '0.01')}"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """Plans of the tables that operators write on the way."""
    plans, real = [], DataFrameWriter.parquet

    def spy(self, *args, **kwargs):
        plans.append(plan_of(self._df))
        return real(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    return plans


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name, written):
    def inspect(df):
        for text in [*written, plan_of(df)]:
            assert "CartesianProduct" not in text
            assert "BroadcastNestedLoopJoin" not in text
            if name in ORACLE:
                assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups", text)

    assert compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF_DIR, inspect) is None


def test_scan_reads_only_needed_columns(spark):
    text = plan_of(QUERIES["rep_mean"](spark, SF_DIR))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_suppkey", "l_linenumber",
                                                            "l_quantity", "l_shipdate"}


def test_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() == 7 and len(df.columns) == 11
    assert set(e.oracle_sql()) <= set(e.queries())
