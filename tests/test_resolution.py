"""The fine resolution is the mean of every repetition."""

from collections import Counter

from pyspark.sql import functions as F

from panelgrid.plans.catalog import ORACLE, QUERIES
from panelgrid.plans.views import Views

SF_DIR = "/root/testdata/sf0.001"


def test_all_repetitions_are_averaged(spark):
    reps = Views(spark, SF_DIR).site_month_rep
    assert reps.select("rep").distinct().count() == 7
    mean = reps.groupBy("site", "date").agg(F.round(F.avg("pred"), 6).alias("m"))
    got = QUERIES["resolution_total_all"](spark, SF_DIR).filter("resolution = 'fine'")
    near = lambda x: None if x is None else round(x, 4)
    assert Counter(near(r["value"]) for r in got.collect()) == Counter(near(r.m) for r in mean.collect())


def test_twins_take_all_repetitions():
    for name in ("total", "msc", "trend", "anomalies"):
        assert "rep <= 3" not in ORACLE[f"resolution_{name}_all"]
        assert "rep <= 3" in ORACLE[f"resolution_{name}"]  # registered before, as it was
