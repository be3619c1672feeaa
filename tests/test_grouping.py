import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelgrid.operators import grouping as G


def test_known_neighbours_across_blocks(spark):
    r = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": np.repeat(["x", "y"], 200), "t": np.tile(np.arange(200), 2),
                        "v": np.where(r.random(400) < 0.8, np.nan, r.random(400))})
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    got = G.known_neighbours(df, ["v"], ["t"], F.floor(F.col("t") / 10), ["k"]).toPandas()
    got = got.sort_values(["k", "t"]).reset_index(drop=True)
    g = pdf.groupby("k").v
    pd.testing.assert_series_equal(got.prev_v, g.ffill(), check_names=False)
    pd.testing.assert_series_equal(got.next_v, g.bfill(), check_names=False)


def test_weighted_positions_tile_the_line(spark):
    df = spark.range(500).select("id", (F.col("id") % 7 + 1).alias("w"))
    p = G.weighted_positions(df, ["id"], "w").toPandas().sort_values("start")
    assert p.total.nunique() == 1 and p.total.iloc[0] == p.w.sum()
    assert list(p.ordinal) == list(range(500)) and (p.n_items == 500).all()
    assert np.allclose(p.start + p.w, list(p.start[1:]) + [p.w.sum()])


def test_attach_stats_null_key(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 9.0)], "k string, v double")
    got = {(r["k"], r["v"]): r["m"] for r in G.attach_stats(df, ["k"], m=F.avg("v")).collect()}
    assert got == {("a", 1.0): 2.0, ("a", 3.0): 2.0, (None, 9.0): None}
