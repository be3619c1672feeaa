"""Stored cubes, merged moments, array tiles and density level sets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelgrid.operators import grid, maps, moments, summarize, tiles
from panelgrid.sources import stored

DDL = "lat double, lon double, time date, rep int, v double"


@pytest.fixture(scope="module")
def ensemble(spark):
    """Five repetitions of cells with gaps, one cell without any value, one with huge values."""
    r = np.random.default_rng(5)
    rows = [(float(a), float(o), f"{y}-{m:02d}-28", k,
             None if (a, o) == (1, 2) or r.random() < .1 else float(r.normal() + (1e5 if a == 2 else 0)))
            for a in range(3) for o in range(4) for y in (2001, 2002, 2003) for m in (1, 7)
            for k in range(5)]
    pdf = pd.DataFrame(rows, columns=["lat", "lon", "time", "rep", "v"])
    df = spark.createDataFrame([tuple(None if isinstance(x, float) and np.isnan(x) else x for x in t)
                                for t in pdf.itertuples(index=False)],
                               DDL.replace("date", "string")).withColumn("time", F.to_date("time"))
    return df.cache()


def values(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_cubes_are_not_shuffled(spark, ensemble, tmp_path):
    a = stored.store_by_cell(ensemble, "cube_a", str(tmp_path / "a"), 4)
    b = stored.store_by_cell(ensemble.where("rep = 1"), "cube_b", str(tmp_path / "b"), 4)
    cell = stored.STORED_CELL
    mean, merged = stored.in_degrees(maps.map_mean(a, cell=cell)), stored.merge_stored({"a": a, "b": b})
    joined = a.join(b.select(*cell, F.col("v").alias("w")), list(cell))
    for df in (mean, merged, joined, maps.map_anomalies(a, cell=cell), maps.map_err(a, cell=cell)):
        assert "Exchange hashpartitioning" not in plan(df) and "SinglePartition" not in plan(df)
    want = values(maps.map_mean(ensemble), "lat", "lon")
    assert {k: v["mean"] for k, v in values(mean, "lat", "lon").items()} == pytest.approx(
        {k: v["mean"] for k, v in want.items()}, nan_ok=True)
    key = ("lat", "lon", "time")
    assert values(merged, *key) == values(grid.merge_grids({"a": ensemble, "b": ensemble.where("rep = 1")}), *key)


@pytest.mark.parametrize("order", [[[0, 1, 2, 3, 4]], [[3], [0, 4], [1], [2]]])
def test_moments_grow(spark, ensemble, tmp_path, order):
    """Whatever the order, the maps of merged moments equal those of the whole ensemble."""
    for reps in order:
        m = stored.merge_repetitions(ensemble.where(F.col("rep").isin(reps)), str(tmp_path))
    pairs = [(moments.map_err(m), maps.map_err(ensemble), "std_err"),
             (moments.map_err(m, relative=True), maps.map_err(ensemble, relative=True), "std_err_pct"),
             (moments.map_mean(m), maps.map_mean(ensemble), "mean"),
             (maps.map_msc(moments.ensemble_mean(m)), maps.map_msc(ensemble), "amplitude"),
             (maps.map_trend(moments.ensemble_mean(m)), maps.map_trend(ensemble), "all_slopes")]
    for got, want, name in pairs:
        got, want = (values(x, "lat", "lon") for x in (got, want))
        assert got.keys() == want.keys()
        for k in want:
            x, y = got[k][name], want[k][name]
            assert x is y is None or x == pytest.approx(y, rel=1e-6, abs=1e-6)
    with pytest.raises(ValueError):
        stored.merge_repetitions(ensemble.where("rep = 2"), str(tmp_path))


def test_a_run_that_dies_leaves_the_old_state(spark, ensemble, tmp_path):
    path = str(tmp_path)
    before = values(stored.merge_repetitions(ensemble.where("rep < 2"), path), "lat", "lon", "time")
    # written, but not listed
    ensemble.limit(3).write.parquet(path + "/moments-2")
    assert values(stored.read_moments(spark, path), "lat", "lon", "time") == before
    m = stored.merge_repetitions(ensemble.where("rep >= 2"), path)
    assert {k: v["n"] for k, v in values(m, "lat", "lon", "time").items()} == {
        k: v["n"] for k, v in values(moments.ensemble_moments(ensemble), "lat", "lon", "time").items()}


@pytest.mark.parametrize("height,width", [(2, 3), (1, 1), (5, 9)])
def test_tiles_and_back(ensemble, height, width):
    t = tiles.Tiling(0.0, 1.0, 0.0, 1.0, height, width)
    cube = tiles.cube_tiles(ensemble, t)
    assert {len(r["cells"]) for r in cube.collect()} == {height * width}
    key = ("lat", "lon", "time", "rep")
    want = values(ensemble.where("v is not null"), *key)
    assert values(tiles.tiles_to_long(cube, t), *key) == want
    mean = values(tiles.tiles_to_long(tiles.tile_mean(cube), t, ["time"]), *key[:3])
    for k, r in values(maps.rep_mean(ensemble.where("v is not null")), *key[:3]).items():
        assert mean.pop(k)["v"] == pytest.approx(r["v"])
    assert not mean


def test_density_levels(spark):
    """Mass and thresholds against the whole kernel sum on the grid."""
    r = np.random.default_rng(2)
    pts = np.vstack([r.normal(size=(200, 2)), [[4.2, -3.1]]])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts] + [(None, 1.0)], "a double, b double")
    step, width = 0.5, 1.0
    rows = {x.level: x for x in summarize.density_levels(df, "a", "b", step, width).collect()}
    grid_ = np.zeros((80, 80))
    for a, b in pts / step + 40:
        i, j = int(np.floor(a)), int(np.floor(b))
        for di, wi in ((0, 1 - (a - i)), (1, a - i)):
            for dj, wj in ((0, 1 - (b - j)), (1, b - j)):
                grid_[i + di, j + dj] += wi * wj
    o = np.arange(-8, 9)
    k = np.exp(-((o * step / width) ** 2) / 2)
    k /= k.sum()
    for axis in (0, 1):
        grid_ = np.apply_along_axis(lambda line: np.convolve(line, k, "same"), axis, grid_)
    dense = np.sort(grid_[grid_ > 0])[::-1]
    share = np.cumsum(dense) / dense.sum()
    for level, x in rows.items():
        at = int(np.argmax(share >= (1 - level) * (1 - 1e-12)))
        assert x.cells == at + 1 and x.mass == pytest.approx(share[at])
        assert x.threshold == pytest.approx(dense[at] / (len(pts) * step * step))
    assert rows[0.25].threshold < rows[0.75].threshold
    assert summarize.density_levels(df.limit(0), "a", "b", step, width).count() == 0
