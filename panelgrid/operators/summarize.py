"""Summary tables: counts, shares, histograms, box statistics, reshaping."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.functions.columns import ratio
from panelgrid.operators.grouping import attach_stats, join_reduced
from panelgrid.operators.radix import exact_quantiles


def class_counts(df: DataFrame, by: Sequence[str], distinct: str | None = None) -> DataFrame:
    """Rows (and distinct values of a column) per class; NULL classes are left out."""
    for b in by:
        df = df.where(F.col(b).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n")]
    if distinct:
        aggs.append(F.countDistinct(distinct).alias("n_distinct"))
    return df.groupBy(*by).agg(*aggs)


def sites_by_months(df: DataFrame, months: str = "avail_months", key: str = "site") -> DataFrame:
    """Sites sorted by record length, longest first."""
    return df.orderBy(F.desc(months), key)


def class_share(df: DataFrame, by: str, measures: dict[str, Column]) -> DataFrame:
    """Percent of each column total per class, in long form: class, type, percent."""
    table = df.groupBy(by).agg(*[c.alias(n) for n, c in measures.items()])
    total = table.agg(*[F.sum(n).alias(n) for n in measures])
    parts = [F.struct(F.lit(n).alias("type"),
                      ratio(F.col(n) * 100.0, total.select(n).scalar()).alias("percent"))
             for n in measures]
    return (table.select(by, F.explode(F.array(*parts)).alias("p")).select(by, "p.*")
            .where(F.col("percent").isNotNull()))


def pivot_counts(df: DataFrame, by: Sequence[str], column: str, values: Sequence,
                 others: str | None = None) -> DataFrame:
    """Counts per group with one column per listed value, 0 where there is none.

    ``others`` names a column for rows of any other value or none, which are not counted without it.
    """
    listed = [F.count_if(F.col(column).eqNullSafe(F.lit(v))).alias(str(v)) for v in values]
    if others:
        rest = ~F.coalesce(F.col(column).isin(list(values)), F.lit(False))
        listed.append(F.count_if(rest).alias(others))
    return df.groupBy(*by).agg(*listed)


def pivot_values(df: DataFrame, by: Sequence[str], column: str, values: Sequence,
                 value: str) -> DataFrame:
    return df.groupBy(*by).pivot(column, list(values)).agg(F.max(value))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable",
         value: str = "value", drop_null: bool = False) -> DataFrame:
    out = df.unpivot(list(ids), list(values), name, value)
    return out.where(F.col(value).isNotNull()) if drop_null else out


def confusion_matrix(df: DataFrame, truth: str = "truth", pred: str = "pred",
                     dense: bool = True) -> DataFrame:
    """Share of each predicted label within its true label, in long form.

    ``dense`` lists every pair of labels with 0 for pairs that do not occur; labels are the
    sorted union of both columns. Both sides are class vocabularies; for columns with very many
    values use ``dense=False``, which lists occurring pairs only.
    """
    pairs = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    counts = pairs.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))
    if dense:
        labels = (counts.select(F.explode(F.array("truth", "pred")).alias("truth")).distinct())
        every = labels.agg(F.array_sort(F.collect_set("truth"))).scalar()
        grid = labels.select("truth", F.explode(every).alias("pred"))
        counts = grid.join(counts, ["truth", "pred"], "left").na.fill(0, ["n"])
    row = counts.groupBy("truth").agg(F.sum("n").alias("_total"))
    return counts.join(row, "truth").select(
        "truth", "pred", "n", F.coalesce(ratio("n", "_total"), F.lit(0.0)).alias("share"))


def _bin(value: str, lo: float, hi: float, n_bins: int, right_closed: bool) -> Column:
    """0-based bin inside [lo, hi], NULL outside; the last bin takes the value ``hi``."""
    v = F.col(value)
    raw = F.floor((v - F.lit(float(lo))) / F.lit((hi - lo) / n_bins)).cast("int")
    inside = (v >= lo) & ((v <= hi) if right_closed else (v < hi))
    return F.when(inside, F.least(raw, F.lit(n_bins - 1)))


def histogram(df: DataFrame, value: str, lo: float, hi: float, n_bins: int,
              by: Sequence[str] = (), decimals: int | None = None) -> DataFrame:
    """Counts, density and Poisson errors per bin: every bin of every group, empty ones too.

    The last bin includes ``hi``; density is over the values inside the range. ``decimals`` rounds
    first: a computed value that lies exactly on a bin edge has a last digit that depends on the
    order of summation, and would otherwise change bin with the partitioning.
    """
    by = list(by)
    if decimals is not None:
        df = df.withColumn(value, F.round(value, decimals))
    width = (hi - lo) / n_bins
    counts = (df.select(*by, _bin(value, lo, hi, n_bins, True).alias("bin"))
              .where(F.col("bin").isNotNull()).groupBy(*by, "bin")
              .agg(F.count(F.lit(1)).alias("n")))
    groups = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    bins = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    n = F.coalesce("n", F.lit(0))
    density = n / (F.col("_total") * F.lit(width))
    return bins.join(counts, [*by, "bin"], "left").select(
        *by, "bin", (F.lit(float(lo)) + F.col("bin") * width).alias("lo"),
        (F.lit(float(lo)) + (F.col("bin") + 1) * width).alias("hi"), n.alias("n"),
        density.alias("density"), F.sqrt(n.cast("double")).alias("err"),
        F.sqrt(density * width).alias("density_err"))


def binned_shares(df: DataFrame, value: str, parts: Sequence[str], lo: float, hi: float,
                  n_bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Sums of the part columns per bin as shares of their total; the value ``hi`` is out."""
    b = (df.withColumn("bin", _bin(value, lo, hi, n_bins, False))
         .where(F.col("bin").isNotNull()).groupBy(*by, "bin")
         .agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).alias(p) for p in parts]))
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    width = (hi - lo) / n_bins
    return b.select(*by, "bin", (F.lit(float(lo)) + F.col("bin") * width).alias("lo"),
                    (F.lit(float(lo)) + (F.col("bin") + 1) * width).alias("hi"),
                    (F.lit(float(lo)) + (F.col("bin") + 0.5) * width).alias("mid"), "n",
                    *[ratio(p, total).alias(p) for p in parts])


def density_2d(df: DataFrame, x: str, y: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts on a square grid of the given cell width."""
    cell = [F.floor(F.col(c) / F.lit(width)).alias(n) for c, n in ((x, "ix"), (y, "iy"))]
    return (df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, *cell)
            .agg(F.count(F.lit(1)).alias("n")))


def quantiles(df: DataFrame, value: str, probs: Sequence[float] = (0, .25, .5, .75, 1),
              by: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Exact quantiles per group, or mergeable sketches when ``approximate``."""
    if approximate:
        a = F.percentile_approx(value, [float(p) for p in probs], 10000).alias("q")
        s = df.groupBy(*by).agg(F.count(value).alias("n"), a)
        return s.select(*by, "n", *[F.get("q", F.lit(i)).alias(f"q{i}")
                                    for i in range(len(probs))])
    return exact_quantiles(df, value, probs, by)


def density_levels(df: DataFrame, x: str, y: str, step: float, bandwidth: float,
                   levels: Sequence[float] = (0.25, 0.5, 0.75), by: Sequence[str] = (),
                   reach: float = 4.0) -> DataFrame:
    """Level sets of a Gaussian kernel density: ``by``, ``level``, ``threshold``, ``cells``, ``mass``.

    Each point is shared among the four grid nodes around it, then the counts are smoothed along one axis
    and the other, ``reach`` bandwidths far; the points are not read again. ``threshold`` is the largest
    density above which at least ``1 - level`` of the mass lies, ``cells`` and ``mass`` say how many
    nodes and how much of it lie there. A level's window sees one row per grid node, whatever the data.
    """
    by = list(by)
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    u, v = F.col(x) / step, F.col(y) / step
    ix, iy = F.floor(u), F.floor(v)
    corners = F.array(*[F.struct((ix + dx).alias("ix"), (iy + dy).alias("iy"), (
        (u - ix if dx else 1 - (u - ix)) * (v - iy if dy else 1 - (v - iy))).alias("w"))
        for dx in (0, 1) for dy in (0, 1)])
    nodes = known.select(*by, F.explode(corners).alias("c")).groupBy(*by, "c.ix", "c.iy").agg(
        F.sum("c.w").alias("w")).where("w > 0")
    far = math.ceil(reach * bandwidth / step)
    raw = [math.exp(-((o * step / bandwidth) ** 2) / 2) for o in range(-far, far + 1)]
    kernel = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(g / sum(raw)).alias("g"))
                       for o, g in zip(range(-far, far + 1), raw)])
    for axis, other in (("ix", "iy"), ("iy", "ix")):
        nodes = (nodes.select(*by, axis, other, "w", F.explode(kernel).alias("k"))
                 .groupBy(*by, (F.col(axis) + F.col("k.o")).alias(axis), other)
                 .agg(F.sum(F.col("w") * F.col("k.g")).alias("w")))
    # equal densities enter together
    ranked = nodes.groupBy(*by, "w").agg(F.count(F.lit(1)).alias("nodes"))
    w = Window.partitionBy(*by).orderBy(F.desc("w"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("w") * F.col("nodes")
    sums = ranked.select(*by, "w", F.sum(mass).over(upto).alias("above"), F.sum("nodes").over(upto).alias("cells"),
                         F.sum(mass).over(Window.partitionBy(*by)).alias("total"))
    wanted = sums.withColumn("level", F.explode(F.array(*[F.lit(float(p)) for p in levels])))
    # rounding in the last digits must not decide
    enough = F.col("above") >= (1 - F.col("level")) * F.col("total") * (1 - 1e-12)
    best = wanted.where(enough).groupBy(*by, "level").agg(F.max(F.struct("w", "cells", "above", "total")).alias("m"))
    return best.select(*by, "level", (F.col("m.w") / (F.col("m.total") * step * step)).alias("threshold"),
                       F.col("m.cells").alias("cells"), (F.col("m.above") / F.col("m.total")).alias("mass"))


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at 1.5 times the quartile range and the number of points beyond."""
    by = list(by)
    q = exact_quantiles(df, value, [.25, .5, .75], by).select(
        *by, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    v = F.col(value)
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return (join_reduced(df.where(v.isNotNull()).select(*by, value), q, by, "inner")
            .groupBy(*by, "n", "q1", "median", "q3").agg(
                F.least(F.min(F.when(inside, v)), F.col("q1")).alias("whisker_low"),
                F.greatest(F.max(F.when(inside, v)), F.col("q3")).alias("whisker_high"),
                F.sum(F.when(inside, 0).otherwise(1)).alias("outliers")))


def best_per_group(df: DataFrame, by: Sequence[str], score: str, ties: Sequence[str],
                   keep: Sequence[str]) -> DataFrame:
    """The row with the lowest score per group; ``ties`` decide between equal scores."""
    row = F.struct(score, *ties, *[k for k in keep if k not in ties])
    picked = df.where(F.col(score).isNotNull()).groupBy(*by).agg(F.min(row).alias("_r"))
    return picked.select(*by, f"_r.{score}", *[f"_r.{k}" for k in keep])


def minmax_scale(df: DataFrame, value: str, by: Sequence[str], out: str = "scaled") -> DataFrame:
    """(x - min) / (max - min) within each group; NULL when all values are equal."""
    j = attach_stats(df, by, _lo=F.min(value), _hi=F.max(value))
    return j.withColumn(out, ratio(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
                        ).drop("_lo", "_hi")


def time_since_start(df: DataFrame, ts: str, by: Sequence[str],
                     out: str = "seconds") -> DataFrame:
    """Seconds since the first timestamp of the group."""
    j = attach_stats(df, by, _t0=F.min(ts))
    micros = F.expr(f"timestampdiff(MICROSECOND, _t0, `{ts}`)")
    return j.withColumn(out, micros / 1e6).drop("_t0")


def importance_by_family(df: DataFrame, rep: str = "rep", family: str = "family",
                         importance: str = "importance") -> DataFrame:
    return df.groupBy(rep, family).agg(F.sum(importance).alias("importance"))


def model_family(name: Column | str, parts: int = 1, sep: str = "_") -> Column:
    """The first parts of a model name, joined by blanks."""
    c = F.col(name) if isinstance(name, str) else name
    return F.array_join(F.slice(F.split(c, sep), 1, parts), " ")


def learning_curve(df: DataFrame, score: str = "ensemble_optimization_score", time: str = "ts",
                   by: Sequence[str] = ("rep", "fold")) -> DataFrame:
    """Seconds since the search of a fold began, the error then, and the least error so far.

    The score is a negative error. A curve has one row per candidate a single search has tried.
    """
    curve = time_since_start(df.where(F.col(time).isNotNull()), time, by).withColumn("error", -F.col(score))
    w = Window.partitionBy(*by).orderBy("seconds").rangeBetween(Window.unboundedPreceding, 0)
    return curve.select(*by, "seconds", "error", F.min("error").over(w).alias("best"))
