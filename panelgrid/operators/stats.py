"""Rank and mean tests: distributed ranks and sums, one result row per group.

p-values are column expressions on that row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.functions.columns import ratio
from panelgrid.functions.distributions import (chi2_upper, normal_lower, range_quantile,
                                               signed_rank_lower)
from panelgrid.operators.grouping import join_reduced
from panelgrid.operators.radix import value_positions

# Exact signed-rank probabilities are used up to this many untied differences.
EXACT_SIGNED_RANK = 50


def block_ranks(df: DataFrame, block: Sequence[str], metric: str = "metric",
                higher_is_better: bool = True) -> DataFrame:
    """Average rank of each row inside its block; a block holds one row per treatment."""
    best = F.desc(metric) if higher_is_better else F.asc(metric)
    w = Window.partitionBy(*block)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*block, metric))
    return df.withColumn("rank", F.rank().over(w.orderBy(best)) + (ties - 1) / 2)


def complete_blocks(df: DataFrame, block: str, treatment: str, metric: str) -> DataFrame:
    """Blocks in which every treatment has a known metric."""
    known = df.where(F.col(metric).isNotNull())
    k = known.agg(F.countDistinct(treatment)).scalar()
    full = known.groupBy(block).agg(F.countDistinct(treatment).alias("_k")).where(
        F.col("_k") == k).select(block)
    return known.join(full, block, "left_semi")


def mean_ranks(df: DataFrame, block: str = "block", treatment: str = "treatment",
               metric: str = "metric", higher_is_better: bool = True) -> DataFrame:
    """Mean, median-free summary of ranks per treatment over complete blocks."""
    ranked = block_ranks(complete_blocks(df, block, treatment, metric), [block], metric,
                         higher_is_better)
    return ranked.groupBy(treatment).agg(F.avg("rank").alias("mean_rank"),
                                         F.count(F.lit(1)).alias("blocks"))


def friedman(df: DataFrame, block: str = "block", treatment: str = "treatment",
             metric: str = "metric", with_p: bool = True) -> DataFrame:
    """Friedman chi-squared (tie-corrected) and the Nemenyi critical difference at 5 %.

    Two mean ranks differ by more than the critical difference with a chance of 5 %, whatever the
    number of treatments: it comes from the distribution of the range.
    """
    ranked = block_ranks(complete_blocks(df, block, treatment, metric), [block], metric)
    per_treatment = ranked.groupBy(treatment).agg(F.avg("rank").alias("r"),
                                                  F.count(F.lit(1)).alias("n"))
    tied = ranked.groupBy(block, metric).agg(F.count(F.lit(1)).alias("t")).agg(
        F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties")).scalar()
    s = per_treatment.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"),
                          F.sum(F.col("r") * F.col("r")).alias("rr")).withColumn("ties", tied)
    k, n = F.col("k"), F.col("n")
    raw = 12 * n / (k * (k + 1)) * (F.col("rr") - k * (k + 1) * (k + 1) / 4)
    correction = 1 - ratio("ties", n * k * (k * k - 1))
    q = range_quantile(0.95, "k") / F.sqrt(F.lit(2.0))
    out = s.select(F.col("k").alias("treatments"), F.col("n").alias("blocks"),
                   ratio(raw, correction).alias("chi2"),
                   (q * F.sqrt(k * (k + 1) / (6 * n))).alias("critical_difference"))
    if with_p:
        out = out.withColumn("p_value", chi2_upper("chi2", F.col("treatments") - 1))
    return out


def wilcoxon(df: DataFrame, x: str, y: str | None = None, alternative: str = "two-sided",
             with_p: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Signed-rank test of x - y (or of x alone) around zero, one row per group.

    Zero differences are dropped; a group of zeros only has n = 0 and no p-value. Ranks of the absolute
    differences come from value positions, so ties cost nothing and no task sees all rows of a group.
    p is exact up to EXACT_SIGNED_RANK untied differences and normal beyond.
    """
    by = list(by)
    diff = F.col(x) - F.col(y) if y else F.col(x)
    d = df.select(*by, diff.cast("double").alias("d")).where(F.col("d").isNotNull())
    pos = value_positions(d.where(F.col("d") != 0).select(*by, "d", F.abs("d").alias("a")), "a", by,
                          plus=F.sum(F.when(F.col("d") > 0, 1).otherwise(0)))
    t = F.col("cnt")
    rank = F.col("start") + (t + 1) / 2
    s = pos.groupBy(*by).agg(
        F.sum("cnt").alias("n"), F.sum(rank * F.col("plus")).alias("w_plus"),
        F.sum(rank * (t - F.col("plus"))).alias("w_minus"),
        F.sum(F.pow(t, F.lit(3)) - t).alias("ties"))
    if by:
        s = join_reduced(d.select(*by).distinct(), s, by)
    s = s.na.fill(0, ["n", "w_plus", "w_minus", "ties"])
    n = F.col("n").cast("double")
    sd = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    statistic = F.least("w_plus", "w_minus") if alternative == "two-sided" else F.col("w_plus")
    out = s.withColumn("statistic", statistic).withColumn(
        "z", ratio(F.col("statistic") - n * (n + 1) / 4, sd))
    if with_p:
        exact = (F.col("n") <= EXACT_SIGNED_RANK) & (F.col("ties") == 0) & (F.col("n") > 0)
        # 'greater' is the lower tail of the other sum
        side = F.col("w_minus") if alternative == "greater" else F.col("statistic")
        z = -F.col("z") if alternative == "greater" else F.col("z")
        times = 2.0 if alternative == "two-sided" else 1.0
        p = times * F.when(exact, signed_rank_lower("n", side)).otherwise(normal_lower(z))
        out = out.withColumn("p_value", F.when(p.isNotNull(), F.least(F.lit(1.0), p)))
    return out.select(*by, "n", "w_plus", "w_minus", "statistic", "z",
                      *(["p_value"] if with_p else []))


def ranksum(df: DataFrame, a: str, b: str, with_p: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Rank-sum test of two columns as independent samples (ties averaged, no tie correction)."""
    by = list(by)
    long = df.select(*by, F.explode(F.array(
        F.struct(F.lit(1).alias("first"), F.col(a).cast("double").alias("v")),
        F.struct(F.lit(0).alias("first"), F.col(b).cast("double").alias("v")))).alias("s")
    ).select(*by, "s.*")
    pos = value_positions(long, "v", by, firsts=F.sum("first"))
    rank = F.col("start") + (F.col("cnt") + 1) / 2
    s = pos.groupBy(*by).agg(F.sum("firsts").cast("double").alias("n1"),
                             F.sum(F.col("cnt") - F.col("firsts")).cast("double").alias("n2"),
                             F.sum(rank * F.col("firsts")).alias("rank_sum"))
    n1, n2 = F.col("n1"), F.col("n2")
    z = ratio(F.col("rank_sum") - n1 * (n1 + n2 + 1) / 2, F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12))
    out = s.select(*by, n1.cast("bigint").alias("n1"), n2.cast("bigint").alias("n2"), "rank_sum",
                   z.alias("z"))
    if with_p:
        out = out.withColumn("p_value", 2 * normal_lower(-F.abs("z")))
    return out


def ztest(df: DataFrame, a: str, b: str, alternative: str = "smaller",
          with_p: bool = True) -> DataFrame:
    """Two-sample z-test of means with pooled variance."""
    s = df.agg(*[f(F.col(c)).cast("double").alias(f"{n}_{s}") for s, c in (("a", a), ("b", b))
                 for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = ratio((na - 1) * F.col("v_a") + (nb - 1) * F.col("v_b"), na + nb - 2)
    z = ratio(F.col("m_a") - F.col("m_b"), F.sqrt(pooled * (ratio(F.lit(1.0), na)
                                                            + ratio(F.lit(1.0), nb))))
    out = s.select(F.col("m_a").alias("mean_a"), F.col("m_b").alias("mean_b"), z.alias("z"))
    if with_p:
        tail: Column = {"smaller": F.col("z"), "larger": -F.col("z"),
                        "two-sided": -F.abs("z")}[alternative]
        times = 2 if alternative == "two-sided" else 1
        out = out.withColumn("p_value", times * normal_lower(tail))
    return out


def normality(df: DataFrame, value: str, by: Sequence[str] = (), with_p: bool = True) -> DataFrame:
    """Jarque-Bera test from skewness and excess kurtosis, one pass."""
    s = df.groupBy(*by).agg(F.count(value).alias("n"), F.skewness(value).alias("skewness"),
                            F.kurtosis(value).alias("kurtosis"))
    jb = F.col("n") / 6 * (F.pow("skewness", F.lit(2)) + F.pow("kurtosis", F.lit(2)) / 4)
    out = s.withColumn("jb", jb)
    if with_p:
        out = out.withColumn("p_value", chi2_upper("jb", F.lit(2.0)))
    return out
