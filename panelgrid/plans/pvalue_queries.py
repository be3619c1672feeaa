"""Tests with their p-values.

The SQL twins do not know the functions under test: they integrate the densities by Simpson's rule,
count the signed-rank sums one by one, and read the range of many normal values off a fine grid.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelgrid.operators import maps, scores, stats
from panelgrid.plans.registry import i, query, r
from panelgrid.plans.views import sql

#: u from 0 to 1 with Simpson's weights
_SIMPSON = {"simpson": """SELECT range / 2000.0 AS u, (CASE WHEN range IN (0, 2000) THEN 1
    WHEN range % 2 = 1 THEN 4 ELSE 2 END) / 6000.0 AS w FROM range(2001)"""}


def _upper(z: str) -> str:
    """P(Z > z) in SQL."""
    return (f"(SELECT 0.5 - ({z}) / sqrt(2 * pi()) * sum(w * exp(-((u * ({z})) ** 2) / 2)) FROM simpson)")


@query("ztest_p", sql("bench_wide", f"""
    SELECT {r('z', 'z')}, {r(_upper('-z'), 'p_smaller')}, {r(_upper('z'), 'p_larger')},
           {r('2 * ' + _upper('abs(z)'), 'p_value')} FROM s""", {**_SIMPSON, "s": """
    SELECT (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)) AS z
    FROM (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb,
                 CAST(count(a) AS DOUBLE) AS na, CAST(count(b) AS DOUBLE) AS nb FROM bench_wide)"""}))
def ztest_p(v):
    sides = {"smaller": "p_smaller", "larger": "p_larger", "two-sided": "p_value"}
    out = None
    for side, name in sides.items():
        one = stats.ztest(v.bench_wide, "a", "b", side).select("z", F.col("p_value").alias(name))
        out = one if out is None else out.withColumn(name, one.select(name).scalar())
    return out


@query("ranksum_p", sql("bench_wide", f"""
    SELECT {r('z', 'z')}, {r('2 * ' + _upper('abs(z)'), 'p_value')}
    FROM (SELECT (s - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z
          FROM (SELECT CAST(sum(f) AS DOUBLE) AS n1, CAST(sum(1 - f) AS DOUBLE) AS n2,
                       sum(rk * f) AS s FROM ranked))""", {
    **_SIMPSON,
    "vals": """SELECT a AS v, 1 AS f FROM bench_wide WHERE a IS NOT NULL
               UNION ALL SELECT b, 0 FROM bench_wide WHERE b IS NOT NULL""",
    "ranked": """SELECT f, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0
                 AS rk FROM vals"""}))
def ranksum_p(v):
    return stats.ranksum(v.bench_wide, "a", "b").select("z", "p_value")


@query("ranksum_by_rep", sql("site_month_rep", f"""
    SELECT {i('rep', 'rep')}, {i('n1', 'n1')}, {i('n2', 'n2')}, {r('s', 'rank_sum')},
           {r('(s - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12)', 'z')}
    FROM (SELECT rep, CAST(sum(f) AS DOUBLE) AS n1, CAST(sum(1 - f) AS DOUBLE) AS n2,
                 sum(rk * f) AS s FROM ranked GROUP BY rep)""", {
    "vals": "SELECT rep, gt AS v, 1 AS f FROM site_month_rep UNION ALL SELECT rep, pred, 0 FROM site_month_rep",
    "ranked": """SELECT rep, f, rank() OVER (PARTITION BY rep ORDER BY v)
                 + (count(*) OVER (PARTITION BY rep, v) - 1) / 2.0 AS rk FROM vals"""}))
def ranksum_by_rep(v):
    return stats.ranksum(v.site_month_rep, "gt", "pred", with_p=False, by=["rep"])


def _ranked(diffs: str) -> dict[str, str]:
    """Signed ranks of (grp, d) per group, and their sums."""
    return {
        "diffs": diffs,
        "ranked": """SELECT grp, d, rank() OVER (PARTITION BY grp ORDER BY abs(d))
            + (count(*) OVER (PARTITION BY grp, abs(d)) - 1) / 2.0 AS rk,
            count(*) OVER (PARTITION BY grp, abs(d)) AS t FROM diffs WHERE d <> 0""",
        "sums": """SELECT grp, CAST(count(*) AS DOUBLE) AS n, sum(rk) FILTER (d > 0) AS wp,
            sum(rk) FILTER (d < 0) AS wm, sum((t ** 3 - t) / t) AS ties FROM ranked GROUP BY grp""",
        "zs": """SELECT *, sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24.0) AS sd,
            n * (n + 1) / 4.0 AS mid FROM sums"""}


@query("wilcoxon_p", sql("bench_wide", f"""
    SELECT {r(_upper('-(wp - mid) / sd'), 'p_less')}, {r(_upper('(wp - mid) / sd'), 'p_greater')},
           {r('least(1, 2 * ' + _upper('-(least(wp, wm) - mid) / sd') + ')', 'p_value')} FROM zs""", {
    **_SIMPSON, **_ranked("SELECT 0 AS grp, a - b AS d FROM bench_wide WHERE a IS NOT NULL AND b IS NOT NULL")}))
def wilcoxon_p(v):
    """One-sided and two-sided; more than 50 differences, so the normal distribution is used."""
    out = None
    for side, name in (("less", "p_less"), ("greater", "p_greater"), ("two-sided", "p_value")):
        one = stats.wilcoxon(v.bench_wide, "a", "b", side).select(F.col("p_value").alias(name))
        out = one if out is None else out.withColumn(name, one.scalar())
    return out


@query("wilcoxon_by_bin", sql("site_month", f"""
    SELECT {i('grp', 'bin')}, {i('n', 'n')}, {r('wp', 'w_plus')}, {r('wm', 'w_minus')},
           {r('(least(wp, wm) - mid) / sd', 'z')},
           {r('least(1, 2 * ' + _upper('least(-(least(wp, wm) - mid) / sd, 12.0)') + ')', 'p_value')}
    FROM zs""", {**_SIMPSON, **_ranked("""
    SELECT b.range + 1 AS grp, (pred + 0.05 * gt) - gt AS d
    FROM site_month, range(4) b, (SELECT quantile_cont(gt, [0, 0.25, 0.5, 0.75, 1]) AS q FROM site_month) e
    WHERE gt >= q[b.range + 1] AND gt <= q[b.range + 2]""")}))
def wilcoxon_by_bin(v):
    """Whether the (shifted) prediction is biased in each quartile bin of the truth."""
    p = v.site_month.select("gt", (F.col("pred") + 0.05 * F.col("gt")).alias("pred"))
    bins = scores.bias_in_bins(p, "gt", "pred")
    return stats.wilcoxon(bins, "diff", by=["bin"]).select("bin", "n", "w_plus", "w_minus", "z", "p_value")


#: ways to reach each sum with the ranks 1 to n, each taken or not
_WAYS = """WITH RECURSIVE ways(n, s, c) AS (SELECT 0, 0, CAST(1 AS DOUBLE) UNION ALL
    SELECT n + 1, s + b * (n + 1), sum(c) FROM ways, (VALUES (0), (1)) t(b) WHERE n < 14 GROUP BY ALL)
    SELECT n, s, c / 2 ** n AS chance FROM ways"""


@query("wilcoxon_by_year", sql("bench_wide", f"""
    SELECT {i('grp', 'year')}, {i('n', 'n')}, {r('wp', 'w_plus')}, {r('wm', 'w_minus')},
           {r('(SELECT sum(chance) FROM chances c WHERE c.n = z.n AND s <= wm)', 'p_value')}
    FROM zs z""", {"chances": _WAYS, **_ranked("""SELECT year(block) AS grp, a - b AS d FROM bench_wide
    WHERE a IS NOT NULL AND b IS NOT NULL""")}))
def wilcoxon_by_year(v):
    """A dozen differences per year, so p is exact."""
    d = v.bench_wide.withColumn("year", F.year("block"))
    return stats.wilcoxon(d, "a", "b", "greater", by=["year"]).select("year", "n", "w_plus", "w_minus",
                                                                      "p_value")


@query("map_trend_p", sql("ens", f"""
    SELECT {r('lat', 'lat')}, {r('lon', 'lon')}, {r('CASE WHEN p < 0.05 THEN b END', 'slope')},
           {r('b', 'all_slopes')}, {i('n', 'n_years')}, {r('p', 'p_value')}
    FROM f JOIN tails USING (lat, lon)""", {
    **_SIMPSON,
    "e": "SELECT lat, lon, time, avg(v) AS v FROM ens GROUP BY ALL",
    "y": "SELECT lat, lon, year(time) AS y, avg(v) * 372 AS a FROM e GROUP BY ALL",
    "f": """SELECT lat, lon, regr_slope(a, y) AS b, corr(a, y) AS r, count(*) AS n
            FROM y GROUP BY lat, lon""",
    # with t = sqrt(dof) * tan(angle) the density of Student's t is a power of the cosine
    "tails": """SELECT lat, lon, (pi() / 2 - asin(abs(r)))
                * sum(w * cos(asin(abs(r)) + u * (pi() / 2 - asin(abs(r)))) ** (n - 3))
                / (pi() / 2 * sum(w * cos(u * pi() / 2) ** (n - 3))) AS p
                FROM f, simpson WHERE n > 2 GROUP BY lat, lon, r, n"""}))
def map_trend_p(v):
    return maps.map_trend(v.ens, with_p=True)


_BRANDS = {
    "sales": """SELECT last_day(CAST(l_shipdate AS DATE)) AS block, p_brand AS treatment,
        avg(l_extendedprice) / 999.91 AS metric FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "complete": """SELECT * FROM sales WHERE block IN (SELECT block FROM sales GROUP BY block
        HAVING count(*) = (SELECT count(DISTINCT treatment) FROM sales))""",
    "ranked": """SELECT *, rank() OVER (PARTITION BY block ORDER BY metric DESC)
        + (count(*) OVER (PARTITION BY block, metric) - 1) / 2.0 AS rank FROM complete""",
    "s": """SELECT count(*) AS k, max(n) AS n, sum(mr ** 2) AS rr FROM (
        SELECT treatment, avg(rank) AS mr, count(*) AS n FROM ranked GROUP BY treatment)""",
    # the normal distribution on a grid, by the trapezoid rule with its first correction
    "density": """SELECT range AS j, -9 + range * 0.0005 AS z,
        exp(-((-9 + range * 0.0005) ** 2) / 2) / sqrt(2 * pi()) AS f FROM range(36001)""",
    "normal": """SELECT j, f, 0.0005 * (sum(f) OVER (ORDER BY j) - f / 2)
        + 0.0005 ** 2 / 12 * z * f AS below FROM density""",
    # chance that the range of k values stays within each of many widths; the greatest lies at a
    "within": """SELECT q.range AS width, sum(k * a.f * (a.below - coalesce(b.below, 0)) ** (k - 1)) * 0.1
        AS p FROM s, normal a, range(7000, 11400, 4) q LEFT JOIN normal b ON b.j = a.j - q.range
        WHERE a.j % 200 = 0 GROUP BY q.range""",
    "q": """SELECT 0.0005 * (w0 + (width - w0) * (0.95 - p0) / (p - p0)) / sqrt(2) AS q FROM (
        SELECT width, p, lag(width) OVER (ORDER BY width) AS w0, lag(p) OVER (ORDER BY width) AS p0
        FROM within) WHERE p0 < 0.95 AND p >= 0.95"""}


@query("friedman_many", sql("", f"""
    SELECT {i('k', 'treatments')}, {i('n', 'blocks')},
           {r('12.0 * n / (k * (k + 1)) * (rr - k * (k + 1) ** 2 / 4.0)', 'chi2')},
           round(q * sqrt(k * (k + 1) / (6.0 * n)), 5) AS critical_difference FROM s, q""", _BRANDS))
def friedman_many(v):
    """A treatment per brand, twenty-five in all, more than published tables list."""
    li, p = v.table("lineitem"), v.table("part")
    sales = li.join(p, li.l_partkey == p.p_partkey).groupBy(
        F.last_day(F.to_date("l_shipdate")).alias("block"), F.col("p_brand").alias("treatment")).agg(
        (F.avg("l_extendedprice") / 999.91).alias("metric"))
    out = stats.friedman(sales, with_p=False)
    return out.withColumn("critical_difference", F.round("critical_difference", 5))
