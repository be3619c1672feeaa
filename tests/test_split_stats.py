import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelgrid.operators import split, stats


def sites(spark, n=200):
    """Site 0 holds a third of all rows."""
    small = spark.range(n * 20).select(F.concat(F.lit("s"), F.col("id") % n).alias("site"),
                                       (F.col("id") % n % 4).cast("string").alias("label"))
    hot = spark.range(n * 10).select(F.lit("s0").alias("site"), F.lit("0").alias("label"))
    return small.union(hot)


def test_every_site_in_one_fold(spark):
    df = sites(spark)
    folds = split.group_kfold(df, "site", "label", 5, 3)
    got = folds.toPandas()
    assert got.site.is_unique and len(got) == 200 and set(got.fold) == set(range(5))
    again = split.group_kfold(df.repartition(11), "site", "label", 5, 3)
    assert folds.exceptAll(again).count() == 0
    other = split.group_kfold(df, "site", "label", 5, 4)
    assert folds.exceptAll(other).count() > 0
    # labels are spread evenly: 50 sites each over 5 folds
    per = folds.join(df.distinct(), "site").groupBy("label", "fold").count().toPandas()
    assert per["count"].between(9, 11).mean() > 0.8


def test_roles_do_not_overlap(spark):
    df = sites(spark, 40)
    folds = split.group_kfold(df, "site", "label")
    r = split.fold_roles(df, folds, 1).select("site", "role").distinct()
    assert r.groupBy("site").count().where("count > 1").count() == 0
    inner = split.inner_folds(df, folds, 1, "site", "label")
    assert inner.join(folds.where("fold = 1"), "site").count() == 0


def test_groups_without_a_label_get_a_fold(spark):
    df = spark.createDataFrame([(f"s{i}", None if i % 2 else "a") for i in range(40)],
                               "site string, label string")
    folds = split.group_kfold(df, "site", "label").toPandas()
    assert len(folds) == 40 and set(folds.fold) == set(range(5))


def test_bootstrap(spark):
    df = sites(spark)
    b = split.group_bootstrap(df, "site", 0.8, 20, 26)
    p = b.toPandas()
    assert len(p) == 200 * 20 and set(p.role) == {"train", "test"}
    assert (p[p.site == "s0"].role == "train").all()          # a third of all rows
    share = (p[p.site != "s0"].role == "train").mean()
    # 160 draws, each other site holds 20 of 6000 rows
    assert share == pytest.approx(1 - (1 - 20 / 6000) ** 160, abs=0.03)
    again = split.group_bootstrap(df.repartition(7), "site", 0.8, 20, 26)
    assert b.exceptAll(again).count() == 0


def test_wilcoxon_exact(spark):
    x = [0.3, -1.1, 2.2, 0.7, -0.2, 1.9, 0.9]
    df = spark.createDataFrame([(v, 0.0) for v in x] + [(1.0, 1.0)], "a double, b double")
    got = stats.wilcoxon(df, "a", "b").first()
    ranks = np.argsort(np.argsort(np.abs(x))) + 1
    w = sum(r for r, v in zip(ranks, x) if v > 0)
    assert got["n"] == 7 and got["w_plus"] == w and got["w_minus"] == 28 - w
    sums = [sum(r for r, s in zip(range(1, 8), signs) if s) for signs in
            itertools.product([0, 1], repeat=7)]
    p = min(1, 2 * np.mean(np.array(sums) <= min(w, 28 - w)))
    assert got["p_value"] == pytest.approx(p)
    less = stats.wilcoxon(df, "a", "b", "less").first()["p_value"]
    more = stats.wilcoxon(df, "a", "b", "greater").first()["p_value"]
    assert less == pytest.approx(np.mean(np.array(sums) <= w))
    assert more == pytest.approx(np.mean(np.array(sums) >= w))


def test_wilcoxon_ties_and_many_ranges(spark, crowded):
    r = np.random.default_rng(2)
    d = r.integers(-20, 25, 900).astype(float)
    got = stats.wilcoxon(spark.createDataFrame([(float(v),) for v in d], "d double"), "d").first()
    z = d[d != 0]
    a = np.abs(z)
    rank = np.array([(a < v).sum() + ((a == v).sum() + 1) / 2 for v in a])
    assert got["w_plus"] == rank[z > 0].sum() and got["w_minus"] == rank[z < 0].sum()
    n = len(z)
    _, t = np.unique(a, return_counts=True)
    sd = np.sqrt((n * (n + 1) * (2 * n + 1) - (t ** 3 - t).sum() / 2) / 24)
    assert got["z"] == pytest.approx((min(got["w_plus"], got["w_minus"]) - n * (n + 1) / 4) / sd)


def test_ranksum_and_ztest(spark, crowded):
    r = np.random.default_rng(3)
    a, b = r.normal(0.3, 1, 80).round(1), r.normal(0, 1, 80).round(1)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    got = stats.ranksum(df, "a", "b").first()
    both = np.concatenate([a, b])
    rank = np.array([(both < v).sum() + ((both == v).sum() + 1) / 2 for v in both])
    z = (rank[:80].sum() - 80 * 161 / 2) / np.sqrt(80 * 80 * 161 / 12)
    assert got["z"] == pytest.approx(z) and 0 < got["p_value"] < 1
    t = stats.ztest(df, "a", "b", "larger").first()
    pooled = (79 * a.var(ddof=1) + 79 * b.var(ddof=1)) / 158
    assert t["z"] == pytest.approx((a.mean() - b.mean()) / np.sqrt(pooled * 2 / 80))


def test_friedman_ties_and_incomplete_blocks(spark):
    rows = [(i, t, float(v)) for i, vs in enumerate([(1, 2, 3), (1, 1, 2), (3, 2, 4), (2, 5, 9)])
            for t, v in zip("abc", vs)] + [(9, "a", 1.0)]
    df = spark.createDataFrame(rows, "block int, treatment string, metric double")
    got = stats.friedman(df).first()
    ranks = np.array([[3, 2, 1], [2.5, 2.5, 1], [2, 3, 1], [3, 2, 1]])
    raw = 12 * 4 / 12 * ((ranks.mean(axis=0) ** 2).sum() - 3 * 16 / 4)
    assert got["blocks"] == 4 and got["chi2"] == pytest.approx(raw / (1 - 6 / (4 * 3 * 8)))
    assert got["critical_difference"] == pytest.approx(2.343701 * np.sqrt(12 / 24))
    assert got["p_value"] == pytest.approx(np.exp(-got["chi2"] / 2))
    m = {r["treatment"]: r["mean_rank"] for r in stats.mean_ranks(df).collect()}
    assert m == dict(zip("abc", ranks.mean(axis=0)))


def greedy_spread(counts, k):
    """Spread when the most uneven groups are placed first, each where the spread is then least."""
    totals = counts.sum(0)
    held = np.zeros((k, counts.shape[1]))
    for row in counts[np.argsort(-counts.std(1), kind="stable")]:
        held[min(range(k), key=lambda f: ((held + np.eye(k)[f][:, None] * row) / totals).std(0).mean())] += row
    return (held / totals).std(0).mean()


@pytest.mark.parametrize("seed", [1, 2])
def test_balanced_folds(spark, monkeypatch, seed):
    """Labels are spread no worse than by placing group after group; small buckets do, too."""
    r = np.random.default_rng(seed)
    counts = r.poisson(r.gamma(0.6, 30, (60, 1)) * r.dirichlet(np.full(5, 0.3), 60))
    counts[0] = 400, 0, 0, 0, 0
    rows = [(f"g{i}", "abcde"[j] if j < 4 else None) for i, c in enumerate(counts) for j, n in enumerate(c)
            for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, label string")
    there = {f"g{i}" for i, c in enumerate(counts) if c.sum()}
    spreads = []
    for partners in (64, 8):
        monkeypatch.setattr(split, "PARTNERS", partners)
        folds = split.group_kfold_balanced(df, "g", "label", 4, seed, rounds=25 if partners > 9 else 5)
        got = folds.collect()
        assert sorted(x.g for x in got) == sorted(there) and {x.fold for x in got} == {0, 1, 2, 3}
        spreads.append(split.label_spread(df, folds, "g", "label").first()[0])
    plain = split.label_spread(df, split.group_kfold(df, "g", "label", 4, seed), "g", "label").first()[0]
    assert spreads[0] <= greedy_spread(counts, 4) + 1e-12 and spreads[1] < plain


def test_balanced_folds_of_few_groups(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None), (None, "x")], "g string, label string")
    assert sorted(x.g for x in split.group_kfold_balanced(df, "g", "label", 3).collect()) == ["a", "b"]
    assert split.group_kfold_balanced(df.limit(0), "g", "label", 3).count() == 0
