"""Grouped folds and bootstraps: every row of a site shares its role."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.functions.columns import hash_key, uniform
from panelgrid.operators.grouping import pick_by_draw, weighted_positions
from panelgrid.session import pin


def label_counts(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows per group and label; NULL is a label of its own."""
    return df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))


def group_kfold(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 26) -> DataFrame:
    """One fold number per group, balanced over labels.

    Groups of one dominant label are ordered by size class (powers of two, largest first) and then
    by a seeded hash, and dealt to the folds back and forth; each label starts at its own fold.
    Known labels come before a missing one; groups without any known label are a stratum too.
    """
    counts = label_counts(df, group, label)
    known = F.col(label).isNotNull()
    # the most frequent known label, the smallest one on ties
    top = (counts.groupBy(group).agg(
        F.min(F.struct((~known).alias("unknown"), -F.col("n"), label)).alias("_t"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.sum("n")).alias("_rows"))
        .select(group, F.col(f"_t.{label}").alias("_label"), "_rows"))
    g = top.select(
        group, "_label", F.coalesce(F.concat(F.lit("="), F.col("_label").cast("string")), F.lit(""))
        .alias("_stratum"), F.length(F.bin("_rows")).alias("_size"),
        hash_key(seed, group).alias("_h")).withColumn("_hb", F.substring("_h", 1, 2))
    # at most 64 size classes x 256 hash prefixes per label are numbered in one window
    order = Window.partitionBy("_stratum").orderBy(F.desc("_size"), "_hb")
    blocks = (g.groupBy("_stratum", "_size", "_hb").agg(F.count(F.lit(1)).alias("_c"))
              .select("_stratum", "_size", "_hb",
                      F.coalesce(F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, -1)),
                                 F.lit(0)).alias("_before")))
    inside = Window.partitionBy("_stratum", "_size", "_hb").orderBy("_h")
    pos = F.col("_before") + F.row_number().over(inside) - 1
    lane = F.pmod(pos, F.lit(k))
    back = F.pmod(F.floor(pos / k), F.lit(2)) == 1
    name = F.coalesce(F.col("_label").cast("string"), F.lit("~"))
    start = F.conv(F.substring(hash_key(seed, name), 1, 6), 16, 10).cast("bigint")
    fold = F.pmod(F.when(back, k - 1 - lane).otherwise(lane) + start, F.lit(k))
    dealt = g.join(blocks, ["_stratum", "_size", "_hb"])
    return pin(dealt.select(group, fold.cast("int").alias("fold")), "folds")


# Groups that are tried as partners of one another in a round of swaps, on average.
PARTNERS = 64


def label_spread(df: DataFrame, folds: DataFrame, group: str, label: str) -> DataFrame:
    """One row: ``spread``, the mean over labels of the standard deviation of the folds' shares of it."""
    k = folds.agg(F.max("fold") + 1).scalar()
    shares = (label_counts(df, group, label).join(folds, group).groupBy(label, "fold")
              .agg(F.sum("n").alias("n")).groupBy(label)
              .agg(F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum("n").alias("all")))
    share = F.col("sq") / (F.col("all") * F.col("all"))
    return shares.agg(F.avg(F.sqrt(F.greatest(share / k - 1 / (k * k), F.lit(0.0)))).alias("spread"))


def group_kfold_balanced(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 26,
                         rounds: int = 20) -> DataFrame:
    """One fold number per group, with the labels spread over the folds as evenly as rounds of swaps allow.

    Starts from :func:`group_kfold`. In each round the groups are dealt into buckets of about PARTNERS
    by a new hash; every exchange of two groups of a bucket, and every move of one, is scored from the
    table of fold and label totals alone, and the best of each pair of folds reaches the driver.
    Those that share no fold are made, if the spread (:func:`label_spread`) falls. The folds stop
    changing when no exchange helps. Groups of equal label counts are the same to every score.
    """
    counts = label_counts(df.where(F.col(group).isNotNull()), group, label).withColumn("_l", F.coalesce(F.concat(
        F.lit("="), F.col(label).cast("string")), F.lit("")))
    totals = {r["_l"]: r["n"] for r in counts.groupBy("_l").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    by_label = F.map_from_entries(F.collect_list(F.struct("_l", "n")))
    share = F.array(*[F.coalesce(F.try_element_at("_m", F.lit(x)), F.lit(0)) / F.lit(float(totals[x]))
                      for x in names])
    start = group_kfold(df, group, label, k, seed)
    rows = pin(counts.groupBy(group).agg(by_label.alias("_m"))
               .select(group, share.alias("_share")).join(start, group), "balance")
    n = rows.count()
    moved: dict = {}
    for turn in range(rounds if n else 0):
        now = _with_changes(rows, group, moved)
        held = _fold_shares(now, len(names), k)
        best = _best_exchanges(now, group, held, max(1, n // PARTNERS), hash_key(seed + turn, group))
        old, used = _spread(held), set()
        for r in sorted(best, key=lambda r: r.score):
            if r.score < old - 1e-12 and not used & {r.a, r.b}:
                used |= {r.a, r.b}
                moved[r.g] = r.b
                if r.h is not None:
                    moved[r.h] = r.a
        if not used:
            break
    return pin(_with_changes(rows, group, moved).select(group, "fold"), "folds")


def _with_changes(rows: DataFrame, group: str, moved: dict) -> DataFrame:
    # a few exchanges per round, so the list stays short
    if not moved:
        return rows
    new = F.create_map(*[F.lit(x) for kv in moved.items() for x in kv])
    return rows.withColumn("fold", F.coalesce(F.try_element_at(new, F.col(group)), "fold"))


def _fold_shares(now: DataFrame, labels: int, k: int) -> list[list[float]]:
    """Share of each label that each fold holds."""
    found = {r.fold: r for r in now.groupBy("fold").agg(*[
        F.sum(F.col("_share")[i]).alias(f"s{i}") for i in range(labels)]).collect()}
    return [[found[f][f"s{i}"] if f in found else 0.0 for i in range(labels)] for f in range(k)]


def _spread(held: list[list[float]]) -> float:
    k = len(held)
    squares = [sum(x * x for x in col) for col in zip(*held)]
    return sum(max(q / k - 1 / k ** 2, 0.0) ** 0.5 for q in squares) / len(squares)


def _best_exchanges(now: DataFrame, group: str, held: list[list[float]], buckets: int, key):
    """Per pair of folds (a, b) the group ``g`` of a and ``h`` of b (or none) whose exchange is best."""
    k, kind = len(held), now.schema[group].dataType
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    one = now.select(F.col(group).alias("g"), F.col("fold").alias("a"), F.col("_share").alias("x"),
                     bucket.alias("bucket"))
    none = F.transform("x", lambda _: F.lit(0.0))
    other = one.select("bucket", F.col("g").alias("h"), F.col("a").alias("b"), F.col("x").alias("y"))
    alone = one.select("bucket", "g", "a", "x", F.lit(None).cast(kind).alias("h"), F.explode(
        F.sequence(F.lit(0), F.lit(k - 1))).alias("b")).where("a != b").withColumn("y", none)
    pairs = one.join(other, "bucket").where("a != b").unionByName(alone)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in held])
    squares = F.array(*[F.lit(float(sum(x * x for x in col))) for col in zip(*held)])
    net = F.zip_with("x", "y", lambda x, y: x - y)
    lead = F.zip_with(F.get(table, F.col("b")), F.get(table, F.col("a")), lambda b, a: b - a)
    change = F.zip_with(net, lead, lambda u, d: 2 * u * (u + d))
    stds = F.zip_with(squares, change, lambda q, c: F.sqrt(F.greatest((q + c) / k - 1 / k ** 2, F.lit(0.0))))
    score = F.aggregate(stds, F.lit(0.0), lambda s, x: s + x) / F.lit(float(len(held[0])))
    return pairs.select("a", "b", "g", "h", score.alias("score")).groupBy("a", "b").agg(
        F.min(F.struct("score", "g", "h")).alias("m")).select("a", "b", "m.*").collect()


def fold_roles(df: DataFrame, folds: DataFrame, fold: int, group: str = "site") -> DataFrame:
    """Rows with ``role`` test (the fold) or train (all others)."""
    role = F.when(F.col("fold") == fold, F.lit("test")).otherwise(F.lit("train"))
    return df.join(folds, group).withColumn("role", role)


def fold_membership(df: DataFrame, folds: DataFrame, group: str = "site",
                    out: str = "test_fold") -> DataFrame:
    return df.join(folds.withColumnRenamed("fold", out), group, "left")


def inner_folds(df: DataFrame, folds: DataFrame, fold: int, group: str, label: str, k: int = 5,
                seed: int = 26) -> DataFrame:
    """Tuning folds over the training groups of an outer fold."""
    train = df.join(folds.where(F.col("fold") != fold).select(group), group, "left_semi")
    return group_kfold(train, group, label, k, seed)


def repetitions(df: DataFrame, n: int = 30, base_seed: int = 26) -> DataFrame:
    """Every row once per repetition, with ``rep`` and its ``seed`` = base + rep."""
    return (df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .withColumn("seed", F.col("rep") + F.lit(base_seed)))


def group_bootstrap(df: DataFrame, group: str = "site", size: float = 0.8, reps: int = 30,
                    base_seed: int = 26) -> DataFrame:
    """Role of each group in each repetition: ``train`` if drawn, else ``test``.

    Per repetition int(size x groups) *rows* are drawn with replacement and their groups are in
    the bag, so a group with more rows is likelier to be drawn; how often it was drawn does not
    matter. Draws are numbered by the groups themselves, hence made in parallel and the same on
    any partitioning.
    """
    groups = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"))
    placed = pin(weighted_positions(groups, [group], "_n"), "positions")
    draws = repetitions(
        placed.where(F.col("ordinal") < F.floor(F.lit(size) * F.col("n_items")))
        .select("ordinal", "total"), reps, base_seed)
    draws = draws.withColumn("u", uniform("seed", "ordinal") * F.col("total"))
    bag = pick_by_draw(placed, [group], draws.select("u", "total", "rep")).distinct()
    everyone = repetitions(placed.select(group), reps, base_seed).drop("seed")
    flagged = everyone.join(bag.withColumn("_in", F.lit(1)), ["rep", group], "left")
    return flagged.select("rep", group, F.when(F.col("_in") == 1, "train").otherwise("test")
                          .alias("role"))


def train_groups(df: DataFrame, test: DataFrame, group: str = "site") -> DataFrame:
    """All groups minus the test groups."""
    return df.select(group).distinct().join(test.select(group), group, "left_anti")


def label_union(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct labels over several columns."""
    return (df.select(F.explode(F.array(*columns)).alias("label"))
            .where(F.col("label").isNotNull()).distinct())
