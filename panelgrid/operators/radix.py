"""Exact quantiles and ranks by radix selection on the bits of a double.

A double becomes a 64-bit integer of the same order. Rows are counted by its leading 16 bits, on the
map side first, and only where a wanted position lies, or where too many different values share them,
are the next 16 bits looked at. No step depends on the number of rows: a window sees at most the 65,536
counts of one digit, and no sample, sketch or list of cuts passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.functions.columns import ColumnLike, col
from panelgrid.operators.grouping import join_reduced
from panelgrid.session import pin

DIGIT = 16  # bits looked at per level
CROWDED = 1 << DIGIT  # different values that are sorted together at most


def double_key(c: ColumnLike) -> Column:
    """A double as a long of the same order: the bits of its size, with the sign of the double.

    NULL and NaN have no key; both zeros have the key 0.
    """
    x = col(c).cast("double")
    size = F.abs(x)
    # powers of two are exact, so scaling to [1, 2) loses no bit
    e = F.floor(F.least(F.greatest(F.log2(size), F.lit(-1022.0)), F.lit(1023.0)))
    part = size * F.pow(F.lit(2.0), -e.cast("double"))
    # the logarithm may be off by one; then a part below 1 or from 2 on lies on the next line
    more = F.least(part * 2 - 2, part - 1, part / 2) * F.lit(2.0 ** 52)
    # below 2**-1022 doubles are evenly spaced
    tiny = (size * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long")
    normal = F.shiftleft(e.cast("long") + 1023, 52) + more.cast("long")
    bits = (F.when(size == float("inf"), F.lit(2047 << 52))
            .when(size < 2.0 ** -1022, tiny).otherwise(normal))
    return F.when(F.isnan(x) | x.isNull(), F.lit(None)).otherwise(F.when(x < 0, -bits).otherwise(bits))


def key_double(c: ColumnLike) -> Column:
    """The double of a key."""
    bits = F.abs(col(c))
    e = F.shiftright(bits, 52)
    share = bits.bitwiseAND((1 << 52) - 1).cast("double") * F.lit(2.0 ** -52)
    half = F.floor((e - 1023) / 2).cast("double")
    normal = (share + 1) * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), e - 1023 - half)
    size = (F.when(e == 2047, F.lit(float("inf")))
            .when(e == 0, bits.cast("double") * F.lit(2.0 ** -537) * F.lit(2.0 ** -537))
            .otherwise(normal))
    return F.when(col(c) < 0, -size).otherwise(size)


def _known(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def _numbers(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Rows with all keys and a value that has a place; asked of the value, so its key is built once."""
    return _known(df, [*by, value]).where(~F.isnan(col(value).cast("double")))


def _before(over, count: str) -> Column:
    return F.coalesce(F.sum(count).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _levels() -> list[int]:
    """Bits that are left out at each level, the last level has them all."""
    return list(range(64 - DIGIT, -1, -DIGIT))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles (linear interpolation) per group: ``by``, ``n``, ``q0``, ``q1``, ...

    NULL and NaN values and NULL keys are left out. Only the keys are pinned; each level reads them once
    and joins the few prefixes that hold a wanted position, which is a filter by broadcast.
    """
    by = list(by)
    rows = pin(_numbers(df, value, by).select(*by, double_key(value).alias("_key")), "keys")

    def pos(p):
        return (F.col("total") - 1) * F.lit(float(p))

    edges = F.array(*[e for p in probs for e in (F.floor(pos(p)), F.ceil(pos(p)))])
    located, parent = None, []
    for bits in _levels():
        open_ = rows if located is None else join_reduced(
            rows.withColumn("_parent", F.shiftright("_key", bits + DIGIT)), located,
            by + ["_parent"], "inner")
        keys = by + parent
        found = open_.groupBy(*keys, *(["before", "total"] if parent else []),
                              F.shiftright("_key", bits).alias("_at")).agg(
            F.count(F.lit(1)).alias("cnt"))
        w = Window.partitionBy(*keys)
        if not parent:
            found = found.withColumn("total", F.sum("cnt").over(w)).withColumn("before", F.lit(0))
        located = (found.withColumn("before", F.col("before") + _before(w.orderBy("_at"), "cnt"))
                   .where(F.exists(edges, lambda e: (e >= F.col("before"))
                                   & (e < F.col("before") + F.col("cnt"))))
                   .select(*by, F.col("_at").alias("_parent"), "before", "total", "cnt"))
        if bits:
            located = located.drop("cnt")
        parent = ["_parent"]

    def at(e):
        hit = (e >= F.col("before")) & (e < F.col("before") + F.col("cnt"))
        return F.max(F.when(hit, F.col("_parent")))

    picked = located.groupBy(*by, F.col("total").alias("n")).agg(*[
        c for i, p in enumerate(probs) for c in (at(F.floor(pos(p))).alias(f"_lo{i}"),
                                                 at(F.ceil(pos(p))).alias(f"_hi{i}"))])

    def between(i, p):
        h = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = key_double(f"_lo{i}"), key_double(f"_hi{i}")
        return lo + (hi - lo) * (h - F.floor(h))

    return picked.select(*by, "n", *[between(i, p).alias(f"q{i}") for i, p in enumerate(probs)])


def value_positions(df: DataFrame, value: str, by: Sequence[str] = (),
                    **counters: Column) -> DataFrame:
    """One row per distinct value and group, with how many rows lie below it.

    Columns: ``by``, ``value``, ``cnt`` (rows with that value), ``start`` (rows of the group with a
    smaller value), ``total`` (rows of the group), and the extra counters. NULL and NaN values and NULL
    keys are left out. Values are counted first, so ties never pile up. Values that share their leading
    bits are sorted together unless they are more than CROWDED; then the next bits divide them.
    """
    by = list(by)
    counted = _numbers(df, value, by).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("cnt"), *[c.alias(n) for n, c in counters.items()])
    rest = pin(counted.withColumn("_key", double_key(value)), "values").withColumns(
        {"_base": F.lit(0).cast("long"), "_parent": F.lit(0).cast("long")})
    out, total, small = [], None, F.col("_values") <= CROWDED
    for bits in _levels():
        rest = rest.withColumn("_at", F.shiftright("_key", bits))
        keys = by + ["_parent"]
        w = Window.partitionBy(*keys).orderBy("_at")
        sums = rest.groupBy(*keys, "_base", "_at").agg(F.sum("cnt").alias("_rows"),
                                                       F.count(F.lit(1)).alias("_values"))
        places = pin(sums.select(*by, "_at", "_values", "_rows",
                                 (F.col("_base") + _before(w, "_rows")).alias("_first")), "digits")
        if total is None:
            total = places.groupBy(*by).agg(F.sum("_rows").alias("total"))
        placed = rest.drop("_base").join(places.drop("_rows"), by + ["_at"])
        inside = Window.partitionBy(*by, "_at").orderBy(value)
        last = bits == 0 or not places.where(~small).limit(1).count()
        out.append((placed if last else placed.where(small)).withColumn(
            "start", F.col("_first") + _before(inside, "cnt")))
        if last:
            break
        rest = placed.where(~small).select(*by, value, "cnt", *counters, "_key",
                                           F.col("_at").alias("_parent"), F.col("_first").alias("_base"))
    ranked = reduce(DataFrame.unionByName, [p.select(*by, value, "cnt", *counters, "start") for p in out])
    ranked = join_reduced(ranked, total, by) if by else ranked.withColumn("total", total.scalar())
    return ranked.select(*by, value, "cnt", "start", "total", *counters)
