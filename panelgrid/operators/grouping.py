"""Building blocks that keep any group, however large, spread over many tasks.

Group statistics are map-side combined and joined back instead of computed in a window over
the group: one site may hold a third of all rows, and a window would put it in one task. The
joins carry no hint: reduced tables are pinned, so Spark knows their size, broadcasts them below
its threshold (the big side is then not shuffled at all), and otherwise shuffles both sides while
adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.functions.columns import hash_key
from panelgrid.session import pin


def join_reduced(df: DataFrame, reduced: DataFrame, keys: Sequence[str],
                 how: str = "left") -> DataFrame:
    """Join a table that an aggregation or ``distinct`` has made small, by its measured size."""
    return df.join(pin(reduced, "reduced"), list(keys), how)


def attach_stats(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Every row with the aggregates of its group. Rows with a NULL key get NULL statistics."""
    stats = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return join_reduced(df, stats, keys)


def known_neighbours(df: DataFrame, values: Sequence[str], order: Sequence[str], block: Column,
                     keys: Sequence[str] = ()) -> DataFrame:
    """Add ``prev_<v>`` and ``next_<v>``: nearest known values at or before / at or after a row.

    ``block`` must be monotone in ``order`` (a year, a coordinate band). Blocks are summarised
    first; a small table of first and last known values per block is carried across blocks, and
    only rows of the same key *and* block are ever sorted together.
    """
    keys = list(keys)
    at = F.struct(*order)
    b = df.withColumn("_block", block)

    def known(v):
        return F.when(F.col(v).isNotNull(), at)

    edges = b.groupBy(*keys, "_block").agg(
        *[F.max_by(v, known(v)).alias(f"_last_{v}") for v in values],
        *[F.min_by(v, known(v)).alias(f"_first_{v}") for v in values],
    )
    across = Window.partitionBy(*keys).orderBy("_block")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = across.rowsBetween(1, Window.unboundedFollowing)
    carry = edges.select(
        *keys, "_block",
        *[F.last(f"_last_{v}", True).over(before).alias(f"_in_{v}") for v in values],
        *[F.first(f"_first_{v}", True).over(after).alias(f"_out_{v}") for v in values],
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    onward = inside.rowsBetween(0, Window.unboundedFollowing)
    joined = b.join(carry, keys + ["_block"], "left")
    return joined.select(
        *df.columns,
        *[F.coalesce(F.last(v, True).over(upto), f"_in_{v}").alias(f"prev_{v}") for v in values],
        *[F.coalesce(F.first(v, True).over(onward), f"_out_{v}").alias(f"next_{v}")
          for v in values],
    )


def weighted_positions(items: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Lay items end to end on [0, total weight) in a fixed pseudo-random order.

    Adds ``start``, ``total``, ``ordinal`` (0-based) and ``n_items``. Items are ordered by the
    md5 of their key and cut into 4,096 blocks; block sums are the only thing summed globally.
    """
    h = items.withColumn("_h", hash_key(0, *keys)).withColumn("_hb", F.substring("_h", 1, 3))
    upto = Window.orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_hb").rowsBetween(Window.unboundedPreceding,
                                              Window.unboundedFollowing)
    blocks = h.groupBy("_hb").agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_c"))
    blocks = blocks.select(
        "_hb",
        F.coalesce(F.sum("_w").over(upto), F.lit(0)).alias("_w0"),
        F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_c0"),
        F.sum("_w").over(whole).alias("total"),
        F.sum("_c").over(whole).alias("n_items"),
    )
    inside = Window.partitionBy("_hb").orderBy("_h")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return h.join(blocks, "_hb").select(
        *items.columns,
        (F.col("_w0") + F.coalesce(F.sum(weight).over(before), F.lit(0))).cast("double").alias("start"),
        F.col("total").cast("double").alias("total"), "n_items",
        (F.col("_c0") + F.row_number().over(inside) - 1).alias("ordinal"),
    )


def pick_by_draw(positions: DataFrame, keys: Sequence[str], draws: DataFrame,
                 blocks: int = 1024) -> DataFrame:
    """For each draw ``u`` in (0, total) the item whose interval holds it.

    Draws and interval starts are merged in order and each draw takes the last start before it,
    so the work is one sort of items plus draws, whatever the weights. ``draws`` carries ``u``
    and ``total``.
    """
    item = F.struct(*keys)
    marks = positions.select(F.col("start").alias("_p"), F.lit(0).alias("_kind"),
                             item.alias("_item"), "total",
                             *[F.lit(None).cast(draws.schema[c].dataType).alias(c)
                               for c in draws.columns if c not in ("u", "total")])
    picks = draws.select(F.col("u").alias("_p"), F.lit(1).alias("_kind"),
                         F.lit(None).cast(marks.schema["_item"].dataType).alias("_item"), "total",
                         *[c for c in draws.columns if c not in ("u", "total")])
    merged = marks.unionByName(picks)
    band = F.floor(F.col("_p") / F.col("total") * blocks)
    found = known_neighbours(merged, ["_item"], ["_p", "_kind"], band)
    return found.where(F.col("_kind") == 1).select(
        *[c for c in draws.columns if c not in ("u", "total")],
        *[F.col(f"prev__item.{k}").alias(k) for k in keys])
