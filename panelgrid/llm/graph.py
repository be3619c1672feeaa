"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.common import pin


def _to_least(edges: DataFrame, upward: bool) -> DataFrame:
    """Links the neighbours of each ``a`` to the least of them all and ``a`` itself."""
    if upward:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    joined = edges.join(least, "a")
    if upward:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in ``edges`` (a, b); the root is the least id of the component.

    Every round is written to the shared folder, so that the lineage stays short; rounds end when
    the links no longer change. Their number grows with the logarithm of the longest chain.
    """
    now = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = pin(now.distinct(), "links")
    mark = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
        now = pin(_to_least(_to_least(now, True), False), "links")
    ids = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return ids.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()
