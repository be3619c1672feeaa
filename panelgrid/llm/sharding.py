"""Shards of nearly equal bytes: the smallest capacity that ordered groups can be cut to.

Groups of equal texts are atomic and ordered by the digest of their text. A capacity is feasible if
filling shard after shard, each as full as it goes, uses no more shards than wanted; the smallest
feasible one is searched by bisection, with several probes per Spark job. Since the order is that
of the digest, a document finds its shard by comparing its own digest with the cuts: no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.common import narrow, pin, prefix_sums

PROBES = 31  # capacities tried at once


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per input row.

    size: UTF-8 bytes of the text plus 1. slot: position in the shard from 0 without gaps, in order
    of a digest of id and text. A null text counts as empty and shares the group of empty texts;
    null ids are kept; repeated rows get neighbouring slots; an empty table gives no rows; fewer
    groups than shards leave shards empty. ``grown_shard`` is null under the law ``bytes``.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pin(
        narrow(docs, id_col, text_col)
        .select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("h"))
        .groupBy("doc_id", "size", "text_crc32", "h").agg(F.count("*").alias("copies")),
        "shard-rows")
    groups = pin(rows.groupBy("h").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes")),
                 "shard-groups")
    n, total, largest = groups.agg(F.count("*"), F.sum("bytes"), F.max("bytes")).first()
    if n:
        filled = prefix_sums(groups, [], "h", "bytes", "before", n)
        filled = pin(filled.select("h", (F.col("before") + F.col("bytes")).alias("end"))
                     .repartitionByRange("h").sortWithinPartitions("h"), "shard-ends")
        cuts = _cut_keys(filled, _smallest_capacity(filled, shards, total, largest), shards)
    else:
        cuts = []
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("h") > cut).cast("int")
    name = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "h"))
    placed = pin(rows.withColumn("shard", shard).withColumn("name", name), "shard-placed")
    slotted = prefix_sums(placed, ["shard"], "name", "copies", "first", placed.count())
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def _last_ends(ends: DataFrame, limits: list[int], largest: int) -> list[int]:
    """For each limit the largest group end not beyond it (0: none).

    The answer lies less than the largest group below the limit, so row groups are pruned.
    """
    near = ends.filter((F.col("end") <= max(limits)) & (F.col("end") > min(limits) - largest))
    row = near.agg(*[F.max(F.when(F.col("end") <= x, F.col("end"))) for x in limits]).first()
    return [x or 0 for x in row]


def _walk(ends: DataFrame, capacities: list[int], shards: int, largest: int) -> list[list[int]]:
    """The cuts of greedy filling for each capacity."""
    at, cuts = [0] * len(capacities), [[] for _ in capacities]
    for _ in range(shards - 1):
        at = _last_ends(ends, [a + c for a, c in zip(at, capacities)], largest)
        for own, a in zip(cuts, at):
            own.append(a)
    return cuts


def _smallest_capacity(ends: DataFrame, shards: int, total: int, largest: int) -> list[int]:
    """Cuts of the smallest feasible capacity."""
    low = max(largest, -(-total // shards))
    high = -(-total // shards) + largest  # a shard left below this would take another group
    best = None
    while best is None or low < high:
        step = max(1, -(-(high - low + 1) // PROBES))
        tried = sorted({*range(low, high, step), high})
        for c, cuts in zip(tried, _walk(ends, tried, shards, largest)):
            if total - (cuts[-1] if cuts else 0) <= c:
                high, best = c, cuts
                break
            low = c + 1
    return best


def _cut_keys(ends: DataFrame, cuts: list[int], shards: int) -> list[str]:
    """Digest of the last group of each shard but the last."""
    if shards == 1:
        return []
    return [x or "" for x in
            ends.agg(*[F.max(F.when(F.col("end") <= c, F.col("h"))) for c in cuts]).first()]
