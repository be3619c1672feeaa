"""Length buckets of least padding and batches of a token budget inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.common import pin, prefix_sums

WORD = r"[^\x20\x09-\x0D]+"  # a token is a run of non-space characters


def pack(docs: DataFrame, buckets: int = 16, budget: int = 16384, id_col: str = "doc_id",
         text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_length, batch, position, padding), one row per input row.

    Every row of a batch is padded to ``bucket_length``, the longest in its bucket. Bucket bounds
    minimise the padding of the whole table: dynamic programming over the histogram of all lengths,
    of which there are fewer than the root of twice the number of tokens. ``tokens`` counts the tokens of
    a row of ``docs`` (null: none); without it words are counted. A batch holds as many rows as the budget has room for; a row longer
    than the budget is a batch of its own. Nulls and empty texts have length 0 and share the first
    bucket; repeated rows are packed each; an empty table gives no rows.
    """
    if buckets < 1 or budget < 1:
        raise ValueError("buckets and budget must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = F.regexp_count(text, F.lit(WORD)) if tokens is None else F.coalesce(tokens, F.lit(0))
    rows = pin(docs.select(F.col(id_col).alias("doc_id"), count.cast("long").alias("n_tokens"),
                           F.md5(F.concat_ws(":", F.col(id_col).cast("string"), text)).alias("name"))
               .groupBy("doc_id", "n_tokens", "name").agg(F.count("*").alias("copies")),
               "pack-rows")
    histogram = (rows.groupBy("n_tokens").agg(F.sum("copies").alias("rows"))
                 .orderBy("n_tokens").collect())
    if not histogram:
        bounds = []
    else:
        bounds = best_bounds([x.n_tokens for x in histogram], [x.rows for x in histogram],
                             buckets)
    bucket, length = F.lit(0), F.lit(bounds[-1] if bounds else 0).cast("long")
    for b in bounds[:-1]:
        bucket = bucket + (F.col("n_tokens") > b).cast("int")
    for b in reversed(bounds[:-1]):
        length = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(length)
    placed = pin(rows.withColumn("bucket", bucket).withColumn("bucket_length", length),
                 "pack-placed")
    n = sum(x.rows for x in histogram)
    slotted = (prefix_sums(placed, ["bucket"], "name", "copies", "first", n)
               .withColumn("slot", F.explode(F.sequence(
                   "first", F.col("first") + F.col("copies") - 1))))
    room = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1))), F.lit(1))
    return slotted.select(
        "doc_id", "n_tokens", "bucket", "bucket_length",
        F.floor(F.col("slot") / room).cast("long").alias("batch"),
        (F.col("slot") % room).cast("long").alias("position"),
        (F.col("bucket_length") - F.col("n_tokens")).alias("padding"))


def best_bounds(longest: list[int], rows: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` runs of lengths with the least padding in all."""
    top = np.array(longest, np.int64)
    count = np.concatenate([[0], np.cumsum(np.array(rows, np.int64))])
    n, k = len(top), min(buckets, len(top))
    # least padded size of the first j lengths with one bucket more per round; the tokens themselves
    # are the same in any division
    best = np.concatenate([[0], top * count[1:]])
    back = [np.zeros(n + 1, int)]
    for _ in range(1, k):
        best, came = _one_more(best, top, count)
        back.append(came)
    bounds, j = [], n
    for came in reversed(back):
        if j == 0:
            break
        bounds.append(int(longest[j - 1]))
        j = int(came[j])
    return bounds[::-1]


def _one_more(best: np.ndarray, top: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least size of the first j lengths if the last bucket begins after came[j] of them.

    The best beginning never moves back as j grows, so those of every second j bound the search for
    those between: about n log n steps in all.
    """
    n = len(top)
    new, came = best.copy(), np.zeros(n + 1, int)
    width = 1 << n.bit_length()
    while width:
        at = np.arange(width, n + 1, 2 * width)
        if len(at):
            low = came[at - width]
            high = np.minimum(np.where(at + width <= n, came[np.minimum(at + width, n)], n), at - 1)
            sizes = high - low + 1
            starts = np.cumsum(sizes) - sizes
            i = np.arange(sizes.sum()) - np.repeat(starts, sizes) + np.repeat(low, sizes)
            cost = best[i] + np.repeat(top[at - 1], sizes) * (np.repeat(count[at], sizes) - count[i])
            new[at] = np.minimum.reduceat(cost, starts)
            hits = np.flatnonzero(cost == np.repeat(new[at], sizes))
            came[at] = i[hits[np.searchsorted(hits, starts)]]
        width //= 2
    return new, came
