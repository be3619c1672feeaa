"""Exact copies by polynomial fingerprints of chunks, with every equality checked byte by byte.

The fingerprint of a text is the sum of byte i times base**i, modulo two primes, so that of a chunk,
multiplied by base**offset, is its share of the whole: chunks of a huge text are hashed in different
tasks and their shares added up. Texts of equal length and fingerprint are then compared chunk by
chunk: least and greatest of the chunks at one place are aggregated, on the map side first, so a
group never gathers anywhere, however large. Should different texts share a fingerprint, their chunks are
ranked and the ranks tell them apart.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelgrid.llm.common import compute, pin

PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_000_003_133, 1_640_531_527)
WIDTH = 128  # bytes summed as floats; 8 + 31 + 7 bits are exact
CHUNK = 1 << 20
BROADCAST_BYTES = 8 << 20  # fingerprints that occur twice are broadcast up to this size
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Polynomial:
    """Fingerprints of bytes modulo each of two primes."""

    def __init__(self, primes: Sequence[int], chunk: int):
        self.primes = np.array(primes)
        self.column = np.array([[pow(b, i, p) for p, b in zip(primes, BASES)] for i in range(WIDTH)],
                               float)
        self.row = np.array([[pow(b, WIDTH * i, p) for p, b in zip(primes, BASES)]
                             for i in range(chunk // WIDTH + 1)])

    def of(self, raw: bytes) -> np.ndarray:
        """One value for each prime, of at most a chunk of bytes."""
        rows = -(-len(raw) // WIDTH)
        grid = np.zeros(rows * WIDTH)
        grid[:len(raw)] = np.frombuffer(raw, np.uint8)
        sums = (grid.reshape(rows, WIDTH) @ self.column).astype(np.int64) % self.primes
        return (sums * self.row[:rows] % self.primes).sum(0) % self.primes

    def at(self, raw: bytes, offset: int) -> list[int]:
        """The share of a chunk that begins at ``offset``."""
        return [int(v) * pow(b, offset, int(p)) % int(p)
                for v, b, p in zip(self.of(raw), BASES, self.primes)]


def ascii_lower(text: Column) -> Column:
    """Only A to Z are lowered."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def _joined(low: Column, high: Column) -> Column:
    return F.shiftleft(low, 31).bitwiseOR(high)


def _fingerprint(df: DataFrame, primes, chunk: int) -> DataFrame:
    """``piece`` (binary) and ``offset`` become ``low`` and ``high``, its share modulo each prime."""
    def make():
        poly = Polynomial(primes, chunk)
        return lambda x: tuple(poly.at(x["piece"], x["offset"]))

    return compute(df.withColumn("_x", F.struct("piece", "offset")).drop("piece", "offset"), "_x",
                   "low long, high long", make)


def _printed(df: DataFrame, primes, chunk: int) -> DataFrame:
    """Adds ``print``, the fingerprint of ``piece`` (binary), and passes all columns on."""
    kept = df.schema.fieldNames()

    def run(batches):
        poly = Polynomial(primes, chunk)
        for b in batches:
            found = np.array([poly.of(x.as_py()) for x in b.column("piece")], np.int64).reshape(-1, 2)
            both = (found[:, 0] << 31) | found[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(both)], [*kept, "print"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("print", T.LongType())]))


def _compared(pieces: DataFrame) -> DataFrame:
    """(print, n_bytes) whose chunks at one offset are not all equal."""
    return (pieces.groupBy("print", "n_bytes", "offset")
            .agg(F.min("piece").alias("a"), F.max("piece").alias("b")).filter("a != b")
            .select("print", "n_bytes").distinct())


def _told_apart(pieces: DataFrame) -> DataFrame:
    """(_row, kind): texts of one print have the same kind if all their chunks are equal."""
    at = ["print", "n_bytes", "offset"]
    order = Window.partitionBy(*at).orderBy("piece")
    # different chunks of different texts with one fingerprint: few, copies are one row here
    ranked = pieces.select(*at, "piece").distinct().withColumn("rank", F.row_number().over(order))
    return (pieces.join(ranked, [*at, "piece"]).groupBy("_row")
            .agg(F.sort_array(F.collect_list(F.struct("offset", "rank"))).alias("x"))
            .select("_row", F.to_json("x.rank").alias("kind")))


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: Sequence[Column] = (), chunk: int = CHUNK,
                primes: Sequence[int] = PRIMES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, then ``carry``), one row per input row.

    Rows whose texts are equal, but for the case of A to Z, form a group. The row with the largest id
    stays: ``keep_id`` is its id, ``kept`` is true for it alone. A null text counts as empty. A null id
    counts as smaller than any other; of rows with the largest id that repeat, exactly one stays.
    ``carry``: expressions over ``docs``, computed once per row and passed on. An empty table gives no
    rows; columns that are not named play no part, whatever their names.
    """
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.struct(*(carry or [F.lit(0)])).alias("carry"),
                       F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                       F.encode(text, "UTF-8").alias("piece"))
    short = rows.filter(F.col("n_bytes") <= chunk)
    own = F.monotonically_increasing_id().alias("_row")
    # huge texts go through Python in chunks only
    first = pin(_printed(rows.withColumn("piece", F.when(F.col("n_bytes") <= chunk, F.col("piece"))
                                         .otherwise(F.lit(b""))), primes, chunk)
                .select(own, "doc_id", "carry", "n_bytes", "print"), "copy-rows")
    chunks = None
    if first.filter(F.col("n_bytes") > chunk).limit(1).count():
        first, chunks = _with_long(rows.filter(F.col("n_bytes") > chunk), first, chunk, primes, own)
    largest = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_row")
    pair = ["print", "n_bytes"]
    groups = pin(first.groupBy(*pair).agg(F.count("*").alias("group_size"),
                                          F.max(largest).alias("top")), "copy-groups")
    differ = pin(_differing(groups, short, chunks, primes, chunk), "copy-differ")
    parts = []
    if differ.limit(1).count():
        parts = [_by_text(differ, short, chunks, primes, chunk, own, largest)]
        first = first.join(differ, pair, "left_anti")
    parts.append(first.join(groups, pair))
    names = first.schema["carry"].dataType.fieldNames() if carry else []
    out = [p.select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size",
                    (F.col("_row") == F.col("top._row")).alias("kept"),
                    *[F.col("carry").getField(x).alias(x) for x in names]) for p in parts]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _with_long(long_rows: DataFrame, first: DataFrame, chunk: int, primes, own: Column):
    """The rows with the fingerprints of huge texts added, and the chunks of those texts."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(chunk).cast("long"))
    cut = F.transform(starts, lambda s: F.struct(
        s.alias("offset"), F.substring("piece", (s + 1).cast("int"), F.lit(chunk)).alias("piece")))
    # written, so that a row keeps its number; dealt out, so that the chunks of a text are spread
    chunks = pin(long_rows.withColumn("_row", own)
                 .select("_row", "doc_id", "carry", "n_bytes", F.explode(cut).alias("x"))
                 .select("_row", F.when(F.col("x.offset") == 0, F.struct("doc_id", "carry")).alias("row"),
                         "n_bytes", "x.offset", "x.piece").repartition("_row", "offset"), "copy-chunks")
    shares = _fingerprint(chunks, primes, chunk)
    printed = pin(shares.groupBy("_row", "n_bytes").agg(
        F.first("row", True).alias("row"),
        _joined(F.sum("low") % int(primes[0]), F.sum("high") % int(primes[1])).alias("print")),
        "copy-long").select("_row", "row.doc_id", "row.carry", "n_bytes", "print")
    chunks = chunks.join(printed.select("_row", "print"), "_row")
    return first.filter(F.col("n_bytes") <= chunk).unionByName(printed), chunks


def _differing(groups, short, chunks, primes, chunk) -> DataFrame:
    """(print, n_bytes) that different texts share."""
    again = groups.filter("group_size > 1").select("print", "n_bytes")
    pieces = _printed(short.select("n_bytes", "piece"), primes, chunk).select(
        "print", "n_bytes", F.lit(0).cast("long").alias("offset"), "piece")
    # a small list is shipped to the texts, so only copies are shuffled; else all texts are, once
    if again.count() * 24 <= BROADCAST_BYTES:
        pieces = pieces.join(F.broadcast(again), ["print", "n_bytes"], "left_semi")
    if chunks is not None:
        pieces = pieces.unionByName(chunks.join(again, ["print", "n_bytes"], "left_semi")
                                    .select("print", "n_bytes", "offset", "piece"))
    return _compared(pieces)


def _by_text(differ, short, chunks, primes, chunk, own, largest) -> DataFrame:
    """Rows of shared fingerprints with the groups that their texts form."""
    kept = ["_row", "doc_id", "carry", "n_bytes", "print", "offset", "piece"]
    pieces = (_printed(short, primes, chunk).join(differ, ["print", "n_bytes"], "left_semi")
              .withColumn("offset", F.lit(0).cast("long")).withColumn("_row", own).select(*kept))
    if chunks is not None:
        long_pieces = chunks.join(differ, ["print", "n_bytes"], "left_semi").select(
            "_row", F.col("row.doc_id").alias("doc_id"), F.col("row.carry").alias("carry"), "n_bytes",
            "print", "offset", "piece")
        # short and huge texts are numbered apart
        pieces = pieces.withColumn("_row", -1 - F.col("_row")).unionByName(long_pieces)
    pieces = pin(pieces, "copy-shared")
    kinds = pin(_told_apart(pieces), "copy-kinds")
    told = pieces.filter("offset = 0").join(kinds, "_row")
    sums = pin(told.groupBy("print", "n_bytes", "kind").agg(F.count("*").alias("group_size"),
                                                           F.max(largest).alias("top")), "copy-told")
    return told.join(sums, ["print", "n_bytes", "kind"])


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    whole = F.struct(*docs.columns).alias("row")
    return copy_groups(docs, id_col, text_col, [whole]).filter("kept").select("row.*")


def copy_digests(docs: DataFrame) -> DataFrame:
    """The groups of all documents with a digest of each normalised text."""
    digest = F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)
    return copy_groups(docs, carry=[digest.alias("text_sha256")])
