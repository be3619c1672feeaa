"""Substring dedup by sliding runs of sentences.

Every run of several consecutive sentences is hashed; equal runs of all documents meet and are put in
order of their documents. Sentences that lie in a repeated run are removed, except in its first occurrence.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelgrid.llm.common import compute
from panelgrid.llm.hashing import BASE, Hasher, mixed, sliding_least

MAX_WORDS = 14  # longer sentences are cut at words whose hash is the least in a window
WINDOW = 8  # words of a window; every window has such a word, so cuts are at most so far apart
MAX_PART = 2 * WINDOW  # no part is longer
MIN_SENTENCES = 2
MIN_WORDS = 20  # a run has at least so many sentences and words
ROWS = 50_000  # runs that a task hands on at a time
LAST_SPACE = 0x3000  # the greatest code point that is white space
SPACE = np.array([chr(c).isspace() for c in range(LAST_SPACE + 1)] + [False])


def cut_places(words: list[str], stops: np.ndarray) -> np.ndarray:
    """Whether a long sentence may be cut after each word; sentences end before ``stops``.

    That depends on the words of the sentence within WINDOW places only, so that equal sentences
    are cut alike, and so is a passage in whatever sentence it stands: of 50 words or more, at most
    16 before its first and 14 behind its last common cut, so that a run of 20 words always lies
    between. Equal values are all cut at: text of few words is cut by what repeats in it.
    """
    value = np.array([crc32(w.encode()) for w in words], np.uint64)
    before = np.concatenate([value[:1], value[:-1]])
    starts = np.concatenate([[0], stops[:-1]])
    before[starts] = value[starts]
    value = mixed(value * np.uint64(BASE) + before)
    sentence = np.repeat(np.arange(len(stops)), stops - starts)
    least = sliding_least(value, WINDOW)
    least[sentence[:1 - WINDOW] != sentence[WINDOW - 1:]] = 0  # windows lie in one sentence
    none = np.zeros(WINDOW - 1, np.uint64)
    return value == ~sliding_least(~np.concatenate([none, least, none]), WINDOW)


def part_ends(text: str, stops: np.ndarray) -> np.ndarray:
    """``stops`` and the places where long sentences are cut, as numbers of words before."""
    lengths = stops - np.concatenate([[0], stops[:-1]])
    if lengths.max() <= MAX_WORDS:
        return stops
    cuts = np.flatnonzero(cut_places(text.split(), stops)) + 1
    at = np.searchsorted(stops, cuts)  # the sentence of each
    return np.union1d(stops, cuts[lengths[at] > MAX_WORDS])


def parts(text: str, h: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, end, words and hash of the words of each sentence or part of one, in code points.

    A sentence ends at a line break or behind one of ``.!?`` and white space.
    """
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    word = np.concatenate([[False], ~SPACE[np.minimum(raw, LAST_SPACE + 1)], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    start, end = edges[::2], edges[1::2]
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none, none, np.zeros(0, np.uint64)
    value = h.stretches(raw, start, end)
    final = raw[end - 1]
    last = (final == ord(".")) | (final == ord("!")) | (final == ord("?"))
    before = np.searchsorted(start, np.flatnonzero(raw == ord("\n")))  # words before line breaks
    last[before[before > 0] - 1] = True
    last[-1] = True
    ends = part_ends(text, np.flatnonzero(last) + 1)
    begins = np.concatenate([[0], ends[:-1]])
    return start[begins], end[ends - 1], ends - begins, h.stretches(value, begins, ends)


def sentences(text: str) -> list[tuple[int, int, int, int]]:
    """``parts`` as a list of (start, end, words, hash)."""
    return list(zip(*(x.tolist() for x in parts(text, Hasher()))))


def runs(text: str | None, h: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the shortest run from each sentence on and up to each sentence."""
    start, end, words, value = parts(text or "", h)
    n = len(start)
    if n < MIN_SENTENCES:
        none = np.zeros(0, np.int64)
        return none, none, none
    total = np.concatenate([[0], np.cumsum(words)])
    first = np.arange(n)
    # forward: the least last sentence that makes both minima; backward: the greatest first one
    stop = np.maximum(np.searchsorted(total, total[:-1] + MIN_WORDS), first + MIN_SENTENCES)
    begin = np.minimum(np.searchsorted(total, total[1:] - MIN_WORDS, "right") - 1,
                       first + 1 - MIN_SENTENCES)
    pairs = np.unique(np.concatenate([(first * (n + 1) + stop)[stop <= n],
                                      (begin * (n + 1) + first + 1)[begin >= 0]]))
    i, j = pairs // (n + 1), pairs % (n + 1)
    return h.stretches(value, i, j).view(np.int64), start[i], end[j - 1]


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of covered characters."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def beaten(hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether a hash has a lesser place elsewhere in the arrays."""
    order = np.lexsort((place, hashes))
    h, p = hashes[order], place[order]
    fresh = np.concatenate([[True], h[1:] != h[:-1]])[:len(h)]
    out = np.zeros(len(h), bool)
    out[order] = p > p[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    return out


def places(ids: list, marks: list[int]) -> np.ndarray:
    """Numbers in order of (id, mark), null ids first; rows that repeat both share one."""
    keys = [(False, m) if i is None else (True, i, m) for i, m in zip(ids, marks)]
    rank = {k: n for n, k in enumerate(sorted(set(keys)))}
    return np.array([rank[k] for k in keys], np.int64)


def different_runs(batch: pa.RecordBatch, h: Hasher, ordered: bool) -> pa.RecordBatch:
    """(doc_id, mark, hash, own, apart): the different runs of each text of (doc_id, text, mark).

    ``own`` tells those that a text holds more than once. ``apart`` is null where no document before
    it in this batch has the run, else the mark; if ids are not ``ordered`` as Spark orders them, null.
    """
    found = [np.unique(runs(t, h)[0], return_counts=True) for t in batch.column("text").to_pylist()]
    at = np.repeat(np.arange(len(found)), [len(x) for x, _ in found])
    none = np.zeros(0, np.int64)
    hashes = np.concatenate([none, *(x for x, _ in found)])
    times = np.concatenate([none, *(n for _, n in found)])
    ids, marks = batch.column("doc_id").take(pa.array(at)), batch.column("mark").to_numpy()[at]
    if ordered:
        first = ~beaten(hashes, places(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist())[at])
    else:
        first = np.ones(len(hashes), bool)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(marks), pa.array(hashes), pa.array(times > 1), pa.array(marks, mask=first)],
        ["doc_id", "mark", "hash", "own", "apart"])


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, gone, later): hashes of runs to remove, everywhere or but for their first place.

    ``docs`` has doc_id, text and mark, a hash of the text. The first occurrence of a run is that of
    the least (doc_id, mark), and there the first. Only hashes are shuffled, once; their places are
    found again in the texts that repeat something. Of the documents of a batch only the first with a
    run can be the first of all, so only that one meets those of other batches; the others are dealt
    by their marks too, and a run that most documents share is no burden.
    """
    id_type = docs.schema["doc_id"].dataType
    ordered = isinstance(id_type, T.IntegralType) or id_type == T.StringType()

    def run(batches):
        h = Hasher()
        for b in batches:
            found = different_runs(b, h, ordered)
            for i in range(0, len(found), ROWS):
                yield found.slice(i, ROWS)

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("mark", T.LongType()),
                           T.StructField("hash", T.LongType()), T.StructField("own", T.BooleanType()),
                           T.StructField("apart", T.LongType())])
    found = docs.select("doc_id", "text", "mark").mapInArrow(run, schema)
    before = F.rank().over(Window.partitionBy("hash", "apart").orderBy("doc_id", "mark")) > 1
    told = found.withColumn("whole", F.col("apart").isNotNull() | before).filter("whole or own")
    return told.groupBy("doc_id", "mark").agg(
        F.collect_set(F.when(F.col("whole"), F.col("hash"))).alias("gone"),
        F.collect_set(F.when(~F.col("whole"), F.col("hash"))).alias("later"))


def spans_of(text: str, gone: list[int], later: list[int], h: Hasher) -> list[tuple[int, int]]:
    """Maximal spans of a text that its repeated runs cover."""
    gone, later, out = set(gone), set(later), []
    for value, start, end in zip(*(x.tolist() for x in runs(text, h))):
        if value in gone:
            out.append((start, end))
        elif value in later:  # this first one stays
            later.remove(value)
            gone.add(value)
    return merged(out)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, text without its repeated sentences, and ``removed_spans`` as
    start:end in code points of the input text, comma-joined.

    A null text has no sentences and stays null; texts shorter than a run are kept; null ids come
    first; rows that repeat both id and text count as one document and are treated alike; an empty
    table gives no rows.
    """
    # other columns travel as one struct, so they cannot clash
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*(others or [F.lit(0)])).alias("row"),
                       F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("mark"))
    told = repeated_runs(rows.select("doc_id", "text", "mark")).select(
        F.col("doc_id").alias("id"), F.col("mark").alias("same"), F.struct("gone", "later").alias("runs"))
    joined = rows.join(told, rows["doc_id"].eqNullSafe(told["id"]) & (rows["mark"] == told["same"]), "left")

    def cutter():
        h = Hasher()

        def cut(x):
            text = x["text"]
            spans = spans_of(text, **x["runs"], h=h) if x["runs"] else []
            if not spans:
                return text, ""
            edges = [0, *(p for s in spans for p in s), len(text)]
            kept = [text[a:b].strip() for a, b in zip(edges[::2], edges[1::2])]
            return "\n".join(k for k in kept if k), ",".join(f"{s}:{e}" for s, e in spans)
        return cut

    done = compute(joined.select("row", F.struct("text", "runs").alias("cut")), "cut",
                   "text string, spans string", cutter)
    out = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c)
           for c in docs.columns if c != "removed_spans"]
    return done.select(*out, F.col("spans").alias("removed_spans"))
