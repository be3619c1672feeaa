"""Periodic runs of words, by a sparse table of match lengths on diagonals.

A diagonal is a lag d: word i matches word i - d. A run of period d shows as a stretch of matches on its
diagonal, at least 3 d of them for a run of four periods. Short lags are compared word by word. Longer
ones, from 2**k to twice that, are opened only at every 2**k-th word, one for each earlier occurrence of
that word in reach (a stretch that long holds such a word), then counted up word by word while they
match. A diagonal that ends with enough matches is a run at once. Lags that only repeat the period of
a run around both words are not opened, so the work stays near n log n where words repeat without end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.common import compute, narrow

PERIODS = 4  # a run is so many periods long at least,
LEAST = 6  # and so many words
DENSE = 8  # lags below are compared word by word
PIECE = 1 << 22  # bytes of text whose words are held as objects at a time
OPEN = 1 << 20  # diagonals followed at a time
WHITE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(raw: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes, cut between words."""
    at = 0
    while at < len(raw):
        cut = WHITE.search(raw, min(at + PIECE, len(raw)))
        end = cut.start() if cut else len(raw)
        yield raw[at:end]
        at = end


def numbered(raw: bytes) -> np.ndarray:
    """A number for each word, the same for equal words."""
    seen: dict[bytes, int] = {}
    parts = [np.array([seen.setdefault(w, len(seen)) for w in p.split()], np.int64)
             for p in pieces(raw)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def enough(matches, lag):
    """Whether a stretch of matches on a diagonal makes a run."""
    return (matches + lag >= LEAST) & (matches >= (PERIODS - 1) * lag)


class _Diagonals:
    """Runs found so far in one text, with the last one around each word."""

    def __init__(self, words: np.ndarray):
        self.words, self.found = words, {}
        self.start = np.zeros(len(words), np.int64)
        self.period = np.zeros(len(words), np.int64)

    def emit(self, first: np.ndarray, last: np.ndarray, lag: np.ndarray) -> None:
        """Matches from ``first`` to ``last`` on the diagonal ``lag``: a run if they are enough."""
        for a, b, d in zip(*(x[enough(last - first + 1, lag)].tolist() for x in (first, last, lag))):
            place = a - d, b + 1
            if self.found.get(place, d + 1) > d:
                self.found[place] = d
                self.start[a - d:b + 1], self.period[a - d:b + 1] = a - d, d

    def short(self, lag: int) -> None:
        w = self.words
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (w[lag:] == w[:-lag]).view(np.int8), [0]])))
        first = edge[::2] + lag
        self.emit(first, edge[1::2] + lag - 1, np.full(len(first), lag))

    def known(self, here: np.ndarray, lag: np.ndarray) -> np.ndarray:
        """Whether both words lie in one run whose period divides the lag: that run again."""
        period = self.period[here]
        return (period > 0) & (here - lag >= self.start[here]) & (lag % np.maximum(period, 1) == 0)

    def follow(self, here: np.ndarray, lag: np.ndarray, step: int, most: int) -> np.ndarray:
        """How many further words match, up to ``most``, going by ``step`` (1 or -1)."""
        n, count, active, t = len(self.words), np.zeros(len(here), np.int64), np.arange(len(here)), 1
        while len(active) and t <= most:
            at = here[active] + step * t
            inside = (at < n) & (at >= lag[active])
            active, at = active[inside], at[inside]
            same = self.words[at] == self.words[at - lag[active]]
            active = active[same]
            count[active] += 1
            t += 1
        return count

    def open(self, here: np.ndarray, lag: np.ndarray, width: int) -> None:
        """Follows the diagonals opened at words ``here``, which lie ``width`` apart or a multiple."""
        new = ~self.known(here, lag)
        here, lag = here[new], lag[new]
        by = np.lexsort([here, lag])
        here, lag = here[by], lag[by]
        ahead = self.follow(here, lag, 1, width - 1)
        # a diagonal that matches up to the next word where it is open goes on there
        goes_on = (ahead[:-1] == width - 1) & (lag[1:] == lag[:-1]) & (here[1:] - here[:-1] == width)
        head = np.concatenate([[True], ~goes_on])[:len(here)]
        tail = np.concatenate([~goes_on, [True]])[:len(here)]
        last = here[tail] + ahead[tail]
        lag = lag[tail]
        first = here[head]
        n = len(self.words)
        self.emit(first - self.follow(first, lag, -1, n), last + self.follow(last, lag, 1, n), lag)


def word_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    n = len(words)
    if n < LEAST:
        return []
    table = _Diagonals(words)
    for lag in range(1, min(DENSE, n // PERIODS + 1)):
        table.short(lag)
    width = DENSE
    if PERIODS * width <= n:
        order = np.argsort(words, kind="stable")
        places = words[order] * n + order
    while PERIODS * width <= n:
        here = np.arange(width, n, width)
        base = words[here] * n
        low = np.searchsorted(places, base + np.maximum(here - min(2 * width - 1, n // PERIODS), 0))
        high = np.searchsorted(places, base + here - width, side="right")
        times = np.maximum(high - low, 0)
        total = np.cumsum(times)
        at = 0
        while at < len(here):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + OPEN)))
            own = times[at:to]
            each = np.repeat(here[at:to], own)
            if len(each):
                nth = np.arange(len(each)) - np.repeat(np.cumsum(own) - own, own)
                table.open(each, each - order[np.repeat(low[at:to], own) + nth], width)
            at = to
        width *= 2
    return sorted((a, b - a, d) for (a, b), d in table.found.items())


def collapsed(raw: bytes, runs: list[tuple[int, int, int]], n: int) -> bytes:
    """The words, joined by one space, without those that a run holds after its first period."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    at, out = 0, []
    for p in pieces(raw):
        words = p.split()
        out += [b" ".join(compress(words, keep[at:at + len(words)].tolist()))]
        at += len(words)
    return b" ".join(x for x in out if x)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed), one row per input row.

    runs: array of (start, length, period) in words, by start and period; every stretch of at least
    PERIODS periods and LEAST words that no neighbouring word extends. collapsed: the text with one
    space between words and no repeats of a run. A null or blank text has no words and no runs; null ids
    are kept; repeated rows give a row each; an empty table gives none; further columns are not read.
    """
    rows = narrow(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))

    def make():
        def found(text):
            raw = text.encode()
            words = numbered(raw)
            runs = word_runs(words)
            return (len(words), [{"start": a, "length": b, "period": d} for a, b, d in runs],
                    collapsed(raw, runs, len(words)).decode())
        return found

    return compute(rows, "text", "n_words long, runs array<struct<start: long, length: long, "
                   "period: long>>, collapsed string", make)


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by checksum of the id, get a repeated end.

    From word a on, word i becomes word a + (i - a) % p. A null id or text is left as it is.
    """
    words = F.regexp_extract_all(F.col("text"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = docs.select("doc_id", "text").withColumn(
        "h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn(
        "words", F.when(F.col("h") % 10 == 0, words))
    n = F.size("words").cast("long")
    g = F.floor(F.col("h") / 10)
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn(
        "p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    edited = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.element_at(
        "words", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(edited, " "))
                       .otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """The longest run and digests of all runs and of the collapsed text, per document."""
    rows = find_runs(with_repeats(docs)).withColumn("best", F.array_max(F.transform(
        "runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"),
                                   (-r["period"]).alias("period")))))
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                    r["period"].cast("string")), F.lit("\n")))
    period = -F.col("best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), period.alias("period"),
        F.floor(1000 * F.col("best.length") / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
