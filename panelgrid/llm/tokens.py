"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel, stitched and encoded.

A match of the pattern depends only on the text from its start on, so two runs over the same text
agree from the first boundary they share. Chunks overlap; where a boundary of one chunk is also one
of the next, the next takes over. Without such a place the piece is matched anew over the
following chunks until the boundaries meet again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.common import compute, narrow

CHUNK = 1 << 16  # code points a chunk advances
OVERLAP = 1 << 10
GUARD = 4  # a match that ends nearer to the end of a chunk may depend on what follows
CACHED = 1 << 19  # pieces whose ids a worker remembers
SHORT = 64  # bytes up to which the pairs of a piece are kept in a list
NO_RANK = 1 << 62
#: White space as Unicode defines it, which is what the tokenizers' engine takes for \s.
BLANK = "\t-\r \x85\xa0  -     　"


def compiled(pattern: str):
    """The pattern with \\s spelt out; the engines differ in a few control characters."""
    inside = regex.sub(r"\[([^\]]*)\]",
                       lambda m: "[" + m[1].replace(r"\s", BLANK) + "]", pattern)
    return regex.compile(inside.replace(r"\S", f"[^{BLANK}]").replace(r"\s", f"[{BLANK}]"))


class Vocabulary:
    """Ranks of a vocabulary file, merges by rank, and the bytes of an id."""

    def __init__(self, lines: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b)
                      for a, b in (x.split() for x in lines.splitlines() if x)}
        self.bytes = {b: a for a, b in self.ranks.items()}
        self.pattern = compiled(pattern)
        self.known: dict[str, tuple[str, bytes]] = {}

    def piece(self, piece: str) -> list[int]:
        """Ids of one match of the pattern: the pair of lowest rank merges first, leftmost of ties."""
        raw = piece.encode()
        if raw in self.ranks:
            return [self.ranks[raw]]
        return self._short(raw) if len(raw) <= SHORT else self._long(raw)

    def _short(self, raw: bytes) -> list[int]:
        """All pairs in a list: the least is looked for again after each merge."""
        rank = self.ranks.get
        parts = [raw[i:i + 1] for i in range(len(raw))]
        pairs = [rank(raw[i:i + 2], NO_RANK) for i in range(len(raw) - 1)]
        while pairs and (least := min(pairs)) < NO_RANK:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], NO_RANK)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], NO_RANK)
        return [self.ranks[p] for p in parts]

    def _long(self, raw: bytes) -> list[int]:
        """The pairs in a heap."""
        ranks, n = self.ranks, len(raw)
        end = list(range(1, n + 1))  # of the part that starts here; 0 once merged away
        before = list(range(-1, n - 1))

        def push(start):
            second = end[start]
            if second < n:
                rank = ranks.get(raw[start:end[second]])
                if rank is not None:
                    heapq.heappush(heap, (rank, start, end[second]))

        heap: list[tuple[int, int, int]] = []
        for i in range(n - 1):
            push(i)
        while heap:
            _, start, stop = heapq.heappop(heap)
            second = end[start]
            if not second or second >= n or end[second] != stop:
                continue  # one of the two parts has changed since
            end[start], end[second] = stop, 0
            if stop < n:
                before[stop] = start
            push(start)
            if before[start] >= 0:
                push(before[start])
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i:end[i]]])
            i = end[i]
        return out

    def encode(self, pieces: list[str]) -> list[int]:
        return [i for p in pieces for i in self.piece(p)]

    def written(self, pieces: list[str]) -> tuple[str, bytes]:
        """The ids of the pieces, joined by commas, and the bytes they decode to."""
        known = self.known
        if len(known) >= CACHED:
            known.clear()
        for p in set(pieces).difference(known):
            ids = self.piece(p)
            known[p] = ",".join(map(str, ids)), self.decode(ids)
        found = [known[p] for p in pieces]
        return ",".join([x[0] for x in found]), b"".join([x[1] for x in found])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=1)
def shared(lines: bytes, pattern: str) -> Vocabulary:
    """One for all tasks of a worker, so that they share the pieces it knows."""
    return Vocabulary(lines, pattern)


def boundaries(pattern, text: str, start: int = 0) -> list[int]:
    """Ends of the matches; the pattern leaves nothing between them."""
    return [m.end() for m in pattern.finditer(text, start)]


def stitch(pattern, chunks: list[tuple[int, str, list[int]]]) -> Iterator[list[str]]:
    """Pieces of a document from (offset, text, ends of the matches in text) of its chunks.

    ``held`` is what lies between the last sure boundary and the end of the chunks so far.
    """
    at, held, held_at = 0, "", 0  # next piece starts at ``at``; held: text known from held_at on
    for k, (offset, text, ends) in enumerate(chunks):
        last = k == len(chunks) - 1
        held += text[held_at + len(held) - offset:]
        limit = offset + len(text) - (0 if last else GUARD)
        own = {offset + e for e in ends}
        own.add(offset)
        pieces = []
        # match on from the sure boundary until this chunk's own boundaries agree
        while at not in own:
            m = pattern.match(held, at - held_at)
            if m is None or held_at + m.end() > limit:
                break
            pieces.append(m[0])
            at = held_at + m.end()
        else:
            for e in ends:
                if offset + e > limit:
                    break
                if offset + e > at:
                    pieces.append(text[at - offset:e])
                    at = offset + e
        held, held_at = held[at - held_at:], at
        if pieces:
            yield pieces


def digests(vocabulary: Vocabulary, runs: Iterator[list[str]]) -> tuple[int, str, str]:
    """(number of ids, digest of the ids, digest of the decoded bytes), run by run."""
    n, ids_sha, raw_sha = 0, hashlib.sha256(), hashlib.sha256()
    for pieces in runs:
        if pieces:
            ids, raw = vocabulary.written(pieces)
            ids_sha.update(("," * bool(n) + ids).encode())
            raw_sha.update(raw)
            n += ids.count(",") + 1
    return n, ids_sha.hexdigest(), raw_sha.hexdigest()


def encode_digests(docs: DataFrame, vocabulary_path: str, pattern: str, chunk: int = CHUNK,
                   overlap: int = OVERLAP, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per input row.

    Texts of one chunk are encoded where they are read. Longer ones are cut by Spark, their chunks
    matched in parallel and gathered by document; only boundaries decide, so results don't depend
    on the chunk size. A null text counts as empty and has no ids; null ids are kept; repeated rows
    give a row each; an empty table gives none.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, "rb") as f:  # a fixed file of the installation, under a megabyte
        lines = spark.sparkContext.broadcast(f.read())
    rows = narrow(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    id_type = docs.schema[id_col].dataType.simpleString()

    def encoder():
        v = shared(lines.value, pattern)
        return lambda text: digests(v, iter([v.pattern.findall(text)]))

    def matcher():
        p = compiled(pattern)
        return lambda text: (text, boundaries(p, text))

    def joined(batch: pd.DataFrame) -> pd.DataFrame:
        v = shared(lines.value, pattern)
        batch = batch.sort_values("offset")
        chunks = zip(batch["offset"], batch["text"], batch["ends"])
        found = digests(v, stitch(v.pattern, [(int(o), t, e.tolist()) for o, t, e in chunks]))
        return pd.DataFrame([(batch["doc_id"].iloc[0], *found)], columns=[
            "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    long = F.char_length("text") > chunk
    short_rows = compute(rows.filter(~long), "text", fields, encoder)
    # ``row`` tells repeated rows apart
    chunks = (rows.filter(long).withColumn("row", F.monotonically_increasing_id())
              .withColumn("offset", F.explode(F.sequence(
                  F.lit(0), F.char_length("text") - 1, F.lit(chunk))))
              .withColumn("text", F.expr(f"substring(text, offset + 1, {chunk + overlap})")))
    parts = compute(chunks.repartition("row", "offset"), "text", "text string, ends array<int>",
                    matcher)
    return short_rows.unionByName(
        parts.groupBy("row").applyInPandas(joined, f"doc_id {id_type}, {fields}"))
