"""Removal of long byte strings that occur twice, by suffix arrays of shards.

Every 400-byte string has an anchor, the least hash of the 64-byte strings in it. Equal strings have
equal anchors, so anchors that occur once are passed over, and the others say which shard a stretch
of starts belongs to: equal strings always meet in one shard. Equal stretches are counted and kept
once. A shard sorts its suffixes by Larsson-Sadakane refinement, up to the length in question, and
Kasai's rule gives the common prefixes of neighbours. Anchors with too many different surroundings
for one shard are dealt out over many without suffix arrays: their strings are named by 128-bit
hashes, and a hash aggregation and a join, not a binary search, tell which names occur twice.

Passages, strings of so many words, are found on the way, with anchors of 8 words; nothing is removed
for them. Equal stretches are told by a 64-bit hash. Of those that differ one each carries hashes of
its passages, and equal ones are counted in the shard of the anchor, or dealt out if crowded.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from panelgrid.llm.common import compute, narrow, pin
from panelgrid.llm.hashing import Hasher, mixed, sliding_least

LENGTH = 400
ANCHOR = 64
WORDS = 49  # whole words in a passage of 51 that is glued to its neighbours at both ends
WORD_ANCHOR = 8
SHARD_BYTES = 2 << 20  # text of one suffix array
CROWDED = 3000  # different surroundings of an anchor that are dealt out over shards


def anchored(h: Hasher, sums: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, first, last, twice) of each stretch of starts with the same anchor.

    twice: the anchor stands at several places of the text, so even one stretch may repeat itself.
    """
    n = len(sums) - 1
    if n < length:
        return (*(np.zeros(0, np.int64),) * 3, np.zeros(0, bool))
    size = min(ANCHOR, length)
    at = np.arange(n - size + 1)
    return _stretches_of_anchors(h.between(sums, at, at + size), length - size + 1, length)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte behind it."""
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def passage_stretches(h: Hasher, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                      words: int) -> tuple[np.ndarray, ...]:
    """(anchor, hash of the stretch, first byte, passages but one, twice) of each stretch of passages.

    starts, ends: bounds of the words. No key is that of a byte anchor.
    """
    if len(starts) < words:
        return (*(np.zeros(0, np.int64),) * 4, np.zeros(0, bool))
    size = min(WORD_ANCHOR, words)
    hashes = ~h.between(sums, starts[:len(starts) - size + 1], ends[size - 1:])
    keys, first, last, twice = _stretches_of_anchors(hashes, words - size + 1, words)
    whole = h.between(sums, starts[first], ends[last + words - 1])
    return keys, whole.view(np.int64), starts[first], last - first, twice


def passage_names(h: Hasher, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                  words: int) -> np.ndarray:
    """A 64-bit hash of the passage at each word, white space included."""
    return h.stretches(raw, starts[:len(starts) - words + 1], ends[words - 1:])


def _stretches_of_anchors(hashes: np.ndarray, width: int, length: int) -> tuple[np.ndarray, ...]:
    least = sliding_least(hashes, width)
    # a place is chosen if the greatest minimum of the windows around it is its own hash
    sides = np.zeros(width - 1, np.uint64)
    most = ~sliding_least(~np.concatenate([sides, least, sides]), width)
    chosen = np.sort(hashes[hashes == most])
    values = chosen[1:][chosen[1:] == chosen[:-1]]
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(least) - 1]])
    long = last - first >= length  # a periodic text: any cut will do
    if long.any():
        first = np.unique(np.concatenate([first, *(np.arange(a, b, length) for a, b in
                                                   zip(first[long], last[long]))]))
        last = np.concatenate([first[1:] - 1, [len(least) - 1]])
    keys = least[first]
    twice = np.isin(keys, values) if len(values) else np.zeros(len(keys), bool)
    return keys.view(np.int64), first, last, twice


def refined(words: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Positions in ``valid`` in order of their first ``length`` bytes.

    words: the eight bytes from each position on. Ranks by h bytes give ranks by up to 2h; only
    groups that are still open are sorted again, and only positions that later rounds look at stay.
    """
    n, steps, h = len(words), [], min(8, length)
    while h < length:
        steps.append(min(h, length - h))
        h += steps[-1]
    needed = [valid]  # per round, last first
    for step in reversed(steps[1:]):
        more = needed[-1].copy()
        more[step:] |= needed[-1][:-step]
        needed.append(more)
    order = np.argsort(words, kind="stable")
    new = np.concatenate([[True], words[order][1:] != words[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    for step, need in zip(steps, reversed(needed)):
        kept = need[order]
        order = order[kept]
        own = rank[order]
        new = np.concatenate([[True], own[1:] != own[:-1]])
        open_ = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
        at = order[open_]
        far = at + step
        second = np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)
        both = own[open_] * np.int64(n + 1) + second
        by = np.argsort(both, kind="stable")
        order[open_] = at[by]
        both = both[by]
        new[open_] = np.concatenate([[True], both[1:] != both[:-1]])[:len(both)]
        rank[order] = np.cumsum(new) - 1
    return order[valid[order]]


def common_prefixes(words: np.ndarray, order: np.ndarray, starts: np.ndarray, counts: np.ndarray,
                    length: int) -> np.ndarray:
    """Common prefix, up to ``length``, of each place in ``order`` with the place before it.

    Kasai's rule, all texts side by side: a prefix is at most one shorter than that of the start
    before, as long as the start it was shared with has a successor that sorts earlier too.
    """
    n = len(words)
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.arange(len(order))
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    lanes = np.argsort(-counts, kind="stable")
    starts, counts = starts[lanes], counts[lanes]
    shared = np.zeros(len(starts), np.int64)
    active = len(starts)
    for t in range(int(counts[0]) if len(counts) else 0):
        while active and counts[active - 1] <= t:
            active -= 1
        here = starts[:active] + t
        there = before[here]
        last = before[here - 1] if t else np.full(active, -1)
        goes_on = (last >= 0) & (rank[last + 1] >= 0) & (rank[last + 1] < rank[here])
        got = np.where(goes_on, np.maximum(shared[:active] - 1, 0), 0)
        got[there < 0] = 0
        lane = np.flatnonzero(there >= 0)
        while len(lane):
            a, b = here[lane] + got[lane], there[lane] + got[lane]
            inside = (a < n) & (b < n) & (got[lane] < length)
            lane, a, b = lane[inside], a[inside], b[inside]
            differ = words[a] ^ words[b]
            same = differ == 0
            got[lane] += np.where(same, 8, sum((differ < np.uint64(1 << k)).astype(np.int64)
                                               for k in range(8, 64, 8)))
            lane = lane[same]
        shared[:active] = np.minimum(got, length)
        out[here] = shared[:active]
    return out[order]


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, whether the string at each start occurs at another start of any text."""
    sizes = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"\0".join(texts) + bytes(8), np.uint8)
    n = len(raw) - 7
    words = np.zeros(n, np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | raw[i:i + n]
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    counts = np.maximum(sizes - length + 1, 0)
    valid = np.zeros(n, bool)
    for s, c in zip(starts, counts):
        valid[s:s + c] = True
    if not valid.any():
        return [np.zeros(0, bool) for _ in texts]
    order = refined(words, valid, length)
    groups = np.cumsum(common_prefixes(words, order, starts, counts, length) < length)
    found = np.zeros(n, bool)
    found[order] = np.bincount(groups)[groups] > 1
    return [found[s:s + c] for s, c in zip(starts, counts)]


def stretches(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last index of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2].tolist(), (edge[1::2] - 1).tolist()


def string_names(h: Hasher, text: bytes, length: int) -> np.ndarray:
    """Two 64-bit hashes of the string at each start."""
    raw = np.frombuffer(text, np.uint8)
    at = np.arange(len(raw) - length + 1)
    half = length // 2
    return np.stack([h.stretches(raw, at, at + length),
                     mixed(h.stretches(raw, at, at + half) + np.uint64(3) * h.stretches(
                         raw, at + half, at + length))], 1).view(np.int64)


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)],
                                      schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(ddl))


RUN = ["key", "whole", "first", "last", "twice", "by_word"]


def _runs(docs: DataFrame, length: int, words: int) -> DataFrame:
    """(doc_id, mark, key, whole, first, last, twice, by_word): stretches with an anchor that occurs again.

    Of bytes, whole is 0; by_word, first is a byte and last counts the passages behind the first.
    """
    def finder():
        h = Hasher()

        def find(t):
            raw = np.frombuffer(t.encode(), np.uint8)
            sums = h.sums(raw)
            keys, first, last, twice = anchored(h, sums, length)
            told = passage_stretches(h, sums, *word_bounds(raw), words)
            both = zip((keys, np.zeros(len(keys), np.int64), first, last, twice), told,
                       (np.int64, np.int64, np.int32, np.int32, bool))
            return (*(np.concatenate([x, y], dtype=t, casting="same_kind") for x, y, t in both),
                    np.arange(len(keys) + len(told[0])) >= len(keys))
        return find

    found = compute(docs, "text", "key array<long>, whole array<long>, first array<int>, "
                    "last array<int>, twice array<boolean>, by_word array<boolean>", finder)
    runs = found.select("doc_id", "mark", F.explode(F.arrays_zip(*RUN)).alias("x")).select(
        "doc_id", "mark", *(F.col(f"x.{c}").alias(c) for c in RUN))
    same = Window.partitionBy("key")
    return pin(runs.withColumn("n", F.count("*").over(same)).withColumn("again", F.max("twice").over(same))
               .filter("n > 1 or again").drop("n", "again"), "suffix-runs", "zstd")


def _unsettled(texts: DataFrame) -> DataFrame:
    """Rows of (key, digest, twice, n) with kinds: where every stretch has an equal one, all its starts
    are repeated already."""
    kinds = texts.groupBy("key").agg(
        F.count("*").alias("kinds"), F.min("n").alias("least"),
        F.max("twice").alias("again"))
    return texts.join(kinds.filter((F.col("least") == 1) & (
        (F.col("kinds") > 1) | F.col("again"))), "key")


def _surroundings(runs: DataFrame, packed: DataFrame, length: int, words: int) -> DataFrame:
    """(key, by_word, digest, text, doc_id, mark, first, twice): the stretches in ``runs`` with their text,
    or by_word with the names of their passages.
    """
    by_doc = (runs.groupBy("doc_id", "mark")
              .agg(F.collect_set(F.struct(RUN)).alias("runs"))
              .select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"),
                      *(F.col(f"runs.{c}").alias(f"{c}s") for c in RUN)))
    joined = packed.join(by_doc, packed["doc_id"].eqNullSafe(F.col("_id"))
                         & (packed["mark"] == F.col("_mark"))).select(
                             "doc_id", "mark", "packed", *(f"{c}s" for c in RUN))
    id_type = packed.schema["doc_id"].dataType.simpleString()
    ddl = (f"key long, by_word boolean, digest binary, text binary, doc_id {id_type}, mark long, "
           "first int, twice boolean")
    target = _arrow(ddl)

    def cut(batches):
        box, h = zstandard.ZstdDecompressor(), Hasher()
        for b in batches:
            out, size = [], 0
            for doc_id, mark, packed, *runs in zip(*(b.column(c).to_pylist() for c in (
                    "doc_id", "mark", "packed", *(f"{c}s" for c in RUN)))):
                raw = box.decompress(packed)
                if any(runs[-1]):
                    own = np.frombuffer(raw, np.uint8)
                    starts, ends = word_bounds(own)
                    named = passage_names(h, own, starts, ends, words)
                for key, whole, first, last, twice, by_word in zip(*runs):
                    if by_word:
                        at = int(np.searchsorted(starts, first))
                        part = named[at:at + last + 1].tobytes()
                        digest = whole.to_bytes(8, "big", signed=True)
                    else:
                        part = raw[first:last + length]
                        digest = hashlib.blake2b(part, digest_size=16).digest()
                    out.append((key, by_word, digest, part, doc_id, mark, first, twice))
                    size += len(part)
                if size > 1 << 22:
                    yield _emit(out, target)
                    out, size = [], 0
            yield _emit(out, target)

    return pin(joined.mapInArrow(cut, ddl), "suffix-surroundings", "zstd")


SPANS = "key long, digest binary, firsts array<int>, lasts array<int>"


def repeated_names(names: list[bytes]) -> list[np.ndarray]:
    """For each row of names, whether each stands at another place too."""
    _, which, times = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in names]),
                                return_inverse=True, return_counts=True)
    return np.split(times[which] > 1, np.cumsum([len(x) // 8 for x in names])[:-1])


def _in_shards(texts: DataFrame, length: int) -> DataFrame:
    """Repeated starts of (key, by_word, digest, text) whose keys fit in one shard each."""
    target = _arrow(SPANS)

    def solve(held, by_word):
        texts = [x[2] for x in held]
        flags = repeated_names(texts) if by_word else repeated_starts(texts, length)
        return _emit([(k, d, *stretches(f)) for (k, d, *_), f in zip(held, flags) if f.any()], target)

    def arrays(batches):
        held, size = {False: [], True: []}, {False: 0, True: 0}
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in (
            "key", "digest", "text", "by_word"))))
        for (_, w), own in groupby(rows, key=lambda r: (r[0], r[3])):
            own = list(own)
            held[w] += own
            size[w] += sum(len(r[2]) for r in own)
            if size[w] > SHARD_BYTES:
                yield solve(held[w], w)
                held[w], size[w] = [], 0
        for w, own in held.items():
            if own:
                yield solve(own, w)

    return (texts.select("key", "by_word", "digest", "text").repartition("key")
            .sortWithinPartitions("key", "by_word").mapInArrow(arrays, SPANS))


def _across_shards(texts: DataFrame, length: int) -> DataFrame:
    """The same for keys of many surroundings, dealt out over shards by their digest.

    Every start is named by the 128-bit hash of its string, that of a passage by its hash and its key.
    Names that occur twice are found by a hash aggregation and joined back to the starts; nothing is
    sorted into a suffix array or searched here.
    """
    named = "key long, digest binary, a long, b long, start int"
    target, spans = _arrow(named), _arrow(SPANS)

    def rows(out):
        sizes = [len(both) for _, _, both in out]
        row = np.repeat(np.arange(len(out)), sizes)
        both = np.concatenate([b for _, _, b in out])
        start = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _, _ in out], pa.int64()).take(pa.array(row)),
             pa.array([d for _, d, _ in out], pa.binary()).take(pa.array(row)),
             pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(start)], schema=target)

    def names(batches):
        h = Hasher()
        for batch in batches:
            out, size = [], 0
            for k, w, d, text in zip(*(batch.column(c).to_pylist() for c in (
                    "key", "by_word", "digest", "text"))):
                if w:
                    own = np.frombuffer(text, np.int64)
                    both = np.stack([own, np.full(len(own), k)], 1)
                else:
                    both = string_names(h, text, length)
                out.append((k, d, both))
                size += len(both)
                if size > 1 << 16:
                    yield rows(out)
                    out, size = [], 0
            if out:
                yield rows(out)

    starts = pin(texts.select("key", "by_word", "digest", "text").repartition("key", "digest")
                 .mapInArrow(names, named), "suffix-names", "zstd")
    again = starts.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b")
    found = (starts.join(again, ["a", "b"]).groupBy("key", "digest")
             .agg(F.sort_array(F.collect_list("start")).alias("starts")))

    def joined(batches):
        for batch in batches:
            out = []
            for k, d, at in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "starts"))):
                flags = np.zeros(max(at) + 1, bool)
                flags[at] = True
                out.append((k, d, *stretches(flags)))
            yield _emit(out, spans)

    return found.mapInArrow(joined, SPANS)


def repeated_spans(docs: DataFrame, packed: DataFrame, length: int, words: int) -> DataFrame:
    """(doc_id, mark, spans): by_word, first, a, b of what repeated strings cover.

    Of bytes, all strings that start from first + a to first + b; by_word, all passages from the a-th to
    the b-th word behind that at byte first.
    """
    runs = _runs(docs, length, words)
    told = runs.filter("by_word").withColumn("digest", F.unhex(F.lpad(F.hex("whole"), 16, "0")))
    kinds = pin(told.groupBy("key", "digest", "whole", "last").agg(
        F.min(F.struct("doc_id", "mark", "first")).alias("at"), F.max("twice").alias("twice"),
        F.count("*").alias("n")), "suffix-kinds", "zstd")
    one_each = _unsettled(kinds).select("at.*", "key", "whole", "last", "twice", F.lit(True).alias("by_word"))
    around = _surroundings(runs.filter(~F.col("by_word")).unionByName(one_each), packed, length, words)
    texts = pin(around.groupBy("key", "by_word", "digest").agg(
        F.first("text").alias("text"), F.max("twice").alias("twice"), F.count("*").alias("n")),
        "suffix-texts", "zstd")
    todo = pin(_unsettled(texts), "suffix-todo", "zstd")

    def copied(rows, last):
        return rows.filter("n > 1").select("key", "digest", F.array(F.lit(0)).alias("firsts"),
                                           F.array(last).alias("lasts"))

    spans = (copied(texts.filter(~F.col("by_word")), F.octet_length("text") - length)
             .unionByName(copied(kinds, F.col("last")))
             .unionByName(_in_shards(todo.filter(F.col("kinds") <= CROWDED), length))
             .unionByName(_across_shards(todo.filter(F.col("kinds") > CROWDED), length)))
    where = ["key", "digest", "doc_id", "mark", "first", "by_word"]
    placed = (around.filter(~F.col("by_word")).select(where).unionByName(told.select(where))
              .join(spans, ["key", "digest"])
              .select("doc_id", "mark", "by_word", "first",
                      F.explode(F.arrays_zip("firsts", "lasts")).alias("x")))
    return placed.groupBy("doc_id", "mark").agg(F.collect_set(F.struct(
        "by_word", "first", F.col("x.firsts").alias("a"), F.col("x.lasts").alias("b"))).alias("spans"))


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal spans, in order."""
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def dedup_bytes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id",
                text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, removed_spans, n_passage_bytes, passage_spans), one
    row per input row.

    kept: the bytes that stay; removed_spans: start:end of what goes, in bytes, comma-joined;
    passage_spans: likewise what repeated passages cover, n_passage_bytes bytes, whether it goes or not.

    A passage is ``words`` words `[^\\x20\\x09-\\x0D]+` and what is between them; it is repeated if the
    same bytes stand as a passage anywhere else too, in another row or the same.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in another
    row or the same; rows that repeat id and text are other rows. A null text counts as empty and
    has no string, nor has one shorter than ``length``; null ids are kept; an empty table gives no
    rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = narrow(docs, id_col, text_col).select("doc_id", text.alias("text"), F.xxhash64(text).alias("mark"))

    def packer():
        box = zstandard.ZstdCompressor(level=1)
        return lambda t: (box.compress(t.encode()),)

    packed = compute(rows, "text", "packed binary", packer)
    spans = repeated_spans(rows, packed, length, words).select(
        F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "spans")
    joined = packed.join(spans, packed["doc_id"].eqNullSafe(F.col("_id"))
                         & (packed["mark"] == F.col("_mark")), "left")

    def cutter():
        box = zstandard.ZstdDecompressor()

        def cut(x):
            raw = box.decompress(x["packed"])
            spans = list(zip(x["by_word"] or [], x["first"] or [], x["a"] or [], x["b"] or []))
            gone = _merged([(f + a, f + b + length) for w, f, a, b in spans if not w])
            told = [(f, a, b + words) for w, f, a, b in spans if w]
            if told:
                starts, ends = word_bounds(np.frombuffer(raw, np.uint8))
                at = np.searchsorted(starts, [f for f, _, _ in told]).tolist()
                told = [(int(starts[s]), int(ends[e - 1]))
                        for s, e in _merged([(i + a, i + b) for i, (_, a, b) in zip(at, told)])]
            edges = [0, *(p for span in gone for p in span), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            return (len(raw), len(raw) - len(kept), len(gone), kept,
                    ",".join(f"{s}:{e}" for s, e in gone), sum(e - s for s, e in told),
                    ",".join(f"{s}:{e}" for s, e in told))
        return cut

    return compute(joined.select("doc_id", F.struct("packed", *(
        F.col(f"spans.{c}").alias(c) for c in ("by_word", "first", "a", "b"))).alias("x")), "x",
                   "n_bytes long, n_removed long, n_spans long, kept binary, removed_spans string, "
                   "n_passage_bytes long, passage_spans string", cutter)


def dedup_digests(docs: DataFrame) -> DataFrame:
    """The same with a digest of the bytes that stay, and these as text.

    A character of which only a part stays shows as the replacement character in ``text``.
    """
    return dedup_bytes(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        "removed_spans", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
        "n_passage_bytes", "passage_spans")
