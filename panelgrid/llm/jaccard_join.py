"""Join of near-equal documents: Jaccard of word n-grams, candidates pruned by their MinHashes.

Documents of equal words are one text. MinHash bands of the texts give coarse groups; inside a
group, texts are compared value by value, and a pair is dropped as soon as the chance that it
reaches the threshold, given the matches so far, falls below a tolerance. The rest is verified
exactly. Groups too large for one task are cut into blocks, and every pair of blocks is a task.
Tasks return links summed per text and a forest of links, never the pairs.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.common import compute, narrow, pin
from panelgrid.llm.graph import components
from panelgrid.llm.hashing import BASE, Hasher, mixed

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6  # a pair at the threshold shares no band with a chance of 6e-5
HASHES = BANDS * ROWS
STEP = 32  # MinHashes compared between two decisions
TOLERANCE = 1e-6
BLOCK_BYTES = 4 << 20  # text of a block
COLUMNS = 4096  # shingles counted at once
_rng = np.random.default_rng(5)
FACTORS = (_rng.integers(0, 1 << 32, HASHES, np.uint64) | np.uint64(1)).astype(np.uint32)
ADDENDS = _rng.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)


def normal(text: Column) -> Column:
    """Words in lower case, one space between; null has none."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.lower(F.trim(spaced))


def shingles(h: Hasher, words: str, n: int = WORDS) -> np.ndarray:
    """Distinct hashes of all runs of n words; fewer words are one run."""
    raw = np.frombuffer(words.encode(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(raw == 32)
    start = np.concatenate([[0], gaps + 1])
    end = np.concatenate([gaps, [len(raw)]])
    if len(start) < n:
        start, end = start[:1], end[-1:]
    else:
        start, end = start[:len(start) - n + 1], end[n - 1:]
    return np.unique(h.stretches(raw, start, end))


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHashes of a set of hashes; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for part in np.array_split((shingles >> np.uint64(32)).astype(np.uint32), 1 + len(shingles) // 2048):
        np.minimum(out, (part[None, :] * FACTORS[:, None] + ADDENDS[:, None]).min(1), out=out)
    return out


def bands(sig: np.ndarray) -> list[int]:
    if not len(sig):
        return []
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    value = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        value = mixed(value * np.uint64(BASE) + rows[:, i])
    return value.view(np.int64).tolist()


def least_matches(seen: int, threshold: float, tolerance: float) -> int:
    """Matches among ``seen`` values below which the threshold is out of reach.

    With a uniform prior the similarity has a Beta posterior, whose tail above the threshold is a
    binomial sum.
    """
    tail = 0.0
    for m in range(seen + 1):
        tail += comb(seen + 1, m) * threshold ** m * (1 - threshold) ** (seen + 1 - m)
        if tail >= tolerance:
            return m
    return seen


def candidate_pairs(left: np.ndarray, right: np.ndarray | None, threshold: float,
                    tolerance: float):
    """Index pairs that survive the comparison; ``right`` None: pairs inside ``left``."""
    other = left if right is None else right
    need = [least_matches(k, threshold, tolerance) for k in range(STEP, HASHES + 1, STEP)]
    rows = max(1, (1 << 25) // (STEP * len(other)))
    for lo in range(0, len(left), rows):
        part = left[lo:lo + rows]
        same = (part[:, None, :STEP] == other[None, :, :STEP]).sum(2, dtype=np.int16)
        i, j = np.nonzero(same >= need[0])
        n = same[i, j].astype(np.int32)
        i += lo
        if right is None:
            keep = i < j
            i, j, n = i[keep], j[keep], n[keep]
        for k in range(1, len(need)):
            kept = []
            for at in range(0, len(i), 1 << 18):
                s = slice(at, at + (1 << 18))
                cut = slice(k * STEP, (k + 1) * STEP)
                n[s] += (left[i[s], cut] == other[j[s], cut]).sum(1, dtype=np.int32)
                kept.append(n[s] >= need[k])
            keep = np.concatenate(kept) if kept else np.zeros(0, bool)
            i, j, n = i[keep], j[keep], n[keep]
        yield i, j


def verified(i, j, left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether each pair's exact Jaccard reaches the threshold."""
    if not len(i):
        return np.zeros(0, bool)
    own, col = np.unique(i), np.unique(j)
    sizes_l, sizes_r = (np.array([len(x[k]) for k in range(len(x))]) for x in (left, right))
    every = np.concatenate([left[a] for a in own] + [right[b] for b in col])
    vocabulary = np.unique(every)
    dense = 2.0 * len(own) * len(col) * len(vocabulary) / 1e10
    sparse = len(i) * 2e-5 + (sizes_l[i].sum() + sizes_r[j].sum()) * 2e-8
    common = np.empty(len(i))
    if dense < sparse:  # count common shingles of all at once, some columns at a time
        at_l, at_r = np.searchsorted(own, i), np.searchsorted(col, j)
        total = np.zeros((len(own), len(col)), np.float32)
        for lo in range(0, len(vocabulary), COLUMNS):
            words = vocabulary[lo:lo + COLUMNS]
            sides = []
            for ids, sets in ((own, left), (col, right)):
                m = np.zeros((len(ids), len(words)), np.float32)
                for row, k in enumerate(ids):
                    a = np.searchsorted(sets[k], words[0])
                    b = np.searchsorted(sets[k], words[-1], "right")
                    m[row, np.searchsorted(words, sets[k][a:b])] = 1
                sides.append(m)
            total += sides[0] @ sides[1].T
        common = total[at_l, at_r].astype(float)
    else:
        for k, (a, b) in enumerate(zip(i, j)):
            x, y = left[a], right[b]
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            common[k] = (y[at] == x).sum()
    return common >= threshold * (sizes_l[i] + sizes_r[j] - common) - 1e-9


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index that links lead to, for each of n."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def compare_cell(batch: pd.DataFrame, threshold: float = THRESHOLD,
                 tolerance: float = TOLERANCE) -> pd.DataFrame:
    """Links of one pair of blocks: (id, n_links, root), a row per text; links count copies."""
    h = Hasher()
    cell = batch.sort_values("id", ignore_index=True)
    sets = [shingles(h, t) for t in cell["words"]]
    sigs = np.array([signature(s) for s in sets])
    copies = cell["copies"].to_numpy()
    block = cell["block"].to_numpy()
    sides = [np.flatnonzero(block == b) for b in np.unique(block)]
    links = np.zeros(len(cell), np.int64)
    at, to = [], []
    inside = bool((cell["first_block"] == cell["last_block"]).all())
    if inside or len(sides) == 2:
        left, right = sides[0], None if inside else sides[1]
        other = left if right is None else right
        own_sets, other_sets = [sets[k] for k in left], [sets[k] for k in other]
        for i, j in candidate_pairs(sigs[left], None if inside else sigs[right], threshold, tolerance):
            ok = verified(i, j, own_sets, other_sets, threshold)
            i, j = left[i[ok]], other[j[ok]]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            label = roots(len(cell), i, j)  # a forest of these links is enough
            moved = np.flatnonzero(label != np.arange(len(cell)))
            at.append(moved)
            to.append(label[moved])
    label = roots(len(cell), np.concatenate(at), np.concatenate(to)) if at else np.arange(len(cell))
    ids = cell["id"].to_numpy()
    return pd.DataFrame({"id": ids, "n_links": links, "root": ids[label]})


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, class_size), one row per input row.

    Two documents are linked if the Jaccard similarity of their five-word runs (lower case) reaches
    the threshold; fewer than five words are one run. class_id is the least doc_id that links lead
    to; n_links counts the linked documents, copies included. Null and empty texts count as copies
    of each other and link to nothing else; a class without any id has class_id null; repeated rows
    are copies; an empty table gives no rows.
    """
    rows = _rows(docs, id_col, text_col)
    whole = _classes(rows, threshold, tolerance)
    classes = whole.groupBy("root").agg(F.min("doc_id").alias("class_id"),
                                        F.sum("copies").alias("class_size"))
    told = whole.join(classes, "root").select(
        "key", "class_id", "class_size",
        (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return (rows.select("doc_id", F.md5("words").alias("key")).join(told, "key")
            .select("doc_id", "class_id", "n_links", "class_size"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of ``near_groups``, that of the least id, with all its columns.

    Null ids are last; of rows that repeat id and words any one stays.
    """
    whole = _classes(_rows(docs, id_col, text_col), threshold, tolerance)
    kept = whole.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id",
                                                    "key")).alias("x"))
    name = lambda i, k: F.concat(F.coalesce(i.cast("string"), F.lit("null")), F.lit(":"), k)
    named = docs.select(F.struct("*").alias("row"),
                        name(F.col(id_col), F.md5(normal(F.col(text_col)))).alias("name"))
    return (named.join(kept.select(name(F.col("x.doc_id"), F.col("x.key")).alias("name")), "name")
            .dropDuplicates(["name"]).select("row.*"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return narrow(docs, id_col, text_col).withColumn("words", normal(F.col("text")))


def _classes(rows: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(id, key, doc_id, copies, n_links, root) of every different text."""
    texts = compute(rows.select("doc_id", F.md5("words").alias("key"), "words"), "words",
                    "bands array<long>", _banding)
    texts = pin(texts.groupBy("key").agg(F.min("doc_id").alias("doc_id"),
                                         F.first("bands").alias("bands"),
                                         F.count("*").alias("copies"))
                .withColumn("id", F.monotonically_increasing_id()), "join-texts")
    banded = texts.select("id", F.explode("bands").alias("band"))
    shared = (banded.groupBy("band").agg(F.min("id").alias("b"), F.count("*").alias("n"))
              .filter("n > 1").select("band", "b"))
    coarse = components(banded.join(shared, "band").select(F.col("id").alias("a"), "b"))
    linked = pin(_links(rows, pin(coarse, "join-coarse"), texts, threshold, tolerance), "join-links")
    fine = components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    return pin(texts.select("id", "key", "doc_id", "copies")
               .join(counts, "id", "left").join(fine, "id", "left")
               .withColumn("root", F.coalesce("root", "id")), "join-classes")


def _banding():
    h = Hasher()
    return lambda words: (bands(signature(shingles(h, words))),)


def _links(rows: DataFrame, coarse: DataFrame, texts: DataFrame, threshold: float,
           tolerance: float) -> DataFrame:
    """Compares the texts of each coarse group, in cells of two blocks."""
    own = (coarse.join(texts.select("id", F.col("doc_id").alias("_doc"), "key", "copies"), "id"))
    words = rows.select("doc_id", "words", F.md5("words").alias("_key"))
    # one row per text: that of its least id; equal ids and words repeat the same row
    full = pin(words.join(own, (F.col("_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
               .dropDuplicates(["id"]).select("id", "root", "copies", "words"), "join-words")
    size = full.groupBy("root").agg(F.sum(F.octet_length("words")).alias("bytes"))
    blocks = size.select("root", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
    placed = (full.join(blocks, "root")
              .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    cells = (placed.withColumn("first_block", F.least("block", "other"))
             .withColumn("last_block", F.greatest("block", "other"))
             .select("root", "first_block", "last_block", "block", "id", "copies", "words"))
    return (cells.groupBy("root", "first_block", "last_block")
            .applyInPandas(lambda b: compare_cell(b, threshold, tolerance),
                           "id long, n_links long, root long"))
