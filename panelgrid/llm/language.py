"""Language identification by prediction by partial matching.

For each language, byte contexts of up to ORDER bytes are counted on a bounded sample of labelled
documents. A byte that a context has seen costs -log2(c / (n + d)) bits, n being the context's
count and d its number of distinct next bytes; otherwise the escape costs -log2(d / (n + d)) and the
next shorter context decides, down to a uniform byte. The statistics are frozen, so the code length
of a text is a sum over its (ORDER + 1)-grams, and the language of the shortest code wins.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.common import compute, narrow

ORDER = 3
START = b"\n" * ORDER  # what every text is taken to follow
LETTER = re.compile(r"[^\W\d_]")


def grams(raw: bytes, n: int) -> np.ndarray:
    """All n-grams that end in ``raw``, as big-endian numbers."""
    padded = np.frombuffer(START + raw, np.uint8).astype(np.uint32)
    out = padded[ORDER - n + 1:len(padded) - n + 1].copy()
    for i in range(1, n):
        out = (out << 8) | padded[ORDER - n + 1 + i:len(padded) - n + 1 + i]
    return out


class Model:
    """Code lengths in bits of every counted gram and escape, per language.

    counts: (lang, gram) -> times seen, grams being of ORDER + 1 bytes.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, times: np.ndarray):
        self.langs = langs
        k = len(langs)
        self.keys, self.bits, self.contexts, self.escapes = [], [], [], []
        for n in range(1, ORDER + 2):
            last = gram & np.uint32((1 << 8 * n) - 1) if n < 4 else gram
            keys, at = np.unique(last, return_inverse=True)
            seen = np.zeros((len(keys), k))
            np.add.at(seen, (at, lang), times)
            contexts, up = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
            np.add.at(total, up, seen)
            np.add.at(kinds, up, seen > 0)
            whole = np.maximum(total + kinds, 1)
            escape = np.where(kinds > 0, -np.log2(np.maximum(kinds, 1) / whole), 0.0)
            below = self.cost(keys & np.uint32((1 << 8 * (n - 1)) - 1), n - 1)
            own = -np.log2(np.maximum(seen, 1) / whole[up])
            self.bits.append(np.where(seen > 0, own, escape[up] + below))
            self.keys.append(keys)
            self.contexts.append(contexts)
            self.escapes.append(escape)

    def cost(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Bits of the last byte of n-grams, by language."""
        if n == 0:
            return np.full((len(keys), len(self.langs)), 8.0)
        known, bits = self.keys[n - 1], self.bits[n - 1]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        out, miss = bits[at], known[at] != keys
        if miss.any():
            rest, contexts = keys[miss], self.contexts[n - 1]
            up = np.minimum(np.searchsorted(contexts, rest >> 8), len(contexts) - 1)
            escape = np.where((contexts[up] == rest >> 8)[:, None], self.escapes[n - 1][up], 0.0)
            out[miss] = escape + self.cost(rest & np.uint32((1 << 8 * (n - 1)) - 1), n - 1)
        return out

    def lengths(self, raw: bytes) -> np.ndarray:
        """Code length of a text in bits, by language."""
        found, times = np.unique(grams(raw, ORDER + 1), return_counts=True)
        return times @ self.cost(found, ORDER + 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, its share of 2**-(bits per byte) over all languages); ``und`` without a letter."""
        if not self.langs or not text or not LETTER.search(text):
            return "und", 0.0
        raw = text.encode()
        lengths = self.lengths(raw)
        best = int(lengths.argmin())  # of equal lengths the first in order of the names
        share = 1 / np.exp2((lengths[best] - lengths) / len(raw)).sum()
        return self.langs[best], float(share)


def predictor(tables: dict):
    """``predict`` of the model whose attributes are given; built in the tasks from plain arrays."""
    model = Model.__new__(Model)
    model.__dict__.update(tables)
    return model.predict


def training_rows(docs: DataFrame, lang: str, sample_chars: int) -> DataFrame:
    """(lang, text) of about ``sample_chars`` per language: whole texts, chosen by hashed id and text.

    The text of the least hash is always among them, so no language of few long texts is lost.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()
                           & (F.length("text") > 0))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    sizes = labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"),
                                         F.min(draw).alias("least"))
    share = [(r.lang, min(1.0, sample_chars / r.chars), r.least) for r in sizes.collect()]
    taken = F.lit(False)
    for name, s, least in share:
        taken = F.when(F.col("lang") == name, (draw < s) | (draw <= least)).otherwise(taken)
    return labelled.filter(taken).select("lang", "text")


def fit(rows: DataFrame) -> Model:
    """Counts grams of (lang, text) rows in Spark; the sum, of bounded size, becomes the model."""
    def counted(batches):
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                found, times = np.unique(np.concatenate([grams(t.encode(), ORDER + 1)
                                                         for t in texts]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": found.astype(np.int64), "times": times})

    sums = (rows.mapInPandas(counted, "lang string, gram long, times long")
            .groupBy("lang", "gram").agg(F.sum("times").alias("times")).toPandas())
    langs = sorted(sums["lang"].unique())
    at = {x: i for i, x in enumerate(langs)}
    return Model(langs, sums["lang"].map(at).to_numpy(np.int64), sums["gram"].to_numpy(np.uint32),
                 sums["times"].to_numpy(float))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, sample_chars: int = 1 << 21, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per input row; nothing but text is predicted from.

    Trained on whole texts of rows that are not held out, about ``sample_chars`` characters per
    language; languages are taken to be few. A text that is null or has no letter gets ``und`` and
    score 0, so does every text if nothing is labelled; a null id is never held out; repeated rows
    give a row each; an empty table gives none.
    """
    rows = narrow(docs, id_col, text_col)
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                           F.col(lang_col).alias("lang")).filter(~held_out())
    # names and arrays only: an executor need not be able to import this module
    tables = docs.sparkSession.sparkContext.broadcast(
        vars(fit(training_rows(labelled, "lang", sample_chars))))
    return compute(rows.withColumn("held_out", held_out()), "text",
                   "lang_pred string, score double", lambda: predictor(tables.value))
