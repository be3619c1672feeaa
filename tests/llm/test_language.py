import pickle
import math
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from panelgrid.llm import language as L


def direct(train, raw):
    """Bits of ``raw`` after counting every context of ``train``, walked byte by byte."""
    seen = [Counter() for _ in range(L.ORDER + 1)]
    for t in train:
        p = L.START + t
        for i in range(L.ORDER, len(p)):
            for k in range(L.ORDER + 1):
                seen[k][p[i - k:i], p[i]] += 1
    bits, p = 0.0, L.START + raw
    for i in range(L.ORDER, len(p)):
        for k in range(L.ORDER, -1, -1):
            own = [c for (x, _), c in seen[k].items() if x == p[i - k:i]]
            if not own:
                continue
            n, d = sum(own), len(own)
            c = seen[k][p[i - k:i], p[i]]
            if c:
                bits -= math.log2(c / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8
    return bits


def test_code_lengths(spark):
    train = {"a": ["abracadabra", "banana band"], "b": ["zebra zig zag", "ébène"]}
    rows = spark.createDataFrame([(x, t) for x, ts in train.items() for t in ts], "lang string, text string")
    model = L.fit(rows)
    for text in ("abra zebra", "q", "éé banana", "zzz\n\n"):
        got = model.lengths(text.encode())
        want = [direct([t.encode() for t in train[x]], text.encode()) for x in model.langs]
        assert np.allclose(got, want)


def test_accuracy(sf_docs):
    rows = L.identify(sf_docs).join(sf_docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward(awkward):
    rows = L.identify(awkward).collect()
    assert len(rows) == 16
    assert sum(r.lang_pred == "und" for r in rows) == 5
    none = L.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert L.identify(awkward.limit(0)).count() == 0


def test_no_language_is_lost(spark):
    """Few texts, each longer than the sample, still give one per language."""
    docs = spark.createDataFrame([(i, f"{x}{i} " * 500, x) for x in "abcdefgh" for i in range(3)],
                                 "doc_id long, text string, lang string")
    rows = L.training_rows(docs, "lang", 100).collect()
    assert {r.lang for r in rows} == set("abcdefgh")


def test_executors_need_only_libraries(spark, table):
    """What is broadcast holds no class of this repository."""
    model = L.fit(spark.createDataFrame([("a", "abc abc"), ("b", "xyz")], "lang string, text string"))
    raw = pickle.dumps(vars(model))
    assert b"panelgrid" not in raw
    lang, score = L.predictor(pickle.loads(raw))("abc")
    assert lang == "a" and 0.5 < score < 1
