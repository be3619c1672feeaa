import re

import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F
from test_jaccard_join import brute as groups
from test_quality import base
from test_substring_dedup import brute as repeats

from panelgrid.llm import secret_scan as S

SF = "/root/testdata/sf0.001"


def cut(text, spans):
    at, out = 0, []
    for s in filter(None, spans.split(",")):
        a, b = map(int, s.split(":"))
        out.append(text[at:a].strip())
        at = b
    return "\n".join(x for x in [*out, text[at:].strip()] if x) if spans else text


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(("documents", docs))
    for name, f in C.STAGES:
        docs = C.pin(f(spark, docs, SF), "test")
        out.append((name, docs))
    return dict(out)


def test_columns_and_rows(spark, stages):
    names = list(stages)
    for name in names[:-1]:
        assert stages[name].columns == stages["documents"].columns
    assert stages["packing"].count() == stages["secret_scans"].count()
    key = lambda df: sorted(map(tuple, df.select("doc_id", "n_tokens", "bucket").collect()))
    assert key(C.run(spark, SF)) == key(stages["packing"])


def test_rejected_go(stages):
    kept = {r.doc_id for r in stages["quality_rules"].collect()}
    for r in stages["documents"].collect():
        if base(r.text)[-1]:
            assert r.doc_id not in kept


def test_one_of_each_group(stages):
    before = stages["quality_rules"].collect()
    want = sorted({c for _, c, _, _ in groups(before)})
    assert sorted(r.doc_id for r in stages["jaccard_join"].collect()) == want


def test_spans_and_secrets(stages):
    before = stages["jaccard_join"].collect()
    gone = repeats(before)
    texts = {r.doc_id: cut(r.text, gone.get((r.doc_id, r.text), "")) for r in before}
    assert {r.doc_id: r.text for r in stages["substring_dedup"].collect()} == texts
    for r in stages["secret_scans"].collect():
        every = S.find_secrets(texts[r.doc_id])[1]
        assert r.text == S.masked(texts[r.doc_id], every, "[SECRET]") and r.n_chars == len(r.text)
        assert not re.search(r"AKIA[A-Z0-9]{16}", r.text)


def test_awkward_rows_pass_through(spark, awkward):
    docs = awkward.withColumn("row", F.lit(1)).withColumn("name", F.lit("x"))
    for name, f in C.STAGES[1:4]:
        assert f(spark, docs, SF).columns == docs.columns
    assert C.jaccard_join(spark, docs, SF).count() == 10
    for _, f in C.STAGES:
        assert f(spark, docs.limit(0), SF).count() == 0


def test_awkward_rows_in_the_first_and_last_stage(spark, awkward):
    """Long enough texts that are null, tied, repeated or of repeated id among the others."""
    good = "the quick brown fox jumps over the lazy dog and runs far away from here to see %s more of it all day"
    docs = awkward.unionByName(spark.createDataFrame(
        [(50, good % "some", "en", "s", 1), (50, good % "some", "en", "s", 1), (None, good % "none", "en", "s", 1),
         (51, good % "much", "en", "s", 1)], awkward.schema))
    names = ["row", "at", "kept", "score", "name", "bucket", "first", "copies", "n_tokens", "batch", "slot"]
    odd = docs.withColumns({c: F.lit(1) for c in names})
    kept = C.quality_rules(spark, odd, SF)
    assert kept.columns == odd.columns
    assert not [r for r in kept.collect() if base(r.text)[-1]]
    packed = C.packing(spark, odd, SF).collect()
    assert sorted(map(str, (r.doc_id for r in packed))) == sorted(map(str, (r.doc_id for r in docs.collect())))
    places = [(r.bucket, r.batch, r.position) for r in packed]
    assert len(set(places)) == len(places)
    assert sum(r.n_tokens == 0 for r in packed) == sum(not (r.text or "").split() for r in docs.collect())
