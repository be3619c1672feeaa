import os
import random

import pyarrow as pa
from pyspark.sql import functions as F

from panelgrid.llm import substring_dedup as D
from panelgrid.llm.hashing import Hasher


def every_run(found):
    """Shortest runs from and up to each sentence, by trying all."""
    n, out = len(found), set()
    ok = lambda i, j: j - i >= D.MIN_SENTENCES and sum(x[2] for x in found[i:j]) >= D.MIN_WORDS
    for i in range(n):
        out |= {(i, j) for j in range(i, n + 1) if ok(i, j) and not ok(i, j - 1)}
        out |= {(k, i + 1) for k in range(i + 1) if ok(k, i + 1) and not ok(k + 1, i + 1)}
    return out


def brute(rows):
    """(id, text) -> spans to remove."""
    first, places = {}, []
    for doc_id, text in sorted({(r.doc_id, r.text) for r in rows if r.text},
                               key=lambda x: (x[0] is not None, x[0] or 0)):
        found = D.sentences(text)
        for i, j in sorted(every_run(found)):
            words = tuple(text[x[0]:x[1]].split().__str__() for x in found[i:j])
            places.append((words, doc_id, text, found[i][0], found[j - 1][1]))
    for p in places:
        first.setdefault(p[0], p)
    out = {}
    for p in places:
        if p != first[p[0]]:
            out.setdefault((p[1], p[2]), []).append(p[3:])
    return {k: ",".join(f"{s}:{e}" for s, e in D.merged(v)) for k, v in out.items()}


def check(df):
    rows = df.collect()
    want = brute(rows)
    got = D.dedup_substrings(df.withColumn("original", F.col("text"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.removed_spans == want.get((r.doc_id, r.original), "")
        if not r.removed_spans:
            assert r.text == r.original
    return got


def test_against_brute_force(sf_docs):
    got = check(sf_docs)
    assert any(r.removed_spans for r in got) and not all(r.removed_spans for r in got)


PASSAGE = " ".join(f"w{i}" for i in range(27)) + ". " + " ".join(f"v{i}" for i in range(28)) + "."


def test_planted_passages(table):
    docs = table([f"Own words of {x} here. {PASSAGE} And {x} ends." for x in "abc"]
                 + [f"{PASSAGE}\n{PASSAGE}", "Nothing is the same. Not here. " * 1])
    got = {r.doc_id: r for r in check(docs)}
    assert PASSAGE in got[0].text and got[4].text == got[4].original
    for i, x in ((1, "b"), (2, "c")):
        assert got[i].text.split() == f"Own words of {x} here. And {x} ends.".split()
    assert got[3].text == ""


def test_passage_inside_longer_sentences(table):
    """A passage without any full stop is found, whatever stands before it in its sentence."""
    passage = " ".join(f"p{i}" for i in range(90))
    docs = table([f"{'x ' * i}{x} starts {passage} ends {x}{i}" for i, x in enumerate("abcdef")])
    got = {r.doc_id: r for r in check(docs)}
    assert passage in got[0].text
    for i in range(1, 6):
        left = set(passage.split()) & set(got[i].text.split())
        assert len(left) < 50 and "starts" in got[i].text


def test_no_passage_of_50_words_is_missed():
    """Whatever its punctuation, and whatever stands around it in its first and last sentence."""
    rng, h = random.Random(3), Hasher()
    around = lambda n: " ".join(str(rng.random()) for _ in range(n))
    for variety in (1, 2, 7, 5000):
        for stop in (0, 0.03, 0.07, 0.12):
            for _ in range(500 if variety == 5000 else 30):
                passage = " ".join(f"w{rng.randrange(variety)}" + "." * (rng.random() < stop)
                                   for _ in range(rng.choice((50, 51, 55))))
                one, two = (set(D.runs(f"{around(rng.randrange(25))} {passage} "
                                       f"{around(rng.randrange(25))}", h)[0].tolist())
                            for _ in range(2))
                assert one & two


def test_few_words_are_cut_by_content(table):
    """The place of a stretch of one word, or of a few in turn, does not matter."""
    for turn in ("a", "a b", "a b c", "a a b"):
        docs = table([f"{around} {f'{turn} ' * 40}{around}" for around in ("k l", "m n o", "p q r s t")])
        got = {r.doc_id: r for r in check(docs)}
        assert all(len(got[i].text.split()) < 40 for i in (1, 2))


def test_sentences_cover_the_words():
    """Spans are in code points, whatever the width of characters and spaces between words."""
    long = " ".join(f"q{i}" for i in range(200))
    for text in ("", " \n\t", "a", " one. two\n\nthree  four! five\u3000six\u00a0seven",
                 "\n\n\u00e9\U0001f600 y? \U0001f600. z", f"x. {long}\n{long}", "x " * 300):
        found = D.sentences(text)
        assert [w for s, e, _, _ in found for w in text[s:e].split()] == text.split()
        assert all(n == len(text[s:e].split()) <= D.MAX_PART for s, e, n, _ in found)
        assert all("\n" not in text[s:e] for s, e, _, _ in found)
    halves = [D.sentences(x) for x in (long, f"x. {long}")]
    assert [x[2:] for x in halves[0]] == [x[2:] for x in halves[1][1:]]


def test_awkward(awkward, table):
    check(awkward)
    check(awkward.unionByName(awkward))
    assert D.dedup_substrings(table([])).count() == 0
    odd = awkward.withColumn("hash", F.lit(1)).withColumn("start", F.lit(2)).withColumn("mark", F.lit(3))
    assert D.dedup_substrings(odd).columns == [*odd.columns, "removed_spans"]


def test_clashing_columns(awkward):
    want = sorted(map(str, D.dedup_substrings(awkward).collect()))
    names = ["_id", "_mark", "_cut", "_runs", "removed_spans", "row", "cut", "runs", "spans", "id", "same", "col1"]
    odd = D.dedup_substrings(awkward.withColumns({c: F.lit(7) for c in names}))
    assert odd.columns == [*awkward.columns, *[c for c in names if c != "removed_spans"], "removed_spans"]
    assert all(r[c] == 7 for r in odd.collect() for c in names if c != "removed_spans")
    assert sorted(map(str, odd.select(*awkward.columns, "removed_spans").collect())) == want


def test_hashes_of_runs_are_stored_once(spark, sf_docs):
    """One shuffle holds them, and no table of them is written beside it."""
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    there = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    done = D.dedup_substrings(sf_docs)
    assert done._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(hash") == 1
    done.count()
    assert (set(os.listdir(shared)) if os.path.isdir(shared) else set()) == there


def test_a_run_that_all_documents_share_meets_once_a_batch():
    texts = [f"Own words of {i} here. {PASSAGE}" for i in range(40)] + [None]
    ids, marks = [*range(40, 0, -1), None], [i % 7 for i in range(41)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()),
                                        pa.array(marks, pa.int64())], ["doc_id", "text", "mark"])
    found = D.different_runs(batch, Hasher(), True).to_pylist()
    shared = set(D.runs(PASSAGE, Hasher())[0].tolist())
    meet = [r for r in found if r["apart"] is None and r["hash"] in shared]
    assert len(meet) == len(shared) and {r["doc_id"] for r in meet} == {1}
    assert sum(r["hash"] in shared for r in found) == 40 * len(shared)
    assert all(r["apart"] in (None, r["mark"]) for r in found)
    plain = D.different_runs(batch, Hasher(), False).to_pylist()
    assert plain == [r | {"apart": None} for r in found]


def test_ids_of_any_kind_in_any_batches(table):
    """The first place does not depend on how rows are dealt, nor on the type of the ids."""
    texts = [f"Own words of {i} here. {PASSAGE} And {PASSAGE if i % 3 else i} ends." for i in range(24)]
    docs = table([(i if i != 13 else None, t) for i, t in enumerate(texts)] * 2)  # null goes first
    for kind in ("long", "string", "decimal(20,2)", "date"):
        ids = F.expr("date_add(date'2020-01-01', int(doc_id))") if kind == "date" else F.col("doc_id").cast(kind)
        typed = docs.withColumn("doc_id", ids)
        for n in (1, 5):
            got = check(typed.orderBy(F.rand(n)).repartition(n))
            firsts = {r.original for r in got if PASSAGE in r.text}
            assert len(firsts) == 1
