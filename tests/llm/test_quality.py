import math
import re
from collections import Counter

from pyspark.sql import functions as F

from panelgrid.llm import quality as Q


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    n, r = len(words), len(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n)


def key(r):
    return (str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
            r.base_failed)


def test_base_counts(spark, awkward, table, sf_docs):
    odd = table(["a b c d e f g h " * 4, "x\n\nx\n x\ny\r\n" * 3, "one two three four five six seven eight nine "
                 "z one two three four five six seven eight nine", "a " * 50, "\x1c\x85\xa0 #|<"])
    docs = sf_docs.unionByName(awkward).unionByName(odd)
    got = sorted(map(key, Q.quality_rules(docs, None).collect()))
    assert got == sorted((str(r.doc_id), *base(r.text)) for r in docs.collect())


def test_scores(spark, table):
    docs = table(["good clean words here", "good clean words there", "bad bad bad junk", None])
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in Q.quality_rules(docs, labels, buckets=1 << 20).collect()}
    grams = [t.split() + list(zip(t.split(), t.split()[1:])) for t in
             ("good clean words here", "good clean words there", "bad bad bad junk")]
    raw, good = Counter(sum(grams, [])), Counter(grams[0] + grams[1])
    b, n, m = 1 << 20, raw.total(), good.total()
    for i, g in enumerate(grams):
        want = sum(math.log((good[x] + 1) / (m + b)) - math.log((raw[x] + 1) / (n + b)) for x in g)
        assert math.isclose(rows[i].score, want / len(g), abs_tol=1e-9)
    assert rows[3].score == 0 and not rows[3].kept


def test_clean_rows_stay(spark, sf_docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = Q.quality_rules(sf_docs, labels).join(labels, "doc_id").collect()
    assert all(r.kept or r.base_failed for r in got if r.quality == 1)
    assert sum(not r.kept for r in got if r.quality == 0) >= 0.5 * sum(r.quality == 0 for r in got)


def test_no_python_and_empty(spark, table, sf_docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    df = Q.quality_rules(sf_docs.withColumn("words", F.lit(1)).withColumn("good", F.lit(2)), labels)
    assert "Python" not in df._jdf.queryExecution().toString()
    assert Q.quality_rules(table([]), labels).count() == 0
    assert Q.quality_rules(sf_docs, labels.limit(0)).count() == sf_docs.count()
