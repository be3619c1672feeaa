import random
import re

from pyspark.sql import functions as F

from panelgrid.llm import graph
from panelgrid.llm import jaccard_join as J


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """(doc_id, class_id, n_links, class_size) by comparing all pairs."""
    sets = [shingle_set(r.text) for r in rows]
    n, links, label = len(rows), [0] * len(rows), list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b == frozenset() or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                links[i] += 1
                links[j] += 1
                label[root(i)] = root(j)
    groups = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(i)
    for own in groups.values():
        ids = [rows[i].doc_id for i in own if rows[i].doc_id is not None]
        for i in own:
            yield rows[i].doc_id, min(ids) if ids else None, links[i], len(own)


def check(df):
    want = sorted(map(str, brute(df.collect())))
    got = sorted(str((r.doc_id, r.class_id, r.n_links, r.class_size)) for r in J.near_groups(df).collect())
    assert got == want


def near_copies(seed, groups, members, words=60):
    rnd, out = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{rnd.randrange(400)}" for _ in range(words + 20 * g)]
        for _ in range(members):
            copy = list(base)
            for _ in range(rnd.randrange(4)):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(9)}"
            out.append(" ".join(copy))
    return out


def test_against_brute_force(sf_docs):
    check(sf_docs)


def test_near_copies(table):
    check(table(near_copies(1, 5, 12)))


def test_blocks(table, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_BYTES", 3000)  # several blocks to a group
    check(table(near_copies(2, 3, 30) + ["alone here with five words"]))


def test_awkward(awkward, table):
    check(awkward)
    check(table([None]))
    assert J.near_groups(table([])).count() == 0
    odd = awkward.withColumn("words", F.lit(1)).withColumn("key", F.lit(2)).withColumn("id", F.lit(3))
    assert J.near_groups(odd).count() == awkward.count()


def test_both_ways_to_verify(monkeypatch):
    import numpy as np
    monkeypatch.setattr(J, "COLUMNS", 7)
    rnd = np.random.default_rng(0)
    sets = [np.unique(rnd.integers(0, 120, 100).astype(np.uint64)) for _ in range(40)]
    i, j = (x.ravel() for x in np.meshgrid(range(40), range(40), indexing="ij"))
    want = [len(np.intersect1d(sets[a], sets[b])) >= 0.5 * len(np.union1d(sets[a], sets[b]))
            for a, b in zip(i, j)]
    assert J.verified(i, j, sets, sets, 0.5).tolist() == want
    assert J.verified(i[:3], j[:3], sets, sets, 0.5).tolist() == want[:3]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 40), (50, 40), (7, 7)]
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 40: 30, 50: 30}
