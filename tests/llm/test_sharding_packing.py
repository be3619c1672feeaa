import itertools
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelgrid.llm import common, packing, sharding


@pytest.fixture(autouse=True)
def small_leaves(monkeypatch):
    monkeypatch.setattr(common, "LEAF", 3)  # several levels of prefix sums even on small tables


def least_capacity(sizes, shards):
    """Smallest capacity by trying every cut."""
    best = sum(sizes)
    n = len(sizes)
    for cuts in itertools.combinations_with_replacement(range(n + 1), shards - 1):
        edges = [0, *cuts, n]
        best = min(best, max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])))
    return best


def check_shards(df, shards):
    rows = df.collect()
    got = sharding.shard_by_bytes(df, shards).collect()
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted((str(r.doc_id), size(r.text), crc(r.text)) for r in rows) == \
        sorted((str(r.doc_id), r.size, r.text_crc32) for r in got)
    place = {}
    for r in got:
        assert place.setdefault((r.size, r.text_crc32), r.shard) == r.shard
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    for s in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    return got


def test_least_capacity(table):
    import hashlib
    texts = ["t" * n for n in (1, 9, 30, 2, 7, 7, 12, 40, 5, 3, 30)]
    groups = {}
    for t in texts:
        h = hashlib.sha256(t.encode()).hexdigest()
        groups[h] = groups.get(h, 0) + len(t) + 1
    ordered = [groups[h] for h in sorted(groups)]
    for shards in (1, 2, 3, 4):
        got = check_shards(table(texts), shards)
        loads = [sum(r.size for r in got if r.shard == s) for s in range(shards)]
        assert max(loads) == least_capacity(ordered, shards)


def test_shards_of_awkward_and_empty(awkward, table, sf_docs):
    check_shards(awkward, 8)
    assert sharding.shard_by_bytes(table([])).count() == 0
    loads = {}
    for r in check_shards(sf_docs, 4):
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert max(loads.values()) < 1.2 * sum(loads.values()) / 4


def test_best_bounds():
    longest, rows = [1, 2, 5, 9, 10, 14, 30], [5, 1, 7, 2, 2, 1, 1]
    for k in range(1, 5):
        got = packing.best_bounds(longest, rows, k)
        cost = lambda b: sum(r * min(x for x in b if x >= n) for n, r in zip(longest, rows))
        every = (c for m in range(1, k + 1) for c in itertools.combinations(longest, m) if c[-1] == 30)
        assert cost(got) == min(map(cost, every)) and len(got) <= k


def plain_bounds(longest, rows, buckets):
    """Padding of the best division, by trying every beginning of every bucket."""
    n = len(longest)
    count = [0, *itertools.accumulate(rows)]
    best = [0] + [longest[j] * count[j + 1] for j in range(n)]
    for _ in range(1, min(buckets, n)):
        best = [0] + [min(best[i] + longest[j] * (count[j + 1] - count[i]) for i in range(j + 1))
                      for j in range(n)]
    return best[n] - sum(a * b for a, b in zip(longest, rows))


@pytest.mark.parametrize("n,buckets", [(1, 3), (2, 2), (40, 7), (150, 16), (333, 2)])
def test_bounds_of_many_lengths(n, buckets):
    rnd = random.Random(n)
    longest = sorted(rnd.sample(range(20_000), n))
    rows = [rnd.choice([1, 1, 2, 1000]) for _ in range(n)]
    got = packing.best_bounds(longest, rows, buckets)
    padding = sum(r * (min(b for b in got if b >= x) - x) for x, r in zip(longest, rows))
    assert padding == plain_bounds(longest, rows, buckets) and len(got) <= buckets


def test_padding_is_the_least(table):
    """Of a whole table, with lengths far above five hundred tokens, and with a count of one's own."""
    rnd = random.Random(5)
    sizes = [int(600 * rnd.random() ** 3 * 5) for _ in range(120)]
    docs = table(["w " * n for n in sizes]).withColumn("own", F.length("text"))
    for tokens, each in ((None, 1), (F.col("own"), 2)):
        got = packing.pack(docs, 5, tokens=tokens).collect()
        count = sorted(Counter(each * n for n in sizes).items())
        assert sum(r.padding for r in got) == plain_bounds([x for x, _ in count], [c for _, c in count], 5)


def test_pack(awkward, sf_docs, table):
    for df, budget in ((awkward, 64), (sf_docs, 2048)):
        got = packing.pack(df, 4, budget).collect()
        assert len(got) == df.count()
        batches = {}
        for r in got:
            batches.setdefault((r.bucket, r.batch), []).append(r)
            assert r.padding == r.bucket_length - r.n_tokens >= 0
        for rows in batches.values():
            assert sorted(r.position for r in rows) == list(range(len(rows)))
            assert len(rows) * rows[0].bucket_length <= budget or len(rows) == 1
        words = {r.doc_id: len((r.text or "").split(" ")) for r in table(["a b", "c"]).collect()}
        assert words == {0: 2, 1: 1}
    assert packing.pack(table([])).count() == 0


def test_clashing_columns(sf_docs):
    from pyspark.sql import functions as F
    odd = sf_docs.withColumns({c: F.lit(1) for c in ("h", "size", "shard", "name", "bucket", "first")})
    assert sharding.shard_by_bytes(odd).columns == sharding.shard_by_bytes(sf_docs).columns
    assert packing.pack(odd).count() == sf_docs.count()
