import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from panelgrid.llm import exact_copies as E


def normal(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def expected(rows):
    """(doc_id, keep_id, group_size, digest) of every row, and how often each is kept."""
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r.text)].append(r.doc_id)
    out = []
    for raw, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(raw).hexdigest()) for i in ids]
    return sorted(out, key=str), len(groups)


def check(df, **options):
    digest = E.F.sha2(E.ascii_lower(E.F.coalesce("text", E.F.lit(""))), 256)
    got = E.copy_groups(df, carry=[digest.alias("kept_by"), E.F.col("source")], **options).collect()
    want, groups = expected(df.collect())
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept_by) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.kept_by for r in kept}) == groups
    assert all(r.doc_id == r.keep_id for r in kept)


def test_shares_add_up():
    poly = E.Polynomial(E.PRIMES, 5000)
    raw = np.random.default_rng(3).integers(0, 256, 4000).astype(np.uint8).tobytes()
    for prime, base, whole in zip(E.PRIMES, E.BASES, poly.of(raw).tolist()):
        assert whole == sum(b * pow(base, i, prime) for i, b in enumerate(raw)) % prime
    cuts = [0, 1, 700, 701, 3999, 4000]
    shares = np.array([poly.at(raw[a:b], a) for a, b in zip(cuts, cuts[1:])])
    assert (shares.sum(0) % np.array(E.PRIMES)).tolist() == poly.of(raw).tolist()


def test_query_against_brute_force(sf_docs):
    want, _ = expected(sf_docs.collect())
    got = E.copy_digests(sf_docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert any(r.group_size > 1 for r in got)


def many(table, seed=1):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("aAbBäÄ ") for _ in range(rnd.randrange(0, 400))) for _ in range(30)]
    texts = [rnd.choice(base) for _ in range(80)] + ["Hot Text"] * 60
    texts += [t.swapcase() for t in texts[:40]] + [t[:-1] + "b" for t in base if t]
    return table([(rnd.choice([i, i % 50]), t) for i, t in enumerate(texts)])


@pytest.mark.parametrize("chunk", [40, 150, 1 << 20])
def test_huge_texts_in_chunks(table, chunk):
    check(many(table), chunk=chunk)


@pytest.mark.parametrize("chunk", [60, 1 << 20])
def test_different_texts_of_one_fingerprint(table, chunk):
    """With tiny primes nearly all texts of a length collide; chunks tell them apart."""
    check(many(table, 2), chunk=chunk, primes=(2, 3))


def test_all_texts_compared_when_the_list_is_large(table, monkeypatch):
    monkeypatch.setattr(E, "BROADCAST_BYTES", 0)
    check(many(table, 3))


def test_megabytes(table):
    big = "Lorem ipsum %d " * 90_000
    check(table([(1, big), (2, big.upper()), (3, big[:-1] + "x"), (4, "short")]), chunk=100_000)


def test_awkward_rows(spark, awkward):
    check(awkward)
    check(awkward, chunk=10)
    clashing = awkward.selectExpr("*", "1 as _row", "2 as carry", "3 as piece", "4 as print", "5 as n_bytes",
                                  "6 as keep_id", "7 as kept", "8 as group_size")
    rows = E.without_copies(clashing)
    assert rows.columns == clashing.columns
    assert rows.count() == len({normal(r.text) for r in awkward.collect()})
    assert E.copy_digests(clashing).count() == awkward.count()
    assert E.copy_groups(awkward.limit(0)).count() == 0
