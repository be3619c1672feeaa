import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from panelgrid.llm import word_runs as W

SPACE = "[^\x20\x09-\x0D]+"


def brute(words):
    """Every run by trying each lag at each place."""
    n, found = len(words), {}
    for d in range(1, n // 4 + 1):
        i = d
        while i < n:
            if words[i] != words[i - d]:
                i += 1
                continue
            a = i
            while i < n and words[i] == words[i - d]:
                i += 1
            length = i - a + d
            if length >= max(6, 4 * d):
                found.setdefault((a - d, length), d)
    return sorted((s, m, d) for (s, m), d in found.items())


def some_words(rnd, n, letters):
    out = []
    while len(out) < n:
        part = [rnd.choice(letters) for _ in range(rnd.randrange(1, 40))]
        kind = rnd.random()
        if kind < .4:
            whole = part * rnd.randrange(1, 9)
            out += whole[:len(whole) - rnd.randrange(len(part))]
        elif kind < .6 and out:
            a = rnd.randrange(len(out))
            out += out[a:a + rnd.randrange(90)]
        else:
            out += part
    return out[:n]


@pytest.mark.parametrize("seed", range(60))
def test_runs_against_brute_force(seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(W, "OPEN", rnd.choice([3, 50, 1 << 20]))
    monkeypatch.setattr(W, "PIECE", rnd.choice([7, 200, 1 << 22]))
    words = some_words(rnd, rnd.randrange(0, 900), "abcdefghij"[:rnd.choice([1, 2, 3, 10])])
    raw = " ".join(words).encode()
    numbers = W.numbered(raw)
    assert len(set(zip(numbers.tolist(), words))) == len(set(words))
    runs = W.word_runs(numbers)
    assert runs == brute(words)
    gone = {i for s, m, d in runs for i in range(s + d, s + m)}
    kept = [w for i, w in enumerate(words) if i not in gone]
    assert W.collapsed(raw, runs, len(words)).decode() == " ".join(kept)


def test_long_texts():
    one = np.zeros(300_000, np.int64)
    assert W.word_runs(one) == [(0, 300_000, 1)]
    big = np.tile(np.arange(1000) % 100, 300)
    assert W.word_runs(big) == [(0, 300_000, 100)]
    rnd = np.random.default_rng(1)
    noise = rnd.integers(0, 50, 200_000)
    noise[70_000:110_000] = np.tile(noise[70_000:80_000], 4)
    got = [r for r in W.word_runs(noise) if r[2] > 50]
    assert len(got) == 1 and got[0][2] == 10_000 and got[0][0] <= 70_000 and got[0][1] >= 40_000


def expected(doc_id, text):
    words = re.findall(SPACE, text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, m, d in runs for i in range(s + d, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join("%d,%d,%d\n" % r for r in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_brute_force(sf_docs):
    small = sf_docs.filter("length(text) < 20000")
    got = sorted(tuple(r) for r in W.run_digests(small).collect())
    assert got == sorted(expected(r.doc_id, r.text) for r in small.collect())
    assert sum(r[1] > 0 for r in got) > 5


def test_awkward_rows(spark, awkward):
    clashing = awkward.selectExpr("*", "1 as runs", "2 as h", "3 as words", "4 as best")
    got = sorted((tuple(r) for r in W.run_digests(clashing).collect()), key=str)
    assert got == sorted((expected(r.doc_id, r.text) for r in awkward.collect()), key=str)
    assert W.run_digests(awkward.limit(0)).count() == 0
