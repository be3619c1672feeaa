import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelgrid.llm import suffix_dedup as S


def brute(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept) by counting every string."""
    raws = [(r.doc_id, (r.text or "").encode()) for r in rows]
    often = Counter(t[i:i + length] for _, t in raws for i in range(len(t) - length + 1))
    for doc_id, t in raws:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if often[t[i:i + length]] > 1:
                gone[i:i + length] = True
        n = len(S.stretches(gone)[0])
        yield doc_id, len(t), int(gone.sum()), n, bytes(np.frombuffer(t, np.uint8)[~gone])


def check(df, length):
    want = sorted(map(str, brute(df.collect(), length)))
    got = sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)))
                 for r in S.dedup_bytes(df, length).collect())
    assert got == want


def noisy(seed, n, alphabet="ab", size=300):
    rnd = random.Random(seed)
    parts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(5, 90))) for _ in range(6)]
    return ["".join(rnd.choice(parts) if rnd.random() < .7 else rnd.choice(alphabet) * 9
                    for _ in range(rnd.randrange(size // 40))) for _ in range(n)]


@pytest.mark.parametrize("length", [5, 40, 100])
def test_repeated_starts(length):
    texts = [t.encode() for t in noisy(length, 30) + ["a" * 250, "ab" * 120, "", "x\0" * 90, "\0" * 120]]
    often = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    for t, got in zip(texts, S.repeated_starts(texts, length)):
        assert got.tolist() == [often[t[i:i + length]] > 1 for i in range(len(t) - length + 1)]


def test_order_and_common_prefixes():
    text = noisy(9, 1, "abc", 3000)[0].encode() * 2
    raw = np.frombuffer(text + bytes(8), np.uint8).astype(np.uint64)
    words = sum(raw[i:i + len(text) + 1] << np.uint64(56 - 8 * i) for i in range(8))
    valid = np.zeros(len(words), bool)
    valid[:len(text) - 50] = True
    order = S.refined(words, valid, 50)
    assert [text[i:i + 50] for i in order] == sorted(text[i:i + 50] for i in range(len(text) - 50))
    got = S.common_prefixes(words, order, np.array([0]), np.array([len(text) - 50]), 50)
    for k in range(1, len(order)):
        a, b = text[order[k - 1]:][:50], text[order[k]:][:50]
        assert got[k] == next((i for i in range(50) if a[i] != b[i]), 50)


def test_against_brute_force(sf_docs):
    check(sf_docs, 400)


@pytest.mark.parametrize("crowded", [3000, 1])
def test_small_strings(table, monkeypatch, crowded):
    monkeypatch.setattr(S, "ANCHOR", 16)
    monkeypatch.setattr(S, "CROWDED", crowded)
    monkeypatch.setattr(S, "SHARD_BYTES", 2000)
    check(table(noisy(3, 60) + ["a" * 400, "ab" * 200, None, "", "é語" * 90]), 60)


def test_awkward(awkward, table):
    check(awkward, 400)
    check(awkward, 10)
    assert S.dedup_digests(table([])).count() == 0
    odd = awkward.withColumn("key", F.lit(1)).withColumn("mark", F.lit(2)).withColumn("spans", F.lit(3))
    assert S.dedup_digests(odd).count() == awkward.count()


def test_spans_and_text_of_the_query(sf_docs):
    rows = {r.doc_id: r for r in S.dedup_digests(sf_docs).collect()}
    assert any(r.n_spans > 1 for r in rows.values())
    for d in sf_docs.collect():
        r, raw = rows[d.doc_id], (d.text or "").encode()
        spans = [tuple(map(int, x.split(":"))) for x in r.removed_spans.split(",") if x]
        assert len(spans) == r.n_spans and sum(e - s for s, e in spans) == r.n_removed
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        edges = [0, *(p for s in spans for p in s), len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
        assert hashlib.sha256(kept).hexdigest() == r.kept_sha256
        assert r.text.replace("\ufffd", "") == kept.decode(errors="replace").replace("\ufffd", "")


def passages(rows, words):
    """(doc_id, n_passage_bytes, passage_spans) by counting every passage."""
    found = []
    for r in rows:
        raw = (r.text or "").encode()
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        found.append((r.doc_id, raw, at, [raw[a[0]:b[1]] for a, b in zip(at, at[words - 1:])]))
    often = Counter(p for *_, own in found for p in own)
    for doc_id, raw, at, own in found:
        gone = np.zeros(len(at), bool)
        for i, p in enumerate(own):
            if often[p] > 1:
                gone[i:i + words] = True
        spans = [(at[a][0], at[b][1]) for a, b in zip(*S.stretches(gone))]
        yield doc_id, sum(b - a for a, b in spans), ",".join(f"{a}:{b}" for a, b in spans)


def check_passages(df, words):
    want = sorted(map(str, passages(df.collect(), words)))
    got = sorted(str((r.doc_id, r.n_passage_bytes, r.passage_spans))
                 for r in S.dedup_bytes(df, words=words).collect())
    assert got == want


def test_passages_against_brute_force(sf_docs):
    check_passages(sf_docs, S.WORDS)


def test_awkward_passages(awkward, table):
    check_passages(awkward, 5)
    check_passages(awkward, 29)
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(60))) for _ in range(40)]
    check_passages(table(texts + ["a " * 200, "\n a\tb" * 60, "a\x0bb\x0cc\rd" * 9, None, "é\x1c 語 " * 30]), 12)


def test_short_passages_of_51_words(table):
    """They share less than 400 bytes, so they stay, but show in both documents and in no other."""
    rnd = random.Random(8)

    def prose(n):
        return " ".join("".join(rnd.choices("abcdefghij", k=rnd.randrange(3, 7))) for _ in range(n))
    plants = [prose(51) for _ in range(20)]
    texts = [prose(90) + glue + p + glue + prose(70) for p in plants for glue in (" ", "\n", "x")]
    rows = {r.doc_id: r for r in S.dedup_digests(table(texts + [prose(200) for _ in range(30)])).collect()}
    assert all(r.n_removed == 0 for r in rows.values())
    for i, t in enumerate(texts):
        (start, end), = (tuple(map(int, s.split(":"))) for s in rows[i].passage_spans.split(","))
        assert t[start:end] in plants[i // 3] and len(t[start:end].split()) >= 49
    assert all(rows[i].n_passage_bytes == 0 for i in range(len(texts), len(rows)))


def test_crowded_passages(table, monkeypatch):
    monkeypatch.setattr(S, "CROWDED", 1)
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(50))) for _ in range(30)]
    check_passages(table(texts + texts[:3]), 9)
