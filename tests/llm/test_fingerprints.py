import hashlib

import numpy as np
import pytest

from panelgrid.llm import fingerprints as P
from panelgrid.llm.hashing import mixed


def direct(text):
    """Closed syncmers window by window, as byte strings."""
    raw, out = text.encode(), {}
    for i in range(len(raw) - P.K + 1):
        window = raw[i:i + P.K]
        parts = [int(mixed(np.array([int.from_bytes(window[j:j + P.S], "big")], np.uint64))[0])
                 for j in range(P.K - P.S + 1)]
        if min(parts) in (parts[0], parts[-1]):
            out[i] = window
    return out


def test_anchors(sf_docs):
    text = sf_docs.first().text[:1500] + "é語" * 40 + "a" * 60
    at, hashes = P.anchors(text)
    want = direct(text)
    assert at.tolist() == sorted(want)
    assert len(set(hashes.tolist())) == len(set(want.values()))


def expected(rows):
    rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r, after in zip(rows, rows[1:] + rows[:1]):
        t, u = r.text or "", after.text or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + u[:half]
        a, b, c = (P.sketch(P.anchors(x)[1]) for x in (t, edited, u))
        yield (r.doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), P.encoded(a),
               P.encoded(b), P.likeness(a, b), P.likeness(a, c))


@pytest.mark.parametrize("size", [300, 20_000, 4 << 20])
def test_next_documents(sf_docs, table, monkeypatch, size):
    monkeypatch.setattr(P, "RANGE_BYTES", size)
    for df in (sf_docs, table(["one"]), table([(None, "first"), (5, "x" * 90), (-7, None), (2, "")]),
               table([])):
        got = [tuple(r) for r in P.compare_with_next(df).collect()]
        assert sorted(map(str, got)) == sorted(map(str, expected(df.collect())))


def test_likeness_follows_overlap(sf_docs):
    texts = [r.text for r in sf_docs.collect() if len(r.text) > 3000][:20]
    for t in texts:
        a = P.sketch(P.anchors(t)[1])
        assert P.likeness(a, a) == 1
        half = P.sketch(P.anchors(t[:len(t) // 2])[1])
        full = [set(P.anchors(x)[1].tolist()) for x in (t, t[:len(t) // 2])]
        exact = len(full[0] & full[1]) / len(full[0] | full[1])
        assert abs(P.likeness(a, half) - exact) < 0.25


def test_awkward(awkward):
    rows = P.compare_with_next(awkward).collect()
    assert len(rows) == 16 and all(0 <= r.near_next <= 1 for r in rows)
    equal = [r.fingerprint for r in P.fingerprints(awkward).collect() if r.doc_id in (8, 9)]
    assert equal[0] == equal[1]
    assert P.anchor_rows(awkward).count() > 100
