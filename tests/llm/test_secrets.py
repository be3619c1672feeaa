import base64
import gzip
import hashlib
import json
import re
import zlib
from urllib.parse import quote

import pytest

from panelgrid.llm import secret_scan as S


def plain(text):
    """Base spans by walking the text."""
    out, word = [], "password|passwd|secret|token|apikey|api_key".split("|")
    low, i = "".join(c.lower() if c < "\x80" else c for c in text), 0
    while i < len(text):
        hit = next((w for w in word if low.startswith(w, i)), None)
        if hit:
            m = re.match(r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text[i + len(hit):])
            if m:
                end = i + len(hit) + m.end()
                if len(m[1]) >= 6:
                    out.append(("assign", i, end))
                i = end
                continue
        i += 1
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if m.end() - m.start() >= 20:
            out.append(("access", *m.span()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if m.end() - m.start() >= 24:
            out.append(("hex", *m.span()))
    order = ["assign", "access", "hex"]
    return sorted(out, key=lambda x: (x[1], order.index(x[0])))


def test_base_spans(sf_docs):
    texts = [r.text for r in sf_docs.collect()]
    texts += ["Token token=abcdef123 PASSWORD: 'x' secret = ſecret api_key=aaaaaa.b",
              "AKIAAKIA" + "A" * 16, "AKIAabc AKIA" + "Z9" * 8, "f" * 23 + "g" + "a1" * 12, "é" * 3]
    for t in texts:
        assert S.find_secrets(t)[0] == plain(t)


KEY = "password=hunter2hunter2"


def packed(level=9):
    return gzip.compress(KEY.encode(), level)


def repr_of(raw):
    return repr(raw)[2:-1]


@pytest.mark.parametrize("wrapped", [
    quote(packed(), safe=""), quote(zlib.compress(KEY.encode()), safe=""),
    "".join(f"%{b:02x}" for b in packed()), repr_of(packed()), repr_of(zlib.compress(KEY.encode())),
    "".join(f"\\x{b:02x}" for b in packed()),
    json.dumps(packed().decode("latin-1"))[1:-1],
    json.dumps(packed().decode("latin-1"), ensure_ascii=False)[1:-1],
    base64.b64encode(KEY.encode("utf-16-le")).decode(), base64.b64encode(KEY.encode("utf-16-be")).decode(),
    base64.b64encode(zlib.compress(KEY.encode())[2:-4]).decode(),
    quote(base64.b64encode(zlib.compress(KEY.encode())[2:-4]).decode(), safe="")])
@pytest.mark.parametrize("before", ["", "é x ", "5 % of x^2 \\ and 日本 "])
def test_bytes_escaped_one_by_one(wrapped, before):
    text = f"clean\n{before}{wrapped} after\nclean"
    base, every = S.find_secrets(text)
    assert base == [] and {k for k, _, _ in every} == {"assign"}
    at = text.index(wrapped)
    for _, start, end in every:
        assert at <= start < at + 3 and at + len(wrapped) - 9 <= end <= at + len(wrapped)
    assert "hunter2" not in S.masked(text, every, "[SECRET]")


def test_text_that_only_looks_packed():
    for text in ["x^2 + \\x41 = \\u0041", "x%01x%5e%1f%8b%08 nothing", "\\x1f\\x8b\\x08", "x^\\x9c" * 2000,
                 "internationalisation/of/paths" * 300]:
        assert S.find_secrets(text) == ([], [])


@pytest.mark.parametrize("wrap", [
    lambda x: quote(x, safe=""),
    lambda x: "".join(f"\\u{ord(c):04x}" for c in x),
    lambda x: base64.b64encode(x.encode()).decode(),
    lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("="),
    lambda x: base64.b64encode(gzip.compress(x.encode())).decode(),
    lambda x: base64.b64encode(zlib.compress(x.encode())).decode(),
    lambda x: quote(base64.b64encode(base64.b64encode(x.encode())).decode(), safe=""),
    lambda x: base64.b64encode(quote(x, safe="").encode()).decode()])
def test_layers_map_back(wrap):
    inner = wrap(KEY)
    text = f"é before {inner} after"
    base, every = S.find_secrets(text)
    kind, start, end = next(x for x in every if x[0] == "assign")
    assert 9 <= start < end <= 9 + len(inner) and end - start > len(inner) * 0.8
    assert "hunter" not in S.masked(text, every, "#") and S.masked(text, every, "#")[:9] == text[:9]


def test_escaped_spans_are_exact():
    text = "x password%3Dhunter22 y token\\u003dabcdef z"
    assert S.find_secrets(text)[1] == [("assign", 2, 21), ("assign", 24, 41)]


def test_ends_on_circles_and_bombs():
    quine = "%25" * 40 + "41"  # every layer holds another
    S.find_secrets(quine)
    bomb = base64.b64encode(zlib.compress(b"a" * (S.MAX_LAYER + 10))).decode()
    assert [k for k, _, _ in S.find_secrets(bomb)[1]] == ["opaque"]


def test_query(awkward):
    rows = S.scan_digests(awkward).collect()
    texts = [r.text for r in awkward.collect()]
    want = sorted(hashlib.sha256(S.joined(plain(t or "")).encode()).hexdigest() for t in texts)
    assert sorted(r.base_sha256 for r in rows) == want
    assert S.scan_digests(awkward.limit(0)).count() == 0
    assert sum(r.text is None for r in S.scan(awkward).collect()) == 2


def wrapped(part, width=76, end="\n"):
    return end.join(part[i:i + width] for i in range(0, len(part), width))


PROSE = " ".join(hashlib.md5(b"%d" % i).hexdigest()[:7] for i in range(30))


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  "])
@pytest.mark.parametrize("width", [60, 64, 76])
@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress, zlib.compress,
                                  lambda x: gzip.compress(gzip.compress(x))])
def test_wrapped_base64_is_one_part(end, width, pack):
    for at in range(0, 60, 7):
        raw = pack(f"{PROSE[:at]} {KEY} {PROSE}".encode())
        part = wrapped(base64.b64encode(raw).decode(), width, end)
        text = f"Key:\n-----BEGIN KEY-----\n{part}\n-----END KEY-----\n"
        spans = [x for x in S.find_secrets(text)[1] if x[0] == "assign"]
        assert spans == [("assign", 25, 25 + len(part))]


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress, zlib.compress])
@pytest.mark.parametrize("before", ["https://host.org/files/", "/a/", "/ab/", "/abc/", "/abcd/", "a_",
                                    "x-", "k--"])
def test_base64_behind_delimiters(before, pack):
    part = base64.urlsafe_b64encode(pack(f"user=me {KEY} and more".encode())).decode().rstrip("=")
    for after in ("", "/rest", "/the/rest"):
        _, every = S.find_secrets(f"{before}{part}{after} end")
        found = [x for x in every if x[0] == "assign"]
        assert found and all(s <= len(before) + 12 and e >= len(before) + len(part) - 12
                             for _, s, e in found)


def test_base64_behind_letters():
    for n in range(8):
        text = "Z" * n + base64.b64encode(f"user=me {KEY}".encode()).decode()
        assert "assign" in [k for k, _, _ in S.find_secrets(text)[1]]


@pytest.mark.parametrize("raw", [b"\x01" + KEY.encode(), KEY.encode() + b"\x00", b"\xff " + KEY.encode(),
                                 "é ".encode() + KEY.encode() + b" \xe9", b"\x08\x12" + KEY.encode() + b"\x1a"])
def test_stray_bytes_do_not_hide(raw):
    part = base64.b64encode(raw).decode()
    assert S.find_secrets(f"a {part} b")[1] == [("assign", 2, 2 + len(part))]


def test_members_and_damage():
    whole = gzip.compress(b"nothing here") + gzip.compress(b"then pass") + zlib.compress(b"word=hunter2hunter2")
    cut = gzip.compress(f"{KEY} {PROSE}".encode())[:-6] + b"??????"
    for raw in (whole, cut):
        part = base64.b64encode(raw).decode()
        (kind, start, end), *_ = S.find_secrets(f"a {part} b")[1]
        assert (kind, start) == ("assign", 2) and end > len(part) * 0.9


def test_lines_of_words_stay():
    text = "\n".join(PROSE.replace(" ", "\n").split()) + "\ninternationalisation/of-words_in/paths\n"
    assert S.find_secrets(text) == ([], [])
