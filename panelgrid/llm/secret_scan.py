"""Secrets in texts and in what is encoded inside them.

A worklist starts with the text. Every layer is scanned; its URL escapes, Unicode escapes, base64 (of
UTF-8, UTF-16 or compressed bytes) and compressed parts, also those whose bytes are escaped one by
one, are decoded into further layers until nothing new appears. A layer carries,
for each of its characters, the span of the original text it came from, so that whatever is found
in it maps back.
"""

from __future__ import annotations

import binascii
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.common import compute, narrow

#: The patterns of the contract, in the order in which kinds are listed. ``opaque``:
#: compressed parts that grow beyond MAX_LAYER; they count as secrets as a whole, so nothing passes.
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"""([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LINE = re.compile(r"[^\n]+")
PERCENT_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_RUN = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
#: Runs of the alphabet, over line breaks too; what decodes from them is found by place and phase.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{12,}|[A-Za-z0-9+/_-]+(?=[ \t]*\r?\n))"
                    r"(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
GAP = re.compile(r"\s+")
DELIMITER = re.compile(r"[+/_-]+")
#: What a secret or an encoded part shows at least, and bytes that are UTF-8 without control characters.
SHOWN = re.compile(rb"[\t\n\r -~]{12,}")
CLEAN = re.compile(rb"(?:[\t-\r -~]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}"
                   rb"|[\xf0-\xf4][\x80-\xbf]{3})+")
#: ASCII text in UTF-16, either order.
WIDE = re.compile(rb"(?:[\t\n\r -~]\x00){12,}|(?:\x00[\t\n\r -~]){12,}")
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
#: Escaped bytes, and how the head of a compressed part looks among them.
PERCENT_BYTE = re.compile(r"%[0-9A-Fa-f]{2}")
BACKSLASH_BYTE = re.compile(r"\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\[abfnrtv0\\'\"/]")
PERCENT_HEAD = re.compile(r"%1f%8b%08|(?:x|%78)%(?:01|5e|9c|da)", re.IGNORECASE)
BACKSLASH_HEAD = re.compile(r"\\(?:x|u00)1f(?:\\(?:x|u00)8b|\x8b)\\(?:x08|u0008|b)"
                            r"|(?:x|\\(?:x|u00)78)(?:\\(?:x|u00)(?:01|5e|9c|da)|[\x9c\xda]|\^(?=.{0,8}\\[ux]))",
                            re.IGNORECASE)
SHORT = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, "0": 0}
BLOCK = 1 << 14  # compressed bytes fed at once
MAX_LAYER = 1 << 26  # bytes one compressed part may unpack to


def find_base(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)
                  if len(m[0]) >= 20]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


class Layer:
    """A text and the original span of each character; ``spans`` is None if it is the original."""

    def __init__(self, text: str, spans: list[tuple[int, int]] | tuple[int, int] | None):
        self.text, self.spans = text, spans

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.spans is None:
            return start, end
        if isinstance(self.spans, tuple):  # decoded as one block
            return self.spans
        return self.spans[start][0], self.spans[end - 1][1]


def _escaped(layer: Layer, m: re.Match, unit: re.Pattern, decode) -> Layer | None:
    """Decodes the escapes ``unit`` inside a match, character by character."""
    chars, spans, at = [], [], m.start()
    for x in unit.finditer(layer.text, m.start(), m.end()):
        for i in range(at, x.start()):
            chars.append(layer.text[i])
            spans.append(layer.origin(i, i + 1))
        own = decode(x[0])
        chars.append(own)
        spans += [layer.origin(x.start(), x.end())] * len(own)
        at = x.end()
    for i in range(at, m.end()):
        chars.append(layer.text[i])
        spans.append(layer.origin(i, i + 1))
    return Layer("".join(chars), spans)


def _from_percent(run: str) -> str:
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")


def _from_unicode(run: str) -> str:
    codes = [int(c, 16) for c in re.findall(r"\\[uUx]([0-9A-Fa-f]+)", run)]
    text = "".join(chr(c) if c < 0x110000 else "�" for c in codes)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _member(raw: memoryview, room: int) -> tuple[bytes, int]:
    """(what one compressed part gives, ``room`` bytes at most; its length). It may be cut or damaged."""
    box, out, at = zlib.decompressobj(47), bytearray(), 0  # zlib or gzip header
    while at < len(raw) and not box.eof and len(out) < room:
        block, before = raw[at:at + BLOCK], box.copy()
        try:
            out += box.decompress(block, room - len(out))
        except zlib.error:
            for i in range(len(block)):  # what comes before the damage
                try:
                    out += before.decompress(block[i:i + 1], room - len(out))
                except zlib.error:
                    break
                if len(out) >= room:
                    break
            return bytes(out), at + i
        at += len(block) - len(box.unconsumed_tail) - len(box.unused_data)
    return bytes(out), at


def _unpacked(raw: bytes):
    """(start, end, text, whether it grew beyond MAX_LAYER) of the compressed parts among bytes."""
    at = 0
    while m := PACKED.search(raw, at):
        end, parts, total, view = m.start(), [], 0, memoryview(raw)
        while not parts or PACKED.match(raw, end):  # one member after the other
            out, n = _member(view[end:], MAX_LAYER + 1 - total)
            parts.append(out)
            total += len(out)
            end += n
            if not out or total > MAX_LAYER:
                break
        if total > MAX_LAYER:
            yield m.start(), end, None, True
        elif total:
            inner = [b"".join(parts)]
            seen = set(inner)
            while inner:  # parts that are compressed again
                one = inner.pop()
                if SHOWN.search(one):
                    yield m.start(), end, one.decode("utf-8", "replace"), False
                for x in PACKED.finditer(one):
                    out, _ = _member(memoryview(one)[x.start():], MAX_LAYER + 1 - total)
                    total += len(out)
                    if total > MAX_LAYER:
                        yield m.start(), end, None, True
                        inner.clear()
                        break
                    if out and out not in seen:
                        seen.add(out)
                        inner.append(out)
        at = max(end, m.start() + 1) if total else m.start() + 1


def _headless(core: str, at: int) -> tuple[bytes, int]:
    """(what a deflate stream without a header gives, its end) if one is whole and begins there in base64."""
    box, out, fed, begin, step = zlib.decompressobj(-zlib.MAX_WBITS), bytearray(), 0, at, 64
    try:
        while at < len(core) and not box.eof and len(out) <= MAX_LAYER:
            part = core[at:at + step]
            part = part[:-1] if len(part) % 4 == 1 else part
            raw = binascii.a2b_base64(part + "=" * (-len(part) % 4))
            out += box.decompress(raw, MAX_LAYER + 1 - len(out))
            fed, at, step = fed + len(raw), at + step, min(4 * step, 4 * BLOCK)
    except zlib.error:  # nearly always within the first bytes
        return b"", 0
    if len(out) > MAX_LAYER:
        return bytes(out), len(core)
    end = begin + -(-(fed - len(box.unused_data)) * 4 // 3)  # characters that hold the bytes used
    return (bytes(out), end) if box.eof and SHOWN.search(out) else (b"", 0)


def _from_headless(layer: Layer, m: re.Match, core: str):
    """Streams without a header that fill whole lines of a base64 run, as ``inner_layers``."""
    begins, ends, removed = [(0, 0)], {}, 0
    for gap in GAP.finditer(m[0]):
        ends[gap.start() - removed] = gap.start()
        removed += len(gap[0])
        begins.append((gap.end() - removed, gap.end()))
    ends[len(core)] = len(m[0])
    for at, place in begins:
        out, end = _headless(core, at)
        if out and (end in ends or end + 1 in ends):
            own = layer.origin(m.start() + place, m.start() + ends.get(end, ends.get(end + 1)))
            yield (None, own) if len(out) > MAX_LAYER else (Layer(out.decode("utf-8", "replace"), own), None)


def _packed_escapes(layer: Layer, line: re.Match, unit: re.Pattern):
    """The compressed parts among the escaped bytes of a line, as ``inner_layers``.

    Escapes of bytes that are no text would be lost in a decoded layer, so they stay bytes here.
    """
    raw, place, at = bytearray(), array("q"), line.start()  # where the character of a byte starts

    def plain(start, end):
        try:
            raw.extend(layer.text[start:end].encode("latin-1"))
            place.extend(range(start, end))
        except UnicodeEncodeError:
            for i in range(start, end):
                own = layer.text[i].encode("latin-1" if layer.text[i] < "\u0100" else "utf-8", "replace")
                raw.extend(own)
                place.extend([i] * len(own))

    for x in unit.finditer(layer.text, line.start(), line.end()):
        plain(at, x.start())
        raw.append(int(x[0][-2:], 16) if len(x[0]) > 2 else SHORT.get(x[0][1], ord(x[0][1])))
        place.append(x.start())
        at = x.end()
    plain(at, line.end())
    place.append(line.end())
    for a, b, text, opaque in _unpacked(bytes(raw)):
        end = place[bisect_right(place, place[b - 1])]
        own = layer.origin(place[a], end)
        yield (None, own) if opaque else (Layer(text, own), None)


def _from_base64(layer: Layer, m: re.Match):
    """What is encoded in a run, as ``inner_layers``.

    A part may begin behind anything, so the run is decoded in its four phases. Its span goes from
    the first to the last delimiter, line or end of the run between which its bytes are clean.
    """
    run = m[0].rstrip("=")
    core = GAP.sub("", run)
    if len(core) < 12:
        return
    plus = core.replace("-", "+").replace("_", "/")
    yield from _from_headless(layer, m, plus)
    edges = None
    for phase in range(4):
        n = len(core) - phase
        raw = binascii.a2b_base64(plus[phase:len(core) - (n % 4 == 1)] + "=" * (-n % 4 if n % 4 > 1 else 0))
        shown, packed, wide = SHOWN.search(raw), PACKED.search(raw), b"\0" in raw and WIDE.search(raw)
        if not shown and not packed and not wide:
            continue
        if edges is None:
            place = [i for i, c in enumerate(run) if not c.isspace()]
            lines = [i for i in range(1, len(place)) if place[i] > place[i - 1] + 1]
            marks = list(DELIMITER.finditer(core))
            # every delimiter may also belong to the part
            begins = sorted({0, *lines, *(i for x in marks for i in range(x.start() + 1, x.end() + 1))})
            edges = sorted({*lines, *(i for x in marks for i in range(x.start(), x.end()))})
            edges.append(len(core))
        starts = sorted({phase, *(i for i in begins if i % 4 == phase)})
        start_at = [(i - phase) // 4 * 3 for i in starts]
        end_at = [max(i - phase, 0) * 3 // 4 for i in edges]

        def span(first, last):
            e = edges[last]
            return layer.origin(m.start() + place[starts[first]],
                                m.end() if e == len(core) else m.start() + place[e - 1] + 1)

        for x in CLEAN.finditer(raw) if shown else ():
            hits = list(SHOWN.finditer(raw, x.start(), x.end()))
            if not hits:
                continue
            first = bisect_left(start_at, x.start())
            if first == len(starts) or start_at[first] > hits[0].start():
                first = bisect_right(start_at, hits[0].start()) - 1
            last = bisect_right(end_at, x.end()) - 1
            if last >= 0:  # the first of those that end with the same byte
                last = bisect_left(end_at, end_at[last])
            if last < 0 or end_at[last] < hits[-1].end():
                last = min(bisect_left(end_at, hits[-1].end()), len(edges) - 1)
            yield Layer(x[0].decode("utf-8", "replace"), span(first, last)), None
        def around(a, b):
            return span(bisect_right(start_at, a) - 1, min(bisect_left(end_at, b), len(edges) - 1))

        for x in WIDE.finditer(raw) if wide else ():
            yield Layer(x[0].replace(b"\0", b"").decode(), around(*x.span())), None
        for a, b, text, opaque in _unpacked(raw) if packed else ():
            own = around(a, b)
            yield (None, own) if opaque else (Layer(text, own), None)


def inner_layers(layer: Layer):
    """What is encoded in a layer: (layer, None), or (None, span) of a part that grows too far."""
    text = layer.text
    for mark, run, decode in (("%", PERCENT_RUN, _from_percent), ("\\", UNICODE_RUN, _from_unicode)):
        if mark in text and run.search(text):
            for line in LINE.finditer(text):
                if run.search(line[0]):
                    yield _escaped(layer, line, run, decode), None
    for mark, head, unit in (("%", PERCENT_HEAD, PERCENT_BYTE), ("\\", BACKSLASH_HEAD, BACKSLASH_BYTE)):
        if mark in text and head.search(text):
            for line in LINE.finditer(text):
                if head.search(line[0]):
                    yield from _packed_escapes(layer, line, unit)
    for m in BASE64.finditer(text):
        yield from _from_base64(layer, m)


def find_secrets(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(spans in the text itself, all spans with those from decoded layers), sorted."""
    order = {k: i for i, k in enumerate(KINDS)}
    base = find_base(text)
    every, seen = set(base), {(text, (0, len(text)))}
    work = [Layer(text, None)]
    while work:
        layer = work.pop()
        if layer.spans is not None:
            every.update((k, *layer.origin(s, e)) for k, s, e in find_base(layer.text))
        for inner, opaque in inner_layers(layer):
            if inner is None:
                every.add(("opaque", *opaque))
                continue
            # a text that decodes to one seen at the same place has gone round in a circle
            mark = (inner.text, inner.origin(0, len(inner.text)))
            if mark not in seen:
                seen.add(mark)
                work.append(inner)
    key = lambda x: (x[1], order[x[0]], x[2])
    return sorted(base, key=key), sorted(every, key=key)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    """The text with ``mask`` for every maximal run of covered characters."""
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, mask: str = "[SECRET]", id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_spans, spans, text), one row per input row.

    The counts and base_spans hold what the text itself shows; spans also what its decoded layers
    show, at the place of the encoded part; both lists are joined as kind:start:end, in code
    points. ``text`` has every span masked. A null text has no spans and stays null; repeated rows
    give a row each; an empty table gives none. Compressed parts that unpack to more than
    MAX_LAYER bytes are reported as ``opaque`` in whole, not scanned.
    """
    def scanner():
        def one(text):
            base, every = find_secrets(text) if text else ([], [])
            n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
            return *n, joined(base), joined(every), masked(text, every, mask) if every else text
        return one

    return compute(narrow(docs, id_col, text_col), "text",
                   "n_assign long, n_access long, n_hex long, base_spans string, spans string, "
                   "text string", scanner)


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, every secret of the text masked, those of decoded layers too."""
    def masker():
        def one(text):
            every = find_secrets(text)[1] if text else []
            return masked(text, every, mask) if every else text,
        return one

    return compute(docs, text_col, f"`{text_col}` string", masker).select(*docs.columns)


def scan_digests(docs: DataFrame) -> DataFrame:
    """The scan with the base spans as a digest and without texts."""
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex",
                             F.sha2("base_spans", 256).alias("base_sha256"), "spans")
