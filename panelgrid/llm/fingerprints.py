"""Document fingerprints from closed syncmers.

A window of K bytes is an anchor if the least of its S-byte parts is the first or the last one. That
depends on the window alone, so equal passages have equal anchors wherever they stand. The
fingerprint is the sketch of a document's SIZE least anchor hashes.
"""

from __future__ import annotations

import base64
import bisect
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelgrid.llm.common import compute, narrow
from panelgrid.llm.hashing import mixed, sliding_least

K, S = 24, 8
SIZE = 64
RANGE_BYTES = 4 << 20  # text a range of neighbouring documents holds
MAX_RANGES = 1 << 16  # bounds kept on the driver; ranges get longer beyond, they are streamed


def anchors(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets, 64-bit hashes) of the closed syncmers; a text under K bytes is one anchor."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(raw) < K:
        digest = hashlib.blake2b(raw.tobytes(), digest_size=8).digest()
        return np.zeros(1, np.int64), np.frombuffer(digest, np.uint64)
    parts = raw[:len(raw) - S + 1].astype(np.uint64)
    for i in range(1, S):
        parts = (parts << np.uint64(8)) | raw[i:len(raw) - S + 1 + i]
    parts = mixed(parts)
    width = K - S + 1
    least = sliding_least(parts, width)
    at = np.flatnonzero((least == parts[:len(least)]) | (least == parts[width - 1:]))
    whole = parts[at]
    for i in range(S, K - S + 1, S):
        whole = mixed(whole * np.uint64(3) + parts[at + i])
    return at, whole


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The SIZE least distinct hashes, 32 bits of each."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:SIZE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common anchors, estimated on the least ones of both together; 1 if both are empty."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)
    if len(a) == SIZE or len(b) == SIZE:
        union = union[:SIZE]
    return float(np.isin(union, np.intersect1d(a, b)).mean())


def encoded(s: np.ndarray) -> str:
    return base64.b64encode(s.tobytes()).decode()


def anchor_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, at, anchor): every anchor with its byte offset, for matching passages by place."""
    def finder():
        def find(text):
            at, hashes = anchors(text)
            return at.tolist(), hashes.view(np.int64).tolist()
        return find

    return (compute(narrow(docs, id_col, text_col), "text", "ats array<long>, anchors array<long>",
                    finder)
            .select("doc_id", F.explode(F.arrays_zip("ats", "anchors")).alias("x"))
            .select("doc_id", F.col("x.ats").alias("at"), F.col("x.anchors").alias("anchor")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint); a null text counts as empty, with an empty fingerprint."""
    return compute(narrow(docs, id_col, text_col), "text", "n_chars long, fingerprint string",
                   lambda: lambda t: (len(t or ""), encoded(sketch(anchors(t)[1]))))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, role, doc_id, payload), so that neighbours in ascending doc_id meet in one range.

    Ranges follow a sample of hashed ids. Each range also gets, as role 1, the first document of
    the next (the last range that of the first). Texts travel compressed.
    """
    rows = narrow(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    ranges = min(MAX_RANGES, 1 + (size or 0) // RANGE_BYTES)
    every = max(1, n // (64 * ranges))
    ids = rows.filter(F.col("doc_id").isNotNull()
                      & (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)).select("doc_id")
    drawn = sorted(r[0] for r in ids.collect())
    bounds = [drawn[len(drawn) * i // ranges] for i in range(1, ranges)] if drawn else []

    def bucket(doc_id):  # null ids come first
        return -1 if doc_id is None else bisect.bisect_right(bounds, doc_id)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    firsts = (compute(rows.select("doc_id"), "doc_id", f"bucket int, first {id_type}",
                      lambda: lambda i: (bucket(i), i))
              .groupBy("bucket").agg(F.min("first").alias("first")).collect())
    present = sorted((r.bucket, r.first) for r in firsts if r.bucket >= 0)
    present = [(r.bucket, None) for r in firsts if r.bucket < 0] + present
    ahead = {first: present[i - 1][0] for i, (_, first) in enumerate(present)}

    schema = f"bucket int, role int, doc_id {id_type}, payload binary"

    def spread(batches):
        box = zstandard.ZstdCompressor(level=1)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                payload = box.compress(text.encode())
                out.append((bucket(doc_id), 0, doc_id, payload))
                if doc_id in ahead:
                    out.append((ahead[doc_id], 1, doc_id, payload))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()),
                 pa.array([x[2] for x in out], b.schema.field("doc_id").type),
                 pa.array([x[3] for x in out], pa.binary())], ["bucket", "role", "doc_id", "payload"])

    return rows.mapInArrow(spread, schema)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of
    the next document, in ascending doc_id, from the last round to the first. Null texts count as
    empty; null ids come first; rows of equal id follow each other in a fixed order; a single row is
    its own next; an empty table gives no rows. One range is streamed, two texts at a time.
    """
    placed = (with_next(docs, id_col, text_col).repartition("bucket")
              .sortWithinPartitions("bucket", "role", "doc_id", "payload"))
    id_type = placed.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    target = to_arrow_schema(T._parse_datatype_string(schema))

    def finished(doc_id, text, own, after, after_sketch):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        new = sketch(anchors(edited)[1])
        return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), encoded(own),
                encoded(new), likeness(own, new), likeness(own, after_sketch))

    def streamed(batches):
        box = zstandard.ZstdDecompressor()
        now = None  # (bucket, doc_id, text, sketch) that waits for its next
        for b in batches:
            out = []
            for r in zip(*(b.column(c).to_pylist() for c in ("bucket", "role", "doc_id", "payload"))):
                if r[1] and (now is None or now[0] != r[0]):
                    continue  # a further row of the id that follows the range
                text = box.decompress(r[3]).decode()
                own = sketch(anchors(text)[1])
                if now is not None and now[0] == r[0]:
                    out.append(finished(*now[1:], text, own))
                now = None if r[1] else (r[0], r[2], text, own)
            columns = list(zip(*out)) or [[]] * len(target)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    return placed.mapInArrow(streamed, schema)
