"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance matrix is never built. A block of vectors Q, a little wider than the number of
components, is multiplied by it in passes over the rows: each task centres its rows, forms X'(XQ) and
Spark adds up the tasks as a tree. A Chebyshev polynomial in that product, whose interval ends at the least Ritz
value of the block, damps what is not wanted; QR and a Rayleigh-Ritz step then turn the block towards the
eigenvectors. This goes on until the residual of every wanted component certifies it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelgrid.llm.common import pin

SCALE, SHIFT = 64, 1_000_000  # entries are floor(64 c) + 1000000
LARGEST = 1 << 50  # entries beyond are set to it, so that sums stay exact
ROWS = 2048  # vectors of a block
TOLERANCE = 2e-13  # residual over the greatest eigenvalue
GROWTH = 1e6  # how much more than a wanted component the filter may favour the greatest


@dataclass
class Whitener:
    """n rows with entry sums S; eigenvectors in columns, by falling eigenvalue; trace of the covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    passes: int


def blocks(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(dim, n, ids, x, sums): up to ROWS vectors of one length as long integers, and their sums."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    schema = T.StructType([
        T.StructField("dim", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)),
        T.StructField("x", T.BinaryType()), T.StructField("sums", T.ArrayType(T.LongType()))])

    def cut(batches):
        for b in batches:
            ids, column = b.column("id"), b.column("v")
            known = np.array(column.is_valid())
            lengths = np.array(column.value_lengths().fill_null(0))
            # of a sliced column, flatten gives the slice's own values
            values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
            ends = np.cumsum(lengths)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            known &= (bad[ends] == bad[ends - lengths]) & (lengths > 0)
            for dim in np.unique(lengths[known]).tolist():
                own = np.flatnonzero(known & (lengths == dim))
                for at in range(0, len(own), ROWS):
                    part = own[at:at + ROWS]
                    x = values[(ends[part] - dim)[:, None] + np.arange(dim)]
                    x = np.clip(np.floor(SCALE * x), -LARGEST, LARGEST).astype(np.int64) + SHIFT
                    yield pa.RecordBatch.from_pydict({
                        "dim": pa.array([dim], pa.int32()), "n": [len(part)],
                        "ids": pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()),
                                                        ids.take(pa.array(part))),
                        "x": pa.array([x.tobytes()], pa.binary()),
                        "sums": pa.array([x.sum(0).tolist()], pa.list_(pa.int64()))})

    return rows.mapInArrow(cut, schema)


def _sum_of_tasks(held: DataFrame, part) -> np.ndarray:
    """Adds up the arrays ``part(x)`` over all blocks; each task makes one, and tasks add them up as a tree.

    An iteration asks for about a hundred such sums. As jobs without a shuffle or an aggregation to plan
    they leave next to nothing in the driver but the sum.
    """
    def run(batches):
        total = None
        for b in batches:
            for raw, n in zip(b.column("x"), b.column("n").to_pylist()):
                found = part(np.frombuffer(raw.as_buffer(), np.int64).reshape(n, -1))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([len(total)], pa.int32()),
                                              "sum": pa.array([total.tobytes()], pa.binary())})

    sums = held.select("n", "x").mapInArrow(run, "rows int, sum binary").rdd
    return sums.map(lambda r: np.frombuffer(r["sum"]).reshape(r["rows"], -1)).treeReduce(np.add)


def centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x minus the mean, whose whole part is subtracted exactly."""
    return (x - whole).astype(float) - rest


def _mean(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return (np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums]))


def fit(held: DataFrame, n: int, sums: list[int], k: int, block: int | None = None,
        tolerance: float = TOLERANCE, most_passes: int = 2000, seed: int = 7) -> Whitener:
    """The ``k`` greatest eigenpairs of the covariance of blocked rows, each certified by its residual."""
    d = len(sums)
    k = min(k, d)
    width = min(d, block or k + max(8, k // 2))
    whole, rest = _mean(n, sums)
    passes = 0

    def product(q: np.ndarray) -> np.ndarray:
        """Covariance times q, and as a last column the variance of each entry."""
        nonlocal passes
        passes += 1

        def part(x):
            c = centred(x, whole, rest)
            return np.hstack([c.T @ (c @ q), (c * c).sum(0)[:, None]])

        return _sum_of_tasks(held, part) / n

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    while True:
        vq = product(q)
        trace, vq = vq[:, -1].sum(), vq[:, :-1]
        values, turn = np.linalg.eigh(_even(q.T @ vq))
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        scale = max(values[0], 0.0)
        far = np.linalg.norm(vq - q * values, axis=0)[:k].max()
        if far <= tolerance * scale or scale <= 0:
            break
        if passes >= most_passes:
            raise RuntimeError(f"residual {far:g} after {passes} passes")
        q = np.linalg.qr(_filtered(product, q, vq, values, k, far / scale / tolerance))[0]
    real = values[:k] > d * np.finfo(float).eps * scale
    return Whitener(n, sums, q[:, :k][:, real], values[:k][real], float(trace), float(far), passes)


def _even(h: np.ndarray) -> np.ndarray:
    return (h + h.T) / 2


def _filtered(product, q, vq, values, k, wanted: float) -> np.ndarray:
    """A Chebyshev polynomial of the covariance times q, least on [0, smallest Ritz value of the block].

    Its degree is what the last wanted component needs, within what the greatest can grow.
    """
    cut = max(values[-1], values[0] * 1e-12)
    gain = [math.acosh(max(2 * x / cut - 1, 1.0)) for x in (values[0], values[k - 1])]
    degree = math.ceil(math.log(4 * wanted) / max(gain[1], 1e-3))
    if gain[0] > gain[1]:
        degree = min(degree, max(2, int(math.log(GROWTH) / (gain[0] - gain[1]))))
    degree = max(2, min(degree, 40))
    # scaled so that each column, close to an eigenvector, keeps its size
    half = cut / 2
    before, now = q, (vq - half * q) / half
    for _ in range(degree - 1):
        size = np.linalg.norm(now, axis=0)
        before, now = before / size, now / size
        before, now = now, 2 * (product(now)[:, :-1] - half * now) / half - before
    return now / np.linalg.norm(now, axis=0)


def whiten(vectors: DataFrame, k: int = 32, id_col: str = "vec_id", vec_col: str = "embedding",
           **options) -> DataFrame:
    """(vec_id, deviation, whitened, n, values, trace, identity_error), one row per fitted vector.

    Entries c become floor(64 c) + 1000000. ``whitened``: the centred vector on each of the ``k``
    greatest components over the root of its eigenvalue (``values``); ``deviation``: the exact sum over
    entries of (n x - S)**2, null beyond 63 bits; ``identity_error``: the largest entry, without sign, of
    the covariance of all whitened rows minus the identity. Vectors that are null, empty or hold a null,
    NaN or infinity are left out, so are those of another length than most have (of equally frequent
    lengths the longest is taken). Components without variance are not returned, so equal vectors have
    an empty ``whitened``; null ids are kept; rows that repeat count each; an empty table gives no
    rows; further columns are not read.
    """
    held = pin(blocks(vectors, id_col, vec_col), "white-blocks")
    id_type = held.schema["ids"].dataType.elementType.simpleString()
    ddl = (f"vec_id {id_type}, deviation long, whitened array<double>, n long, values array<double>, "
           "trace double, identity_error double")
    sizes = held.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], ddl)
    held = held.filter(F.col("dim") == sizes.dim)
    sums = [int(r.s) for r in held.select(F.posexplode("sums")).groupBy("pos").agg(
        F.sum(F.col("col").cast("decimal(20,0)")).alias("s")).orderBy("pos").collect()]
    model = fit(held, sizes.n, sums, k, **options)
    whole, rest = _mean(model.n, sums)
    onto = model.vectors / np.sqrt(model.values)
    width = onto.shape[1]

    def moments(x):
        w = centred(x, whole, rest) @ onto
        return np.vstack([w.T @ w, w.sum(0)])

    error = 0.0
    if width:
        found = _sum_of_tasks(held, moments) / model.n
        error = float(np.abs(found[:-1] - np.outer(found[-1], found[-1]) - np.eye(width)).max())
    fixed = [model.n, model.values.tolist(), model.trace, error]
    over = np.array([s - model.n * w for s, w in zip(sums, whole.tolist())], object)

    def run(batches):
        small = over.astype(np.int64)
        for b in batches:
            for raw, ids in zip(b.column("x"), b.column("ids")):
                x = np.frombuffer(raw.as_buffer(), np.int64).reshape(len(ids), -1)
                w = centred(x, whole, rest) @ onto
                y = x - whole
                # exact either way; long integers only where they cannot overflow
                if len(over) * (float(np.abs(y).max() + 1) * model.n) ** 2 < 2.0 ** 62:
                    far = ((y * fixed[0] - small) ** 2).sum(1).tolist()
                else:
                    far = [(row * fixed[0] - over) for row in y.astype(object)]
                    far = [v if v < 1 << 63 else None for v in (int((r * r).sum()) for r in far)]
                rows = len(ids)
                flat = pa.array(w.ravel())
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(far, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), flat),
                     *[pa.array([v] * rows, t) for v, t in zip(fixed, (
                         pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64()))]],
                    ["vec_id", "deviation", "whitened", "n", "values", "trace", "identity_error"])

    return held.select("x", "ids").mapInArrow(run, ddl)


def whitened_components(vectors: DataFrame) -> DataFrame:
    """One row per vector and component: its whitened entry and the share of variance it explains."""
    rows = whiten(vectors).select("*", F.posexplode("whitened").alias("at", "entry"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("entry").alias("whitened"),
        (F.element_at("values", F.col("at") + 1) / F.col("trace")).alias("explained"), "identity_error")
