import numpy as np
import pytest

from panelgrid.llm import whitening as W

DDL = "vec_id long, embedding array<float>, label int"


def integers(v):
    return np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1_000_000


def direct(x, k):
    """Eigenpairs, whitened rows up to sign and exact deviations from the whole matrix."""
    n, sums = len(x), [int(s) for s in x.sum(0)]
    c = np.array([[(n * int(a) - s) / n for a, s in zip(r, sums)] for r in x])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    far = [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]
    return values, c @ vectors / np.sqrt(values), far, np.trace(c.T @ c / n)


def check(rows, got, k, close=1e-8):
    x = np.array([integers(r.embedding) for r in rows])
    values, whitened, far, trace = direct(x, k)
    place = {r.vec_id: i for i, r in enumerate(rows)}
    assert sorted(r.vec_id for r in got) == sorted(place)
    at = [place[r.vec_id] for r in got]
    assert [r.deviation for r in got] == [far[i] for i in at]
    assert all(r.n == len(rows) and r.identity_error < 1e-9 for r in got)
    assert np.allclose(got[0]["values"], values, rtol=1e-11)
    assert abs(got[0].trace / trace - 1) < 1e-12
    mine = np.array([r.whitened for r in got])
    sign = np.sign((mine * whitened[at]).sum(0))
    assert np.abs(mine * sign - whitened[at]).max() < close


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")


def test_against_direct_solution(sample):
    check(sample.collect(), W.whiten(sample).collect(), 32)


def test_narrow_block_is_filtered(sample):
    held = W.pin(W.blocks(sample, "vec_id", "embedding"), "t")
    x = np.array([integers(r.embedding) for r in sample.collect()])
    model = W.fit(held, len(x), [int(s) for s in x.sum(0)], 5, block=9)
    values, *_ = direct(x, 5)
    assert model.passes > 5 and np.allclose(model.values, values, rtol=1e-11)


@pytest.mark.parametrize("decay", [0.5, 0.97, 1.0])
def test_spectra(spark, decay):
    """Steep, slow and flat spectra of more entries than the block is wide."""
    rnd = np.random.default_rng(4)
    turn = np.linalg.qr(rnd.standard_normal((70, 70)))[0]
    v = (rnd.standard_normal((400, 70)) * 40 * decay ** np.arange(70)) @ turn + 9
    df = spark.createDataFrame([(i, [float(np.float32(c)) for c in r], 0) for i, r in enumerate(v)], DDL)
    check(df.collect(), W.whiten(df, k=12).collect(), 12, 1e-6)


def test_query(sample):
    rows = W.whitened_components(sample)
    assert rows.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained",
                            "identity_error"]
    got = rows.collect()
    assert len(got) == 32 * sample.count()
    shares = {r.component: r.explained for r in got}
    assert sorted(shares) == list(range(1, 33))
    assert list(dict(sorted(shares.items())).values()) == sorted(shares.values(), reverse=True)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0], 0), (2, None, 0), (3, [nan, 1.0, 1.0], 0), (4, [1.0, inf, 1.0], 0),
            (5, [1.0, None, 2.0], 0), (6, [], 0), (None, [2.0, 1.0, 0.5], 0), (8, [1.0, 2.0, 3.0], 0),
            (8, [1.0, 2.0, 3.0], 0), (9, [1.0, 2.0], 0), (10, [-3.0, 7.0, 0.01], 1),
            (11, [-inf, nan, None], 1), (12, [0.5, -0.5, 9.0], 1)]
    df = spark.createDataFrame(rows, DDL).selectExpr("*", "1 as n", "2 as x", "3 as dim", "4 as ids")
    got = W.whiten(df).collect()
    assert sorted(((r.vec_id, len(r.whitened)) for r in got), key=str) == sorted(
        [(1, 3), (None, 3), (8, 3), (8, 3), (10, 3), (12, 3)], key=str)
    x = np.array([integers(r[1]) for r in rows if r[0] in (1, None, 8, 10, 12)])
    assert sorted(r.deviation for r in got) == sorted(direct(x, 3)[2])
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], DDL)
    assert [(r.deviation, r.whitened, r.n) for r in W.whiten(same).collect()] == [(0, [], 5)] * 5
    assert W.whitened_components(same).count() == 0
    assert W.whitened_components(df.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(9)], DDL)
    assert {len(r.whitened) for r in W.whiten(line).collect()} == {1}
    huge = spark.createDataFrame([(i, [1e30 * (i % 2), float(i)], 0) for i in range(9)], DDL)
    assert [r.deviation for r in W.whiten(huge).collect()] == [None] * 9


def test_passes_plan_no_aggregation(sample, monkeypatch):
    """About a hundred passes must not leave as many aggregated queries in the driver."""
    held = W.pin(W.blocks(sample, "vec_id", "embedding").repartition(3), "t")
    x = np.array([integers(r.embedding) for r in sample.collect()])

    def refuse(*_):
        raise AssertionError("a pass is planned as an aggregation")

    for name in ("groupBy", "orderBy", "collect"):
        monkeypatch.setattr(type(held), name, refuse)
    model = W.fit(held, len(x), [int(s) for s in x.sum(0)], 32)
    values, *_ = direct(x, 32)
    assert model.passes > 1 and np.allclose(model.values, values, rtol=1e-11)
