"""Whitening against a dense eigendecomposition, inertia counts against eigenvalues."""

import math

import numpy as np
import pytest

from cirrus.llm import whitening as W

NAN, INF = float("nan"), float("inf")


def test_inertia_counts_eigenvalues_below_a_shift():
    rng = np.random.default_rng(1)
    for _ in range(80):
        n = int(rng.integers(1, 40))
        m = rng.normal(size=(n, n)) * rng.integers(0, 2, (n, n))
        m = m + m.T
        s = float(rng.normal())
        assert W.inertia(m, s) == int((np.linalg.eigvalsh(m) < s).sum())
    assert W.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


@pytest.mark.parametrize("seed", range(6))
def test_leading_pairs_are_those_of_a_dense_solver(seed):
    rng = np.random.default_rng(seed)
    n = [3, 16, 17, 40, 64, 90][seed]
    x = rng.normal(size=(4 * n, n)) @ (rng.normal(size=(n, n)) * 10.0 ** rng.uniform(-3, 2, n))
    v = np.cov(x.T, bias=True)
    value, vector = W.leading(v, 16)
    want, full = np.linalg.eigh(v)
    k = min(16, n)
    assert len(value) == k and np.allclose(value, want[::-1][:k], rtol=1e-9, atol=1e-13 * want[-1])
    assert np.abs(vector.T @ vector - np.eye(k)).max() < 1e-12
    assert np.linalg.norm(v @ vector - vector * value, axis=0).max() < 1e-13 * want[-1]


def test_equal_eigenvalues_and_low_rank():
    for diagonal, k in (([3.0] * 20, 16), ([5.0, 5.0, 5.0, 1.0], 2), ([5.0, 4.0, 0.0, 0.0], 3), ([0.0, 0.0], 2), ((0.5 ** np.arange(24)).tolist(), 16), ([1.0, 1 - 1e-14, 1 - 3e-14, 0.5], 2)):
        value, vector = W.leading(np.diag(diagonal), k)
        want = [x for x in sorted(diagonal, reverse=True)[:k] if x > 0]
        assert np.allclose(value, want) and np.allclose(vector.T @ vector, np.eye(len(want)))
    assert W.leading(np.zeros((0, 0)), 4)[0].size == 0


def plain(rows):
    """Expected rows (id, component, n, deviation, |whitened|, explained) by numpy's solver."""
    use = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for d in {len(v) for _, v in use}:
        own = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in use if len(v) == d]
        fit = np.array(sorted({tuple(v) for _, v in own}), np.int64)
        n, s = len(fit), fit.sum(0)
        y = fit - s / n
        value, vector = np.linalg.eigh(y.T @ y / n)
        value, vector = value[::-1][:16], vector[:, ::-1][:, :16]
        trace = (y * y).sum() / n
        for i, x in own:
            dev = sum((n * a - int(b)) ** 2 for a, b in zip(x, s))
            for k in range(len(value)):
                if value[k] > 1e-12 * value[0]:
                    out.append((i, k + 1, n, dev, abs(float((np.array(x) - s / n) @ vector[:, k])) / math.sqrt(value[k]), value[k] / trace))
    return out


def test_rows_match_a_dense_solver(spark):
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(700, 24)) * np.linspace(0.05, 2, 24)).astype(np.float32)
    x[100:300] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 3)).astype(np.float32))]  # another length
    rows += [(None, x[0].tolist()), (5, x[6].tolist()), (2000, [1.0])]
    odd = [(3000, None), (3001, []), (3002, [None] * 24), (3003, [NAN] * 24), (3004, [INF] + [0.0] * 23)]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows + odd], "vec_id long, embedding array<float>, component int").repartition(5)
    out = W.whiten(df).collect()
    want = plain(rows)
    assert len(out) == len(want)
    key = lambda r: (str(r[0]), r[1], r[2], r[3], round(r[4], 6))
    a = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in out), key=key)
    for g, w in zip(a, sorted(want, key=key)):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], abs=1e-7) and g[5] == pytest.approx(w[5], rel=1e-9)
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-10


def test_nothing_to_whiten(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert W.whiten(none).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert W.whiten(same).collect() == []  # one distinct vector has no component


def test_what_64_bits_do_not_hold_raises(spark):
    for v, text in (([1e30], "beyond 64 bits"), ([1e10], "beyond 64 bits")):
        df = spark.createDataFrame([(1, v), (2, [0.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match=text):
            W.whiten(df).collect()


def test_deviation_is_exact_near_the_limit():
    f = W.Fit(3, np.array([3_000_001, 2_999_990], object), np.zeros(0), np.zeros((2, 0)), 0.0)
    x = np.array([[1_000_000, 1_000_003], [700_000_000, 5]], np.int64)
    assert f.deviation(x).tolist() == [sum((3 * int(a) - s) ** 2 for a, s in zip(row, (3_000_001, 2_999_990))) for row in x]
