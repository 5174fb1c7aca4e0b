"""Vector links and top-k search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrus.llm import topk, vectors

NAN, INF = float("nan"), float("inf")


def crowd(seed, n=300, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[40:90] = x[40] + rng.normal(size=(50, d)) * 0.1  # a crowd of near copies
    x[100:130] = x[100:130][::3].repeat(3, 0)  # equal ones
    for i in range(150, 250, 2):  # pairs about the threshold
        x[i + 1] = x[i] + rng.normal(size=d) * 0.38
    return x.astype(np.float32)


@pytest.mark.parametrize("block", [2000, 16])
def test_links_match_brute_force(spark, block):
    x = crowd(1)
    rows = [(1000 - i, v.tolist(), i % 2 if i > 200 else 1, 7) for i, v in enumerate(x)]
    odd = [(5001, None, 1, 1), (5002, [0.0] * 16, 1, 1), (5003, [NAN] * 16, 1, 1), (5004, [INF] + [1.0] * 15, 1, 1), (5005, x[0].tolist(), None, 1), (5006, [1.0, 2.0], 1, 1), (5007, [None] * 16, 1, 1), (None, (x[0] * 2).tolist(), 1, 1), (1000, x[0].tolist(), 1, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, n_links int")
    out = vectors.near_duplicates(df, block=block).collect()
    use = [(i, np.array(v, float), l) for i, v, l, _ in rows + odd[-2:]]
    u = np.array([v / math.sqrt(v @ v) for _, v, _ in use])
    hit = (u @ u.T >= 0.93) & np.equal.outer([r[2] for r in use], [r[2] for r in use])
    np.fill_diagonal(hit, False)
    root = np.arange(len(use))
    for i, j in zip(*hit.nonzero()):
        root[root == root[i]] = root[j]
    least = {r: min(use[k][0] for k in np.flatnonzero(root == r) if use[k][0] is not None) for r in set(root.tolist())}
    want = sorted((str(use[k][0]), int(hit[k].sum()), least[root[k]], use[k][0] == least[root[k]]) for k in range(len(use)))
    want += sorted((str(i), 0, i, True) for i, *_ in odd[:-2])
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in out) == sorted(want)
    links = vectors.near_duplicates(df.where("vec_id between 700 and 1000"))
    assert vectors.recall(df.where("vec_id between 700 and 1000").dropDuplicates(["vec_id"]), links.dropDuplicates(["vec_id"]), every=1) >= 0.9


def linked(rows):
    """n_links of (id, vector) rows of one label by brute force, vectors of equal length only."""
    want = {}
    for d in {len(v) for _, v in rows}:
        ids = [i for i, v in rows if len(v) == d]
        x = np.array([v for _, v in rows if len(v) == d], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want.update(zip(ids, ((x @ x.T >= 0.93).sum(1) - 1).tolist()))
    return want


@pytest.mark.parametrize("lengths", [1, 32])
def test_vectors_of_every_length_are_linked(spark, monkeypatch, lengths):
    monkeypatch.setattr(vectors, "LEARNED", lengths)
    xs = [*crowd(1), *crowd(2, d=24), *crowd(3, n=260, d=33), *np.ones((3, 1), np.float32), *(np.ones((2, 2), np.float32) * 7)]
    rows = [(i, v.tolist()) for i, v in enumerate(xs)]
    out = vectors.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int")).collect()
    want = linked(rows)
    for d in {len(v) for v in xs}:
        asked = sum(want[i] for i, v in rows if len(v) == d)
        got = sum(r.n_links for r in out if len(r.embedding) == d)
        assert 0.99 * asked <= got <= asked and asked > 0
    assert all(r.n_links <= want[r.vec_id] and len(rows[r.component_id][1]) == len(r.embedding) for r in out)


def leaning(d, norm, n=400, seed=4):
    """Unit vectors with a mean of about `norm`, every other one at a cosine of 0.94 with the one before."""
    rng = np.random.default_rng(seed)
    x, to = rng.normal(size=(2, n, d))
    x[:, 0] = x[:, 1:].std() * math.sqrt(d) * norm / math.sqrt(1 - norm * norm)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    to -= (to * x).sum(1, keepdims=True) * x
    y = 0.94 * x + math.sqrt(1 - 0.94**2) * to / np.linalg.norm(to, axis=1, keepdims=True)
    x[1::2] = y[::2]
    return x


@pytest.mark.parametrize("norm", [0.7, 0.85])
def test_a_common_direction_costs_no_links(spark, norm):
    rows = [(i, v.tolist()) for i, v in enumerate(leaning(64, norm))]
    out = vectors.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")).collect()
    want = linked(rows)
    assert sum(want.values()) >= 400 and all(r.n_links <= want[r.vec_id] for r in out)
    assert sum(r.n_links for r in out) >= 0.99 * sum(want.values())


@pytest.mark.parametrize("d", [2, 8, 64])
@pytest.mark.parametrize("norm", [0.0, 0.7, 0.9])
def test_pairs_at_the_threshold_are_rarely_missed(d, norm):
    x = leaning(d, norm, 2000)
    bits = vectors.TABLES * vectors.SUB
    assert vectors.missed(vectors.random_rotations(d, bits), x, 0.93, vectors.TABLES, vectors.SUB) < 0.005


def test_rotations_are_learned_at_every_size():
    """The signs of learned rotations lose less than those of the random ones, and stay orthogonal."""
    rng = np.random.default_rng(2)
    for n in (30, 500, 3000):
        x = rng.normal(size=(n, 24)) * np.linspace(0.1, 3, 24)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        unit -= unit.mean(0)
        lost = []
        for r in (vectors.learn_rotations(x, 48)[:, :24], vectors.random_rotations(24, 48)[:, :24]):
            assert np.abs(r.T @ r - np.eye(24)).max() < 1e-9
            y = unit @ r
            lost.append(np.abs(y).sum())
        assert lost[0] > lost[1]


@pytest.mark.parametrize("size", [1e160, 1e-170, 1e300])
def test_very_large_and_small_vectors_are_linked(spark, size):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 8))
    x[20:] = x[:20] * 1.7 + rng.normal(size=(20, 8)) * 0.01
    rows = [(i, (v * size if i < 30 else v).tolist(), 1) for i, v in enumerate(x)]
    out = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = linked([(i, v.tolist()) for i, v in enumerate(x)])
    assert {r.vec_id: r.n_links for r in out} == want and sum(want.values()) >= 40


def test_nothing_to_link(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_duplicates(none).count() == 0
    bad = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r)[3:] for r in vectors.near_duplicates(bad).collect()] == [(0, 1, True)]


@pytest.mark.parametrize("shard", [4096, 40])
def test_top_k_is_exact(spark, shard):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 12)) * 0.3
    x[10:60] = x[10]  # ties
    x[200:260, 1:] *= 0.01
    x = x.astype(np.float32)
    odd = [(900, None), (1000, [NAN] * 12), (1100, [None] * 12), (1200, [1.0, 2.0]), (None, x[0].tolist()), (3, x[3].tolist()), (-100, x[7].tolist())]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    out = topk.search(df, F.col("vec_id") % 100 == 0, vector=topk.whole(F.col("embedding")), shard_rows=shard, block_rows=2).collect()
    use = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    want = []
    for q, w in use:
        if q % 100 == 0:
            found = sorted((-int(w @ v), i) for i, v in use if i != q and len(v) == len(w))[:10]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(found, 1)]
    assert sorted(tuple(r) for r in out) == sorted(want)
    assert topk.search(df.limit(0), F.lit(True), vector=topk.whole(F.col("embedding"))).count() == 0
    assert topk.search(df, F.lit(False), vector=topk.whole(F.col("embedding"))).count() == 0


@pytest.mark.parametrize("size", [2.0**21, 2.0**24, 2.0**40])
def test_large_components_are_scored_exactly(spark, size):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(60, 4)), 3)
    x[::3] *= size
    x[0] /= 2.0**14  # scores above 2**53 that still fit 64 bits
    x[1::3, 1:] *= 1e-3
    x[20:, 2] = 0.0
    if size > 2.0**30:  # the largest only where scores still fit 64 bits
        x[::3, 1:], x[0], x[1::3], x[2::3] = 0.0, 1.0, np.round(x[1::3], 1), np.round(x[2::3], 1)
    x[3, 0] = size + 1 / 1024
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    asked = [0, 1, 2]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = topk.search(df, F.col("vec_id").isin(asked), vector=topk.whole(F.col("embedding")), shard_rows=20).collect()
    use = [[math.floor(1024 * c) for c in v] for _, v in rows]
    want = []
    for q in asked:
        found = sorted((-sum(a * b for a, b in zip(use[q], v)), i) for i, v in enumerate(use) if i != q)[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(found, 1)]
    assert sorted(tuple(r) for r in out) == sorted(want)


def test_what_64_bits_do_not_hold_raises(spark):
    for size in (1e30, 2.0**40):
        df = spark.createDataFrame([(0, [size]), (1, [size])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="beyond 64 bits"):
            topk.search(df, F.lit(True), vector=topk.whole(F.col("embedding"))).collect()


def test_pruning_never_loses_a_row():
    rng = np.random.default_rng(9)
    for _ in range(60):
        m = int(rng.integers(1, 700))
        shard = np.floor(rng.normal(size=(6, m)) ** 3 * 50)
        ids, query = rng.permutation(m).astype(np.int64), np.floor(rng.normal(size=6) ** 3 * 50)
        got, score = topk.best(shard, ids, query, 0, 10)
        every = sorted((-float(s), int(i)) for s, i in zip(query @ shard, ids) if i != 0)[:10]
        assert [(-s, i) for s, i in zip(score.tolist(), got.tolist())] == every
