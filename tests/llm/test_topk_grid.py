"""The grid of tasks of top-k search: its size, and the same rows for any grid."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cirrus.llm import topk


def brute(rows, asked, k=10):
    want = []
    for q, w in rows:
        if asked(q):
            found = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in rows if i != q and len(v) == len(w))[:k]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(want)


def searched(spark, rows, asked, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<long>")
    return topk.search(df, asked, **options)


def test_tasks_do_not_grow_with_the_pairs(spark):
    x = np.random.default_rng(1).integers(-300, 300, (600, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    sc = spark.sparkContext
    sc.setJobGroup("topk-grid", "tasks of a search")
    try:
        out = searched(spark, rows, F.lit(True), shard_rows=10, block_rows=12).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    told = sc.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("topk-grid") for s in told.getJobInfo(j).stageIds]
    assert 0 < max(s.numTasks for s in stages if s) <= 2 * topk.TASKS
    assert sorted(tuple(r) for r in out) == brute(rows, lambda q: True)


@pytest.mark.parametrize("n", [0, 1, 10_000, 600_000, 23_000_000, 10**9])
@pytest.mark.parametrize("part", [0.0, 1e-6, 0.01, 1.0])
def test_the_grid_is_bounded(n, part):
    asked = int(n * part)
    size = asked * 352
    columns, lines = topk.grid(n, asked, size)
    held = -(-size // topk.HELD_BYTES)
    assert columns >= 1 and lines >= max(1, held)
    assert columns * lines <= 2 * max(topk.TASKS, held)
    if part == 0.01:  # what is moved follows the rows
        assert lines * n + columns * asked <= max(8, 2 * held) * (n + 1)


@pytest.mark.parametrize("tasks, held", [(1, 64 << 20), (256, 64 << 20), (7, 2000)])
def test_any_grid_finds_the_same_rows(spark, monkeypatch, tasks, held):
    monkeypatch.setattr(topk, "TASKS", tasks)
    monkeypatch.setattr(topk, "HELD_BYTES", held)
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.integers(-900, 900, (300, 6)))]
    rows += [(i + 300, v.tolist()) for i, v in enumerate(rng.integers(-900, 900, (60, 3)))]
    rows += [(400 + i, [c * 50 for c in v]) for i, v in rows[:6]]
    rows += [(410 + i, [c * 300_000 for c in v]) for i, v in rows[6:12]]  # scores beyond 2**52
    rows += [(420, [2**33, -1, 3, 0, 0, 0])]
    rows += [(430 + i, rows[17][1]) for i in range(30)] + [rows[20], (20, rows[21][1])]  # equal rows, an id with two vectors
    asked = [0, 5, 7, 17, 20, 301, 330, 402, 405, 413, 420, 435]
    want = brute(rows, lambda q: q in asked)
    kept = {tuple(v) for q, v in rows if q == 20}
    want = [r for r in want if r[0] != 20] + [r for v in kept for r in brute([*((i, w) for i, w in rows if i != 20), (20, list(v))], lambda q: q == 20)]
    out = searched(spark, rows, F.col("vec_id").isin(asked), shard_rows=20, block_rows=3).collect()
    assert sorted(tuple(r) for r in out) == sorted(want)


def test_vectors_come_back_from_their_bytes():
    ends = [[v] for b in (15, 31, 63) for v in (2**b - 1, -(2**b), *([2**b, -(2**b) - 1] if b < 63 else []))]
    wide = [[1, -2, 3], [40_000, 0, -1], [2**40, 1, 2]]
    vectors = [*ends, *wide]
    lists = pa.array(vectors, pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(vectors))), pa.array([False] * len(vectors)), lists], names=["_i", "_q", "_v"])
    got = [r for part in topk.pack(iter([batch.slice(0, 0), batch.slice(0, 4), batch.slice(4)])) for r in part.to_pylist()]
    assert [len(r["_m"]) // r["_d"] for r in got] == [2, 2, 4, 4, 4, 4, 8, 8, 8, 8, 2, 4, 8]
    assert [topk.unpack([r["_m"]], r["_d"])[:, 0].tolist() for r in got] == vectors
    assert topk.unpack([r["_m"] for r in got[-3:]], 3).T.tolist() == wide


def test_a_level_leaves_out_only_lower_scores():
    rng = np.random.default_rng(3)
    for _ in range(60):
        m = int(rng.integers(1, 400))
        shard = np.floor(rng.normal(size=(6, m)) ** 3 * 50)
        ids, query = rng.permutation(m).astype(np.int64), np.floor(rng.normal(size=6) ** 3 * 50)
        scores = query @ shard
        level = float(np.quantile(scores, rng.uniform(), method="nearest"))
        got, score = topk.best(shard, ids, query, 0, 10, level)
        every = sorted((-float(s), int(i)) for s, i in zip(scores, ids) if i != 0 and s >= level)[:10]
        assert [(-s, i) for s, i in zip(score.tolist(), got.tolist())] == every
