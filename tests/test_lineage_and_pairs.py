"""Lineage over a frontier (J5) and co-moments of many columns (A10) against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrus.operators import lookups as L
from cirrus.operators import profile as A


def plain(rows):
    parent = dict(rows)
    out = {}
    for i in parent:
        path, at = [], i
        while parent.get(at) is not None and len(path) <= len(parent):
            at = parent[at]
            path.append(at)
        out[i] = (at, len(path), [str(x) for x in path[::-1]]) if len(path) <= len(parent) else (None, None, None)
    return out


@pytest.mark.parametrize("hot", [10_000, 2])
def test_lineage_matches_a_walk(spark, monkeypatch, hot):
    monkeypatch.setattr(L, "HOT_ROWS", hot)
    monkeypatch.setattr(L, "HOT_KEYS", 4)
    rng = np.random.default_rng(1)
    rows = [(0, None), (1, 0), (2, 1), (3, None), (4, 99), (5, 6), (6, 5), (7, 5), (8, 8), (9, 2)]
    rows += [(i, int(rng.choice([0, 3, 50, i - 1, i - 1, i - 1]))) for i in range(50, 200)]
    rows += [(i, i - 1 if i > 300 else None) for i in range(300, 400)]
    want = plain(rows)
    df = spark.createDataFrame(rows, "id long, parent_id long").repartition(5)
    assert {r["id"]: (r["root"], r["depth"]) for r in L.lineage(df).collect()} == {i: w[:2] for i, w in want.items()}
    assert {r["id"]: r["ancestors"] for r in L.ancestors(df).collect()} == {i: w[2] for i, w in want.items()}
    assert L.lineage(df.limit(0)).count() == 0 and L.lineage(df.where("id = 0")).first()["root"] == 0


def test_the_frontier_of_a_star_is_settled_in_one_step(spark):
    n = 300_000
    star = spark.range(n).select("id", F.when(F.col("id") > 0, F.lit(0)).cast("long").alias("parent_id"))
    out = L.lineage(star)
    assert tuple(out.agg(F.count("*"), F.max("root"), F.min("depth"), F.sum("depth")).first()) == (n, 0, 0, n - 1)


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(2)
    n, p = 1500, 1000
    x = rng.normal(size=(n, p)) @ np.diag(rng.uniform(0.1, 50, p)) + rng.uniform(-1e4, 1e4, p)
    x[:, 1] = 3 * x[:, 0] - 7
    x[:, 2] = 5.5
    import pandas as pd
    from cirrus.operators.comoments import correlations
    frame = pd.DataFrame(x, columns=[f"c{i}" for i in range(p)])
    got = correlations(spark.createDataFrame(frame).repartition(4), list(frame.columns)).toPandas()
    assert len(got) == p * p
    r = got.pivot(index="var1", columns="var2", values="r").loc[frame.columns, frame.columns].to_numpy()
    keep = [i for i in range(p) if i != 2]
    assert np.abs(r[np.ix_(keep, keep)] - np.corrcoef(x[:, keep].T)).max() < 1e-9
    assert np.isnan(r[2]).all() and np.isnan(r[:, 2]).all()


@pytest.mark.parametrize("parts", [1, 7])
def test_correlations_use_the_rows_that_both_have(spark, parts):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        a, b = (float(v) for v in rng.normal(size=2))
        rows.append((None if i % 3 == 0 else a + 1e6, None if i % 5 == 0 else a + b, 2.0 if i % 2 else (None if i % 3 else 4.0), 0.1, None, math.nan if i % 7 == 0 else b, i if i < 200 else None, None if i < 200 else i))
    cols = ["a", "b", "half", "same", "none", "nan", "lo", "hi"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols[:6]) + ", lo long, hi long").repartition(parts)
    got = {(r["var1"], r["var2"]): r["r"] for r in A.correlation_matrix(df, cols).collect()}
    x = np.array([[math.nan if v is None else float(v) for v in r] for r in rows])
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            both = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
            u, v = x[both, i], x[both, j]
            if both.sum() < 2 or len(set(u)) == 1 or len(set(v)) == 1:
                assert got[a, b] is None, (a, b)
            else:
                assert got[a, b] == pytest.approx(np.corrcoef(u, v)[0, 1], abs=1e-9), (a, b)
    empty = A.correlation_matrix(df.limit(0), ["a", "b"]).collect()
    assert len(empty) == 4 and all(r["r"] is None for r in empty)
