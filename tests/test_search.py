"""The L1 path on sums of products and random search, against plain fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrus.plans import search as SE


def table(spark, n=300):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 4)) * [1, 10, 0.1, 5] + [0, 1e4, 3, -2]
    x[:, 3] = 7.0  # constant
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=n)
    rows = [(*map(float, r), float(v), i % 3) for i, (r, v) in enumerate(zip(x, y))] + [(None, 1.0, 1.0, 1.0, 5.0, 0), (1.0, 1.0, 1.0, 7.0, None, 1)]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, d double, y double, fold int").repartition(4)


def objective(xs, y, b, reg):
    return ((y - xs @ b) ** 2).mean() / 2 + reg * np.abs(b).sum()


def test_path_solves_each_fold_and_scores_the_rest(spark):
    x, y, df = table(spark)
    regs = [0.01, 0.3, 2.0, 100.0]
    path, best = SE.lasso_path(df, ["a", "b", "c", "d"], "y", regs)
    got = {r["reg"]: r for r in path.collect()}
    fold = np.arange(len(y)) % 3
    for reg in regs:
        errors = []
        for k in range(3):
            tr = fold != k
            mean, scale = x[tr].mean(0), np.where(x[tr].std(0) > 1e-9, x[tr].std(0), 1)
            xs, yc = (x[tr] - mean) / scale, y[tr] - y[tr].mean()
            b = SE.lasso(xs.T @ xs / tr.sum(), xs.T @ yc / tr.sum(), reg, np.zeros(4))
            base = objective(xs, yc, b, reg)
            for d in np.eye(4) * 1e-3:  # no step is better
                assert objective(xs, yc, b + d, reg) >= base - 1e-12 <= objective(xs, yc, b - d, reg) + 1e-9
            errors.append(((y[~tr] - y[tr].mean() - ((x[~tr] - mean) / scale) @ b) ** 2).mean())
        assert got[reg]["mse"] == pytest.approx(np.mean(errors), rel=1e-8) and got[reg]["std"] == pytest.approx(np.std(errors), rel=1e-6)
    assert got[100.0]["features_used"] == 0 and got[0.01]["features_used"] >= 2
    coefs = {r["feature"]: r["coefficient"] for r in best.collect()}
    assert coefs["d"] == 0.0 and abs(coefs["a"]) > 1 and abs(coefs["b"]) > 1
    default, _ = SE.lasso_path(df, ["a", "b"], "y")
    assert default.count() == 30 and default.orderBy(F.desc("reg")).first()["features_used"] == 0
    with pytest.raises(ValueError, match="two folds"):
        SE.lasso_path(df.where("fold = 0"), ["a"], "y", [1.0])


def test_candidates_come_from_the_seed():
    space = {"max_depth": (1, 6), "min_impurity_decrease": (1e-4, 1e-1, "log"), "criterion": ["gini", "entropy"]}
    a, b = SE.sampled(space, 8, 1), SE.sampled(space, 8, 1)
    assert a == b and len(a) == 8 and a != SE.sampled(space, 8, 2)
    assert all(1 <= c["max_depth"] <= 6 and 1e-4 <= c["min_impurity_decrease"] <= 1e-1 for c in a)
    assert len(SE.sampled({"x": [1, 2]}, 5, 1)) == 2


def test_halving_tries_the_better_half_on_more_folds(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("u"), (F.floor(F.col("id") / 2) % 2).alias("v"), (F.col("id") % 4).alias("fold"),
                                 ((F.col("id") % 2 == 1) != (F.floor(F.col("id") / 2) % 2 == 1)).cast("int").alias("y"))
    df = df.withColumn("fold", F.pmod(F.xxhash64(F.col("u") + F.monotonically_increasing_id()), F.lit(4)))
    out = {r["candidate"]: r for r in SE.random_search(df, ["u", "v"], "y", {"max_depth": [1, 3], "min_samples_leaf": [1, 2]}, n=4, eta=2, model_type="decision_tree", classification=True).collect()}
    assert sorted(r["folds"] for r in out.values()) == [1, 1, 2, 4]
    best = max(out.values(), key=lambda r: (r["folds"], r["score"]))
    assert "'max_depth': 3" in best["params"] or best["score"] < 1
