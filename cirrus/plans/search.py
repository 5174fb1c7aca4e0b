"""Choosing a model: the L1 path with cross-validation (X4) and random search.

The path needs one pass over the rows: each fold's sums of squares and products say
everything about a linear fit on any set of folds and about its error on any other, so
every λ and every fold is solved and scored from these small matrices in the driver.
Random search draws its candidates from a seed, holds the assembled rows once and drops the
worse part of the candidates after each round of folds (successive halving).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrus.plans.train import _encoded, assemble, estimator
from cirrus.sources.held import hold

#: Features whose products the driver holds, for each fold.
MAX_FEATURES = 2000


def fold_products(df: DataFrame, features: Sequence[str], target: str, fold: str) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """For each fold the matrix ZᵀZ of Z = [1, features, target] less `centre` (their means over
    all rows), and the centre. Rows with a missing value are left out."""
    names = [*features, target]
    if len(features) > MAX_FEATURES:
        raise ValueError(f"{len(features)} features: the products of {MAX_FEATURES} are held at most")
    rows = df.select(F.col(fold).cast("int").alias("_f"), *[F.col(f"`{c}`").try_cast("double").alias(f"_{i}") for i, c in enumerate(names)]).na.drop()
    centre = np.array(rows.agg(*[F.avg(f"_{i}") for i in range(len(names))]).first(), float)  # nulls, as NaN, for no rows

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            z = np.column_stack([np.ones(len(k)), *(c.to_numpy(zero_copy_only=False) for c in b.columns[1:])])
            z[:, 1:] -= centre
            for f in np.unique(k).tolist():
                part = z[k == f]
                total[f] = total.get(f, 0) + part.T @ part
        for f, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()), pa.array(m.tolist(), pa.list_(pa.float64()))], names=["f", "i", "v"])

    parts = rows.mapInArrow(own, "f int, i int, v array<double>").select("f", "i", F.posexplode("v").alias("j", "x"))
    out: dict[int, np.ndarray] = {}
    for r in parts.groupBy("f", "i", "j").agg(F.sum("x").alias("x")).toArrow().to_pylist():  # folds · (features + 2)²
        out.setdefault(r["f"], np.zeros((len(names) + 1,) * 2))[r["i"], r["j"]] = r["x"]
    return out, centre


def _standard(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Correlations of the features with each other and covariances of the standardised features
    with the target, means, standard deviations (ddof 0, 1 for a constant) and the target's mean."""
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    c = m[1:, 1:] / n - np.outer(mean, mean)
    var = np.diag(c)[:-1]
    scale = np.sqrt(np.where(var > 1e-12 * np.maximum(1e-300, np.diag(m)[1:-1] / n), var, 0.0))
    used = np.where(scale > 0, scale, 1.0)
    live = scale > 0
    return c[:-1, :-1] / np.outer(used, used) * np.outer(live, live), c[:-1, -1] / used * live, mean[:-1], used, float(mean[-1])


def lasso(gram: np.ndarray, with_y: np.ndarray, reg: float, start: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """argmin of bᵀGb/2 − bᵀg + λ|b|₁ by cyclic coordinate descent from `start`."""
    b, diagonal = start.copy(), np.diag(gram)
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero(diagonal > 0):
            r = with_y[j] - gram[j] @ b + diagonal[j] * b[j]
            new = math.copysign(max(abs(r) - reg, 0.0), r) / diagonal[j]
            moved = max(moved, abs(new - b[j]))
            b[j] = new
        if moved < 1e-12 * (1 + np.abs(b).max()):
            break
    return b


def lasso_path(df: DataFrame, features: Sequence[str], target: str, lambdas: Sequence[float] | None = None, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """X4 with cross-validation: (reg, mse, std, features_used) for each λ, mean and standard
    deviation (ddof 0) of the folds' errors, and (feature, coefficient) of standardised features at
    the λ of least error, fitted on all rows. The default λs fall from the least that leaves
    no feature to a thousandth of it."""
    features, spark = list(features), df.sparkSession
    folds, _ = fold_products(df, features, target, fold)
    if len(folds) < 2:
        raise ValueError("cross-validation needs two folds with rows")
    everything = sum(folds.values())
    gram, with_y, *_ = _standard(everything)
    if lambdas is None:
        top = float(np.abs(with_y).max()) if len(features) else 0.0
        lambdas = np.geomspace(max(top, 1e-12), max(top, 1e-12) / 1000, 30).tolist()
    order = sorted({float(x) for x in lambdas}, reverse=True)
    errors = {x: [] for x in order}
    for f in sorted(folds):
        g, gy, mean, scale, mean_y = _standard(everything - folds[f])
        b, own = np.zeros(len(features)), folds[f]
        for x in order:  # each λ starts from the solution of the one before
            b = lasso(g, gy, x, b)
            weight = np.concatenate([[-(mean_y - (b / scale) @ mean)], -(b / scale), [1.0]])  # of 1, features, target: the residual
            errors[x].append(float(weight @ own @ weight / own[0, 0]))
    b, fits = np.zeros(len(features)), {}
    for x in order:
        b = fits[x] = lasso(gram, with_y, x, b)
    rows = [(x, float(np.mean(errors[x])), float(np.std(errors[x])), int((fits[x] != 0).sum())) for x in order]
    best = min(rows, key=lambda r: (r[1], -r[0]))[0]
    path = spark.createDataFrame(rows, "reg double, mse double, std double, features_used int")
    return path, spark.createDataFrame([(c, float(v), best) for c, v in zip(features, fits[best])], "feature string, coefficient double, reg double")


def sampled(space: dict, n: int, seed: int) -> list[dict]:
    """`n` different candidates from lists of values, (low, high) ranges of whole or real numbers, or
    (low, high, "log"); fewer if there are no more."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(50 * n):
        pick = {}
        for k, v in space.items():
            if isinstance(v, tuple):
                low, high = v[:2]
                x = math.exp(rng.uniform(math.log(low), math.log(high))) if len(v) > 2 else rng.uniform(low, high)
                pick[k] = int(rng.integers(low, high + 1)) if isinstance(low, int) and isinstance(high, int) and len(v) == 2 else float(x)
            else:
                pick[k] = v[int(rng.integers(len(v)))]
        if pick not in out:
            out.append(pick)
        if len(out) == n:
            break
    return out


def random_search(df: DataFrame, features: Sequence[str], target: str, space: dict, n: int = 9, fold: str = "fold",
                  model_type: str = "random_forest", classification: bool = False, eta: int = 3, seed: int = 42) -> DataFrame:
    """(candidate, params, folds, score) of `n` drawn candidates; score is accuracy or −MSE, the mean
    over the folds that the candidate was tried on. After each round the best 1/`eta` go on
    to `eta` times as many of the folds, all on the same ones; the last round has them all."""
    from cirrus.operators import evaluate as EV
    data, _ = _encoded(df, target)
    rows = hold(assemble(features).transform(data.where(F.col("label").isNotNull())).select("features", "label", F.col(fold).alias("_f")), "assembled")
    folds = sorted(r[0] for r in rows.select("_f").distinct().collect())
    n_classes = int(rows.agg(F.max("label")).first()[0] or 1) + 1 if classification else 0
    picks = sampled(space, n, seed)
    scores: dict[int, list[float]] = {i: [] for i in range(len(picks))}

    def tried(params: dict, k) -> float:
        model = Pipeline(stages=[estimator(model_type, classification, params, n_classes)]).fit(rows.where(F.col("_f") != k))
        p = model.transform(rows.where(F.col("_f") == k))
        if classification:
            return float(EV.classification_metrics(p, "label", "prediction").first()["accuracy"])
        return -float(EV.regression_metrics(p, "label", "prediction").first()["mse"])

    rounds = math.ceil(math.log(max(1, len(picks)), eta)) if eta > 1 else 0  # with eta 1 nobody is dropped
    alive, used = list(scores), max(1, len(folds) // max(1, eta) ** rounds)
    while True:
        for i in alive:
            scores[i] += [tried(picks[i], k) for k in folds[len(scores[i]):used]]
        if used >= len(folds):
            break
        alive = sorted(alive, key=lambda i: (-np.mean(scores[i]), i))[:max(1, -(-len(alive) // eta))]
        used = min(len(folds), used * eta)
    return df.sparkSession.createDataFrame([(i, str(picks[i]), len(s), float(np.mean(s))) for i, s in scores.items()], "candidate int, params string, folds int, score double")
