"""Ensemble votes and meta-features over class-probability columns (X6,
X7). Each model's output is an array<double> of class probabilities; every
vote is a higher-order array expression evaluated per row inside
whole-stage codegen (no UDF, no shuffle)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(arr: Column) -> Column:
    """0-based index of the largest entry (first one on ties)."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def _combine(arrays: Sequence[Column], weights: Sequence[Column]) -> Column:
    """Element-wise Σ w_k · p_k, summed left to right."""
    def scale(w: Column):
        return lambda x: x * w  # one-argument lambda: element only

    terms = [F.transform(a, scale(w)) for a, w in zip(arrays, weights)]
    return reduce(lambda acc, t: F.zip_with(acc, t, lambda x, y: x + y), terms)


def soft_mean(arrays: Sequence[Column]) -> Column:
    k = float(len(arrays))
    total = reduce(lambda acc, t: F.zip_with(acc, t, lambda x, y: x + y), list(arrays))
    return F.transform(total, lambda x: x / F.lit(k))


def hard_vote(arrays: Sequence[Column], n_classes: int) -> Column:
    """Majority of the models' argmax (smallest class on ties)."""
    votes = F.array(*[argmax(a) for a in arrays])
    counts = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)),
                         lambda c: F.size(F.filter(votes, lambda v: v == c)))
    return argmax(counts)


def soft_vote(arrays: Sequence[Column]) -> Column:
    """argmax of the mean probabilities."""
    return argmax(soft_mean(arrays))


def weighted_vote(arrays: Sequence[Column], weights: Sequence[float]) -> Column:
    """argmax of the weighted sum of probabilities."""
    return argmax(_combine(arrays, [F.lit(float(w)) for w in weights]))


def confidence_vote(arrays: Sequence[Column]) -> Column:
    """Each model weighted by its own top probability."""
    return argmax(_combine(arrays, [F.array_max(a) for a in arrays]))


def cascade_vote(arrays: Sequence[Column], threshold: float = 0.6) -> Column:
    """The first model whose top probability reaches `threshold` decides;
    otherwise the soft vote."""
    out = soft_vote(arrays)
    for a in reversed(list(arrays)):
        out = F.when(F.array_max(a) >= F.lit(threshold), argmax(a)).otherwise(out)
    return out


def meta_features(arrays: Sequence[Column], n_classes: int) -> dict[str, Column]:
    """Top probability and entropy of the mean distribution, and the
    share of models agreeing with the hard vote."""
    mean = soft_mean(arrays)
    entropy = F.aggregate(F.filter(mean, lambda p: p > 0), F.lit(0.0), lambda acc, p: acc - p * F.ln(p))
    hard = hard_vote(arrays, n_classes)
    agree = reduce(lambda x, y: x + y, [(argmax(a) == hard).cast("int") for a in arrays])
    return {"max_probability": F.array_max(mean), "entropy": entropy,
            "agreement": agree.cast("double") / F.lit(float(len(arrays)))}
