"""Numeric column builders (M1–M12). Null passes through; results that
Python/numpy give as NaN (division by zero, log of a non-positive value,
fractional power of a negative) are null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cirrus.functions.common import col


def _nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


SPLITTER = 134217729.0  # 2^27 + 1, Veltkamp split of a double


def _product_error(a: Column, b: float) -> Column:
    """Exact rounding error of the double product a·b (Dekker's
    two-product, plain IEEE arithmetic): a·b = fl(a·b) + error."""
    def split(x):
        c = x * F.lit(SPLITTER)
        hi = c - (c - x)
        return hi, x - hi
    ahi, alo = split(a)
    cb = SPLITTER * b
    bhi = cb - (cb - b)
    blo = b - bhi
    p = a * F.lit(b)
    return ((ahi * F.lit(bhi) - p) + ahi * F.lit(blo) + alo * F.lit(bhi)) + alo * F.lit(blo)


def round_even(c, decimals: int = 2) -> Column:
    """M1: Python `round(x, d)` — rounding of the EXACT binary value, ties to
    even. y = x·10^d is rounded with rint; when y lands exactly on a .5 the
    sign of the product's rounding error (Dekker two-product) decides, so
    2.675 → 2.67 as in Python (`bround` works on the decimal text and gives
    2.68)."""
    f = float(10 ** decimals)
    x = col(c).cast("double")
    if decimals >= 0:
        y = x * F.lit(f)
        fl = F.floor(y).cast("double")
        tie = (y - fl) == F.lit(0.5)
        err = _product_error(x, f)
        r = (F.when(tie & (err > 0), fl + 1.0).when(tie & (err < 0), fl).otherwise(F.rint(y)))
        return r / F.lit(f)
    g = float(10 ** (-decimals))
    return F.rint(x / F.lit(g)) * F.lit(g)


def _whole(x: Column, fn) -> Column:
    """`fn` (floor or ceil, a bigint in Spark) of a double; from 2^52 on every
    double is whole already and does not fit a bigint for long."""
    return F.when(F.abs(x) >= F.lit(float(1 << 52)), x).otherwise(fn(x).cast("double"))


def floor(c) -> Column:
    """M2."""
    return _whole(col(c).cast("double"), F.floor)


def ceil(c) -> Column:
    """M3."""
    return _whole(col(c).cast("double"), F.ceil)


def scale(c, factor: float = 1.0) -> Column:
    """M4 (M10 with factor 3.6: m/s → km/h)."""
    return col(c).cast("double") * F.lit(float(factor))


def ms_to_kmh(c) -> Column:
    """M10."""
    return scale(c, 3.6)


def clip(c, lo: float = -math.inf, hi: float = math.inf) -> Column:
    """M5: `least`/`greatest` skip nulls, so null is guarded explicitly."""
    x = col(c).cast("double")
    y = x
    if lo != -math.inf:
        y = F.greatest(y, F.lit(float(lo)))
    if hi != math.inf:
        y = F.least(y, F.lit(float(hi)))
    return F.when(x.isNotNull(), y)


def arithmetic(c, operation: str = "add", value: float = 0.0) -> Column:
    """M6/M7: add, subtract, multiply, divide (by 0 → null)."""
    x = col(c).cast("double")
    v = F.lit(float(value))
    if operation == "add":
        return x + v
    if operation == "subtract":
        return x - v
    if operation == "multiply":
        return x * v
    if operation == "divide":
        return F.try_divide(x, v) if value != 0 else F.lit(None).cast("double")
    raise ValueError(f"unknown arithmetic operation: {operation}")


def log(c, base: str = "natural") -> Column:
    """M8: natural / 10 / 2 logarithm; ≤ 0 → null."""
    x = col(c).cast("double")
    fn = {"natural": F.ln, "10": F.log10, "2": F.log2}[str(base)]
    return F.when(x > 0, fn(x))


def power(c, exponent: float = 2.0) -> Column:
    """M9."""
    return _nan_to_null(F.pow(col(c).cast("double"), F.lit(float(exponent))))


def truncate_decimals(c, decimals: int = 2) -> Column:
    """Toward zero for decimals ≥ 0; floor division for negative
    decimals (−15 with −1 → −20)."""
    x = col(c).cast("double")
    if decimals < 0:
        f = float(10 ** (-decimals))
        return _whole(x / F.lit(f), F.floor) * F.lit(f)
    f = float(10 ** decimals)
    y = x * F.lit(f)
    t = F.when(x < 0, _whole(y, F.ceil)).otherwise(_whole(y, F.floor))
    # a product at or beyond 2^52 has no decimals left to cut
    return F.when(F.abs(y) >= F.lit(float(1 << 52)), x).otherwise(t / F.lit(f))


def accuracy_band(c) -> Column:
    """≥ 90 high, ≥ 80 medium, else low."""
    x = col(c)
    return F.when(x >= 90, "high").when(x >= 80, "medium").when(x.isNotNull(), "low")


def apply(c, operation: str, **params) -> Column:
    """Dispatch of the numeric operations by name."""
    op = operation.lower()
    if op == "round":
        return round_even(c, params.get("decimals", 2))
    if op == "floor":
        return floor(c)
    if op == "ceil":
        return ceil(c)
    if op == "scale":
        return scale(c, params.get("factor", 1))
    if op == "clip":
        return clip(c, params.get("min", -math.inf), params.get("max", math.inf))
    if op == "arithmetic":
        return arithmetic(c, params.get("operation", "add"), params.get("value", 0))
    if op == "log":
        return log(c, params.get("base", "natural"))
    if op == "power":
        return power(c, params.get("exponent", 2))
    raise ValueError(f"unknown numeric operation: {operation}")
