"""Shared pieces of the registered queries.

Every registered query reads the driver's tables (whole tables, no row
caps) and returns a DataFrame; most have an equivalent SQL text that
DuckDB runs on the same Parquet files. Floating results are rounded in BOTH
with the same binary arithmetic, `floor(x·10^d + c) / 10^d` (c a fixed
offset just below one half), so the two engines agree on nearly identical
doubles, exact decimal ties included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from cirrus.functions.common import ROUND_OFFSET, round_half_up
from cirrus.sources.ingest import clean

DECIMALS = 6

Query = Callable[[SparkSession, str], DataFrame]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return clean(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def rnd(c: str | Column, d: int = DECIMALS) -> Column:
    return round_half_up(c, d)


def R(expr: str, d: int = DECIMALS) -> str:
    """SQL twin of `rnd`."""
    f = f"1e{d}"
    return f"(floor(({expr}) * {f} + {ROUND_OFFSET}) / {f})"


class Registry:
    """Collects (query, sql) pairs under a name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def deco(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"duplicate query name {name}")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn
        return deco


def PYROUND(expr: str, d: int) -> str:
    """SQL twin of `numeric.round_even` (same IEEE operations)."""
    f = float(10 ** d)
    sp = 134217729.0
    cb = sp * f
    bhi = cb - (cb - f)
    blo = f - bhi
    def dl(v: float) -> str:
        return f"CAST({v!r} AS DOUBLE)"
    x = f"CAST({expr} AS DOUBLE)"
    ahi = f"(({x} * {dl(sp)}) - (({x} * {dl(sp)}) - {x}))"
    alo = f"({x} - {ahi})"
    y = f"({x} * {dl(f)})"
    err = f"((({ahi} * {dl(bhi)} - {y}) + {ahi} * {dl(blo)} + {alo} * {dl(bhi)}) + {alo} * {dl(blo)})"
    fl = f"floor({y})"
    return (f"((CASE WHEN {y} - {fl} = 0.5 AND {err} > 0 THEN {fl} + 1.0 "
            f"WHEN {y} - {fl} = 0.5 AND {err} < 0 THEN {fl} ELSE round_even({y}, 0) END) / {dl(f)})")
