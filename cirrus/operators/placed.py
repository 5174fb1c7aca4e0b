"""Runs of rows in a total order without ranking or moving the table first.

A bounded sample of the order columns, chosen by their hash, is sorted and cut; a row's
run is found by comparing its own order columns with the cuts (a binary search, one
projection for each step). So runs are known before any shuffle: small aggregates over the
narrow columns can say what a run hands to the next one, and the rows move once, to
their run. The cuts only balance the runs; any cuts give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the sample for each run.
PER_RUN = 64
RUN = "_run"


def order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in order])


def runs_of(df: DataFrame) -> int:
    """As many runs as the session has shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_points(df: DataFrame, order: Sequence[str], runs: int) -> list:
    """At most runs − 1 rows of the order columns, rising; PER_RUN · runs of them come to the driver."""
    narrow = df.select(*[F.col(f"`{c}`") for c in order])
    sample = narrow.orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in order])).limit(PER_RUN * runs)
    rows = sample.orderBy(*[F.col(f"`{c}`") for c in order]).collect()
    return [rows[i * len(rows) // runs] for i in range(1, runs) if len(rows) >= runs]


def place(df: DataFrame, order: Sequence[str], cuts: list) -> DataFrame:
    """`df` with RUN: the number of cuts that a row is not before."""
    if not cuts:
        return df.withColumn(RUN, F.lit(0))
    types = [df.schema[c].dataType for c in order]
    table = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in zip(order, r, types)]) for r in cuts])
    step, out = 1 << (len(cuts).bit_length() - 1), df.withColumn(RUN, F.lit(0))
    own = order_struct(order)
    while step:
        at = F.col(RUN) + step
        behind = (at <= len(cuts)) & (F.try_element_at(table, at) <= own)
        out = out.withColumn(RUN, F.col(RUN) + F.when(behind, step).otherwise(0))
        step >>= 1
    return out
