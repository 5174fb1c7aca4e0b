"""Exact quantiles, one path for every size (H3).

Rows are counted by the place of their value in sixteenths of octaves, a whole number of the
same order, with partial aggregation; the counts say which buckets hold the ranks that
linear interpolation needs, ⌊q·(n−1)⌋ and ⌈q·(n−1)⌉. Only rows between the least and the
largest value of such a bucket are looked at again: in PARTS equal parts of that range while
a bucket has many rows (every step narrows the range of what is left by that factor), and by
the values themselves once all have few (ENDS), which finds the ranks. A frequent value
is a bucket that needs no second look. So no value outside such a bucket is ever shuffled
and nothing is checkpointed; a step reads the columns again and passes on one row for each
bucket it met. Then lo + (hi − lo)·frac, the interpolation of pandas / `quantile_cont`.

What the next step needs is a row for each bucket that holds a rank: without groups as many
as columns times twice the quantiles, which come to the driver; with groups a table in the
shared folder, as there may be many. No estimate. `method="approx"` is
`percentile_approx`, the caller's choice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrus.sources.held import hold

#: Parts of an octave, parts of a bucket, and the rows of a bucket that end the search.
OCTAVE, PARTS, ENDS = 16, 4096, 1 << 16
#: Buckets above those of all numbers: magnitudes lie between 2^-1075 and 2^1024.
_OFFSET, _INFINITE, _NAN = 1100 * OCTAVE, 3000 * OCTAVE, 4000 * OCTAVE


def octave_bucket(x: Column) -> Column:
    """A whole number that grows with the double `x` and tells sixteenths of octaves apart: the
    logarithm is monotonic, so is what is made of it. The zeros are equal, NaN is the largest."""
    a = F.abs(x)
    place = F.floor(F.ln(a) * F.lit(OCTAVE / math.log(2.0))) + _OFFSET
    size = F.when(a == float("inf"), F.lit(_INFINITE)).otherwise(place).cast("long")
    return F.when(F.isnan(x), F.lit(_NAN).cast("long")).when(x == 0, F.lit(0).cast("long")).when(x < 0, -size).otherwise(size)


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by…, _ci, _v): number of the column and value of all values that are not null."""
    values = F.array(*[F.struct(F.lit(i).alias("_ci"), (F.col(c).try_cast("double") + 0.0).alias("_v")) for i, c in enumerate(cols)])
    return df.select(*by, F.inline(values)).where(F.col("_v").isNotNull())


def _counted(rows: DataFrame, key: list[str], bucket: Column) -> DataFrame:
    """Buckets of `rows`, with the rows before each in `key`."""
    b = rows.groupBy(*key, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # buckets of all numbers, PARTS + 1 or ENDS of them, in a window at most
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))


def _inside(ranks: Column) -> Column:
    """The ranks that lie in a bucket, counted from its first row."""
    here = F.filter(ranks, lambda s: (s["r"] >= F.col("_off")) & (s["r"] < F.col("_off") + F.col("_c")))
    return F.transform(here, lambda s: F.struct(s["q"].alias("q"), s["end"].alias("end"), (s["r"] - F.col("_off")).alias("r")))


def _first(rows: DataFrame, key: list[str], probs: Sequence[float]) -> DataFrame:
    """Buckets that hold a rank: (key…, _b, _c, _lo, _hi, _n, _s), _n rows of the key, _s the ranks."""
    n = F.sum("_c").over(Window.partitionBy(*key))
    ranks = [F.struct(F.lit(i).alias("q"), F.lit(end).alias("end"), of(F.lit(float(p)) * (F.col("_n") - 1).cast("double")).cast("long").alias("r"))
             for i, p in enumerate(probs) for end, of in ((0, F.floor), (1, F.ceil))]
    found = _counted(rows, key, octave_bucket(F.col("_v"))).withColumn("_n", n).withColumn("_s", _inside(F.array(*ranks)))
    return found.where(F.size("_s") > 0).select(*key, "_b", "_c", "_lo", "_hi", "_n", "_s")


def _next(rows: DataFrame, state: DataFrame, key: list[str], by_value: bool, part: DataFrame | None = None) -> DataFrame:
    """The same in the buckets of `state` only, by parts of their ranges or by value; `part` are
    the rows of `rows` in them, if they are known."""
    own = state.select(*[F.col(c).alias(f"_s_{c}") for c in key], F.col("_lo").alias("_p"), F.col("_hi").alias("_z"), "_n", "_s")
    same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in key]
    if part is None:
        part = rows.join(own.drop("_n", "_s"), [*same, F.col("_v") >= F.col("_p"), F.col("_v") <= F.col("_z")]).select(*key, "_v", "_p", "_z")
    bucket = F.col("_v") if by_value else F.floor((F.col("_v") - F.col("_p")) / (F.col("_z") - F.col("_p")) * PARTS).cast("double")
    found = _counted(part, [*key, "_p"], bucket).withColumnRenamed("_p", "_q")
    found = found.join(own, [*same, F.col("_q") == F.col("_p")]).withColumn("_s", _inside(F.col("_s")))
    return found.where(F.size("_s") > 0).select(*key, "_b", "_c", "_lo", "_hi", "_n", "_s")


def _settled(r) -> bool:
    return r["_lo"] == r["_hi"] or r["_lo"] != r["_lo"]


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """(by…, column, quantiles: array<double> in `probs` order) by ranks."""
    by, cols = list(by), list(cols)
    key = [*by, "_ci"]
    rows = _long(df, cols, by)
    found = _first(rows, key, probs)
    return _grouped(rows, found, key, by, cols, probs) if by else _whole(df, rows, found, cols, probs)


def _in_ranges(df: DataFrame, cols: list[str], left: list) -> DataFrame:
    """(_ci, _v, _p, _z): the values that lie in a bucket of `left`, and its ends."""
    columns = []
    for i, c in enumerate(cols):
        v = F.col(c).try_cast("double") + 0.0
        ends = [(r["_lo"], r["_hi"]) for r in left if r["_ci"] == i]
        if ends:
            low, high = (F.coalesce(*[F.when(v.between(*e), F.lit(e[side])) for e in ends]) for side in (0, 1))
            columns.append(F.struct(F.lit(i).alias("_ci"), v.alias("_v"), low.alias("_p"), high.alias("_z")))
    return df.select(F.inline(F.array(*columns))).where(F.col("_p").isNotNull())


def _whole(df: DataFrame, rows: DataFrame, found: DataFrame, cols: list[str], probs: Sequence[float]) -> DataFrame:
    spark, ends, sizes = rows.sparkSession, {}, {}
    while True:
        got = found.collect()  # at most a row for each column and rank
        for r in got:
            sizes[r["_ci"]] = r["_n"]
            for s in r["_s"] if _settled(r) else ():
                ends[r["_ci"], s["q"], s["end"]] = r["_lo"]
        left = [r for r in got if not _settled(r)]
        if not left:
            break
        # rows of the driver, as many as there are columns and ranks at most: a proven bound
        state = F.broadcast(spark.createDataFrame(left, found.schema).coalesce(1))
        found = _next(rows, state, ["_ci"], max(r["_c"] for r in left) <= ENDS, _in_ranges(df, cols, left))
    out = []
    for i, n in sorted(sizes.items()):
        at = [p * (n - 1) for p in probs]
        lo, hi = ([ends[i, q, end] for q in range(len(probs))] for end in (0, 1))
        out.append((cols[i], [a + (b - a) * (x - math.floor(x)) for a, b, x in zip(lo, hi, at)]))
    return spark.createDataFrame(out, "column string, quantiles array<double>").coalesce(1)


def _grouped(rows: DataFrame, found: DataFrame, key: list[str], by: list[str], cols: list[str], probs: Sequence[float]) -> DataFrame:
    done, settled, last = [], F.col("_lo").eqNullSafe(F.col("_hi")), False
    while not last:
        held = hold(found.drop("_b"), "ranks")
        done.append(held.where(settled))
        most = held.where(~settled).agg(F.max("_c")).first()[0]
        if most is None:
            break
        last = most <= ENDS
        found = _next(rows, held.where(~settled), key, by_value=last)
    if last:
        done.append(found.drop("_b"))  # by value: every rank is found
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    ends = every.select(*key, "_n", "_lo", F.explode("_s").alias("s")).groupBy(*key, "s.q").agg(
        F.max(F.when(F.col("s.end") == 0, F.col("_lo"))).alias("_a"), F.max(F.when(F.col("s.end") == 1, F.col("_lo"))).alias("_z"), F.max("_n").alias("_n"))
    at = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("q") + 1) * (F.col("_n") - 1).cast("double")
    value = F.col("_a") + (F.col("_z") - F.col("_a")) * (at - F.floor(at))
    # at most len(probs) rows per (group, column)
    out = ends.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("q", value.alias("v")))).alias("_all"))
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_ci") + 1)
    return out.select(*by, name.alias("column"), F.col("_all.v").alias("quantiles"))


def approx_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                     accuracy: int = 10000) -> DataFrame:
    """The same table by `percentile_approx`."""
    ps = [float(p) for p in probs]
    aggs = [F.percentile_approx(F.col(c).try_cast("double"), ps, accuracy).alias(f"q{i}")
            for i, c in enumerate(cols)]
    g = df.groupBy(*by).agg(*aggs)
    return g.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"q{i}").cast("array<double>").alias("quantiles"))
        for i, c in enumerate(cols)])))


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                   method: str = "exact") -> DataFrame:
    """(by…, column, quantiles) for every column; method "exact" or "approx". A column
    (or group) without values has no row."""
    if method not in ("exact", "approx"):
        raise ValueError(f"unknown quantile method: {method}")
    return (approx_quantiles if method == "approx" else exact_quantiles)(df, list(cols), probs, by)


def quantile_row(df: DataFrame, c: str, probs: Sequence[float], method: str = "exact") -> list | None:
    """The quantiles of one column as a Python list (a one-row result)."""
    r = quantile_table(df, [c], probs, method=method).first()
    return list(r["quantiles"]) if r and r["quantiles"] is not None else None
