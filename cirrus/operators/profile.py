"""Column profiles.

Every profile is built as ONE aggregate over all requested columns (partial
aggregation on the map side, one small final stage) and then turned into a
long table with one row per column by exploding an array of structs — never a
per-column loop of jobs and never a collect of data rows.

Exact quartiles (the linear interpolation of pandas and `quantile_cont`) come
from `quantiles.quantile_table`: counts of distinct values and their running
count over range partitions; `exact=False` switches to `percentile_approx`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrus.functions.common import col, numeric_columns, tcast
from cirrus.functions.numeric import round_even

QUARTILES = [0.25, 0.5, 0.75]


def corrected_skewness(g1: Column, n: Column) -> Column:
    """A2: bias-corrected sample skewness from Spark's population form."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(g2: Column, n: Column) -> Column:
    """A2: bias-corrected excess kurtosis from Spark's population form."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def summary(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = (),
            exact: bool = True, accuracy: int = 10000, moments: bool = False,
            quantile_method: str = "exact") -> DataFrame:
    """A1 (+A2 with `moments`): count, mean, std (ddof 1), min, q1, median,
    q3, max per column (and per group of `by`), one row per (group, column).
    Moments come from one aggregate; quartiles from `quantile_table` (exact, by ranks)."""
    from cirrus.operators.quantiles import quantile_table
    by = list(by)
    cols = list(cols) if cols else numeric_columns(df, exclude=by)
    aggs = []
    for i, c in enumerate(cols):
        x = tcast(F.col(c), "double")  # text that does not parse counts as missing
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                 F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
        if moments:
            aggs += [F.skewness(x).alias(f"sk{i}"), F.kurtosis(x).alias(f"ku{i}")]
    method = quantile_method if exact else "approx"
    grouped = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        fields = [F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"mean{i}").alias("mean"),
                  F.col(f"std{i}").alias("std"), F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max")]
        if moments:
            n = F.col(f"n{i}").cast("double")
            fields += [corrected_skewness(F.col(f"sk{i}"), n).alias("skewness"),
                       corrected_kurtosis(F.col(f"ku{i}"), n).alias("kurtosis")]
        rows.append(F.struct(*fields))
    base = grouped.select(*by, F.inline(F.array(*rows)))
    q = quantile_table(df, cols, QUARTILES, by, method)
    q = q.select(*[F.col(b).alias(f"_qb_{b}") for b in by], F.col("column").alias("_qc"), "quantiles")
    on = [F.col("column") == F.col("_qc")] + [F.col(b).eqNullSafe(F.col(f"_qb_{b}")) for b in by]
    # one row per (group, column) on both sides
    j = base.join(q, on, "left")
    extra = ["skewness", "kurtosis"] if moments else []
    return j.select(*by, "column", "count", "mean", "std", "min", F.col("quantiles")[0].alias("q1"),
                    F.col("quantiles")[1].alias("median"), F.col("quantiles")[2].alias("q3"), "max", *extra)


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A3: null count and % of rows per column (one pass)."""
    cols = list(cols) if cols else df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"z{i}") for i, c in enumerate(cols)])
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"z{i}").alias("null_count"),
                 (F.try_divide(F.col(f"z{i}") * 100.0, F.col("_rows"))).alias("null_pct"))
        for i, c in enumerate(cols)])))


def missing_table(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A4/K6: columns that have nulls, sorted by count descending."""
    return (null_counts(df, cols).filter(F.col("null_count") > 0)
            .orderBy(F.desc("null_count"), "column"))


def total_nulls(df: DataFrame) -> DataFrame:
    """A3 total: nulls over the whole table."""
    return null_counts(df).agg(F.sum("null_count").alias("total_nulls"))


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False,
                    rsd: float = 0.01) -> DataFrame:
    """A5: distinct non-null values per column."""
    cols = list(cols) if cols else df.columns
    fn = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    agg = df.agg(*[fn(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(cols)])
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct_count"))
        for i, c in enumerate(cols)])))


def duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows identical to an earlier row (nulls compare equal). Grouping
    pre-aggregates on the map side; only group counts are shuffled."""
    keys = list(subset) if subset else df.columns
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def distinct_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row of each set of rows that are equal (in `subset`)."""
    return df.dropDuplicates(list(subset) if subset else None)


def value_counts(df: DataFrame, c: str, k: int | None = None) -> DataFrame:
    """Value frequencies (nulls excluded), most frequent first; ties
    ordered by value. `k` keeps the top k (TakeOrderedAndProject)."""
    out = (df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("count"))
             .orderBy(F.desc("count"), F.asc(c)))
    return out.limit(k) if k else out


def frequency_table(df: DataFrame, c: str, k: int = 100) -> DataFrame:
    """Value (as text), count, % of all rows (2 decimals), with a
    trailing `null` row when the column has nulls; first `k` rows."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    counts = df.groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("count"))
    # one-row table of the total: a proven size bound for the broadcast
    t = counts.crossJoin(F.broadcast(total))
    t = t.select(
        F.coalesce(F.col("_v").cast("string"), F.lit("null")).alias("value"),
        F.col("count"),
        round_even(F.col("count") * 100.0 / F.col("_total"), 2).alias("percentage"),
        F.col("_v").isNull().cast("int").alias("_is_null"),
        F.col("_v").alias("_order_v"))
    return (t.orderBy("_is_null", F.desc("count"), "_order_v").limit(k)
             .drop("_is_null", "_order_v"))


def minmax(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.min(F.col(c).cast("double")).alias("_lo"), F.max(F.col(c).cast("double")).alias("_hi"))


def bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin of x on [lo, hi]; the last bin is closed; a constant
    range puts everything in the middle bin as numpy does for lo == hi."""
    width = (hi - lo) / F.lit(float(bins))
    raw = F.floor(F.try_divide(x - lo, width))
    return F.when(hi == lo, F.lit(bins // 2)).otherwise(
        F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))).cast("int")


def histogram(df: DataFrame, c: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram with edges; every bin appears (count 0 when
    empty). Range from one aggregate, bins from a `groupBy` on the bin
    number, missing bins from `range(bins)`."""
    x = F.col(c).cast("double")
    data = df.select(x.alias("_x")).filter(F.col("_x").isNotNull())
    rng = minmax(data.withColumnRenamed("_x", c), c)
    # numpy widens a zero range to [v-0.5, v+0.5]
    rng = rng.select(F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
                     F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    counted = (data.crossJoin(F.broadcast(rng))
                   .groupBy(bin_index(F.col("_x"), F.col("_lo"), F.col("_hi"), bins).alias("bin"))
                   .agg(F.count(F.lit(1)).alias("count")))
    frame = data.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(rng))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return (frame.join(counted, "bin", "left")
                 .select("bin",
                         (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
                         F.when(F.col("bin") == bins - 1, F.col("_hi"))
                          .otherwise(F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"),
                         F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def iqr_bounds(df: DataFrame, c: str, k: float = 1.5, exact: bool = True, method=None) -> DataFrame:
    """One-row table: q1, q3, iqr, lower, upper for the IQR rule with factor k."""
    from cirrus.operators.quantiles import quantile_table
    q = quantile_table(df, [c], [0.25, 0.75], method=method or ("exact" if exact else "approx"))
    return q.select(F.col("quantiles")[0].alias("q1"), F.col("quantiles")[1].alias("q3")).select(
        "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"),
        (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lower_bound"),
        (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("upper_bound"))


def outlier_summary(df: DataFrame, c: str, k: float = 1.5) -> DataFrame:
    """Outlier count and %, bounds, quartiles, below/above counts,
    plus min/max/median of the non-null values."""
    from cirrus.operators.quantiles import quantile_table
    q = quantile_table(df, [c], [0.25, 0.5, 0.75]).select(
        F.col("quantiles")[0].alias("q1"), F.col("quantiles")[1].alias("median"), F.col("quantiles")[2].alias("q3"))
    b = q.select("q1", "q3", "median", (F.col("q3") - F.col("q1")).alias("iqr"),
                 (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lower_bound"),
                 (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("upper_bound"))
    x = F.col(c).cast("double")
    j = df.select(x.alias("_x")).filter(F.col("_x").isNotNull()).crossJoin(F.broadcast(b))  # one-row table
    return j.groupBy("q1", "q3", "iqr", "lower_bound", "upper_bound", "median").agg(
        F.count(F.lit(1)).alias("non_null"),
        F.count_if(F.col("_x") < F.col("lower_bound")).alias("below"),
        F.count_if(F.col("_x") > F.col("upper_bound")).alias("above"),
        F.min("_x").alias("min"), F.max("_x").alias("max"),
    ).select("*", (F.col("below") + F.col("above")).alias("outlier_count"),
             ((F.col("below") + F.col("above")) * 100.0 / F.col("non_null")).alias("outlier_pct"))


def outlier_rows(df: DataFrame, c: str, k: float = 1.5, order_by: str | None = None,
                 limit: int | None = None) -> DataFrame:
    """The rows outside [q1 - k·iqr, q3 + k·iqr]; `limit` keeps
    the first ones in `order_by` order (A13: 50, A17: 20)."""
    b = iqr_bounds(df, c, k).select("lower_bound", "upper_bound")
    x = F.col(c).cast("double")
    out = (df.crossJoin(F.broadcast(b))
             .filter((x < F.col("lower_bound")) | (x > F.col("upper_bound")))
             .drop("lower_bound", "upper_bound"))
    if order_by:
        out = out.orderBy(order_by)
    return out.limit(limit) if limit else out


def outlier_map(df: DataFrame, c: str, k: float = 1.5, order_by: Sequence[str] = (), n: int = 20) -> DataFrame:
    """One row: outlier count and %, bounds, and the first n outlying
    values in `order_by` order as an array."""
    s = outlier_summary(df, c, k).select("lower_bound", "upper_bound", "outlier_count", "outlier_pct")
    first = outlier_rows(df.select(*order_by, c), c, k, list(order_by) or None, n)
    # n rows at most
    values = first.agg(F.array_sort(F.collect_list(F.struct(*order_by, F.col(c).cast("double").alias("_v")))).alias("_a"))
    return s.crossJoin(values).select(*s.columns, F.col("_a._v").alias("values"))


def iqr_filter(df: DataFrame, c: str, k: float = 1.5, method=None) -> DataFrame:
    """keep rows whose value lies inside the IQR fences (inclusive)."""
    b = iqr_bounds(df, c, k, method=method).select("lower_bound", "upper_bound")
    x = F.col(c).cast("double")
    return (df.crossJoin(F.broadcast(b))
              .filter(x.between(F.col("lower_bound"), F.col("upper_bound")))
              .drop("lower_bound", "upper_bound"))


def histogram_without_outliers(df: DataFrame, c: str, bins: int = 20) -> DataFrame:
    """Histogram after the F4 filter."""
    return histogram(iqr_filter(df.select(c).filter(F.col(c).isNotNull()), c), c, bins)


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A10: pairwise-complete Pearson r, long form (var1, var2, r), all
    ordered pairs including the diagonal, in one pass for any number of columns
    (see `comoments`). A column that is constant where the other has values gives
    null, as do pairs with fewer than two common rows."""
    from cirrus.operators.comoments import correlations
    return correlations(df, list(cols) if cols else numeric_columns(df))


def strong_correlations(df: DataFrame, cols=None, threshold: float = 0.7) -> DataFrame:
    """Pairs (var1 < var2 in column order) with |r| > threshold."""
    cols = list(cols) if cols else numeric_columns(df)
    pos = {c: i for i, c in enumerate(cols)}
    m = correlation_matrix(df, cols)
    order = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(pos[c]))])
    return m.filter((order[F.col("var1")] < order[F.col("var2")]) & (F.abs("r") > threshold))


def top_correlations(df: DataFrame, cols=None, threshold: float = 0.5, k: int = 10) -> DataFrame:
    """Pairs with |r| > threshold (null r counts as 0), strongest
    first, top k."""
    cols = list(cols) if cols else numeric_columns(df)
    pos = {c: i for i, c in enumerate(cols)}
    order = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(pos[c]))])
    m = correlation_matrix(df, cols).withColumn("r", F.coalesce("r", F.lit(0.0)))
    return (m.filter((order[F.col("var1")] < order[F.col("var2")]) & (F.abs("r") > threshold))
             .orderBy(F.desc(F.abs("r")), order[F.col("var1")], order[F.col("var2")]).limit(k))


def column_report(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Per numeric column, A1 + A3 + A5 + outlier counts: the summary, one
    aggregate of distinct counts, and one of the nulls and the values outside
    the fences, which lie in a one-row table."""
    cols = list(cols) if cols else numeric_columns(df)
    s = summary(df, cols)
    d = distinct_counts(df, cols)
    lo = F.col("q1") - k * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + k * (F.col("q3") - F.col("q1"))
    fences = s.agg(*[F.max(F.when(F.col("column") == c, e)).alias(f"_{n}{i}")
                     for i, c in enumerate(cols) for n, e in (("lo", lo), ("hi", hi))])
    one = df.select(*cols).crossJoin(F.broadcast(fences)).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[x for i, c in enumerate(cols) for x in (
            F.count_if(F.col(c).isNull()).alias(f"z{i}"),
            F.count_if((F.col(c).cast("double") < F.col(f"_lo{i}")) | (F.col(c).cast("double") > F.col(f"_hi{i}"))).alias(f"o{i}"))])
    rest = one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"z{i}").alias("null_count"),
                 F.try_divide(F.col(f"z{i}") * 100.0, F.col("_rows")).alias("null_pct"),
                 F.col(f"o{i}").alias("outlier_count")) for i, c in enumerate(cols)])))
    return s.join(rest, "column").join(d, "column")


def running_mean(df: DataFrame, value: str, order: str, partition: Sequence[str] = ()) -> DataFrame:
    """Running mean of `value` in `order` (for fold scores: a handful of
    rows per run)."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_mean", F.avg(value).over(w))
