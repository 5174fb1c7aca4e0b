"""Registered profile queries (A1–A21, F4, Z2 flagship)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cirrus.operators import normalize as Z
from cirrus.operators import profile as A
from cirrus.operators.quantiles import quantile_table
from cirrus.registry.base import PYROUND, R, Registry, load, rnd

reg = Registry()

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SUMMARY_COLS = ["count", "mean", "std", "min", "q1", "median", "q3", "max"]


def _round_cols(df, cols, d=6):
    return df.withColumns({c: rnd(c, d) for c in cols})


def _summary_sql(table: str, cols: list[str], where: str = "", moments: bool = False) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        extra = ""
        if moments:
            extra = f", {R(f'skewness({x})')} AS skewness, {R(f'kurtosis({x})')} AS kurtosis"
        parts.append(
            f"SELECT '{c}' AS \"column\", count({x}) AS count, {R(f'avg({x})')} AS mean, "
            f"{R(f'stddev_samp({x})')} AS std, {R(f'min({x})')} AS min, "
            f"{R(f'quantile_cont({x}, 0.25)')} AS q1, {R(f'quantile_cont({x}, 0.5)')} AS median, "
            f"{R(f'quantile_cont({x}, 0.75)')} AS q3, {R(f'max({x})')} AS max{extra} FROM {table} {where}")
    return " UNION ALL ".join(parts)


# ---------------------------------------------------------------- flagship
FLAGSHIP_SQL = f"""
WITH b AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3
           FROM lineitem),
f AS (SELECT l.* FROM lineitem l, b
      WHERE l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
s AS (SELECT avg(l_quantity) AS mu, stddev_pop(l_quantity) AS sd FROM f),
z AS (SELECT l_returnflag, (l_quantity - mu) / sd AS zq, l_extendedprice FROM f, s)
SELECT l_returnflag, count(*) AS n,
       {R('avg(zq)')} AS zq_mean, {R('stddev_samp(zq)')} AS zq_std,
       {R('quantile_cont(zq, 0.25)')} AS zq_q1, {R('quantile_cont(zq, 0.5)')} AS zq_median,
       {R('quantile_cont(zq, 0.75)')} AS zq_q3,
       {R('avg(l_extendedprice)', 4)} AS price_mean, {R('quantile_cont(l_extendedprice, 0.5)', 4)} AS price_median
FROM z GROUP BY l_returnflag
"""


def flagship(spark, sf):
    """read → IQR filter of l_extendedprice (F4) → z-score of l_quantity
    fitted on the kept rows (Z2) → per-returnflag profile (A1)."""
    li = load(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    kept = A.iqr_filter(li, "l_extendedprice")
    # lazy fit: the z-score statistics are a one-row frame inside the same plan
    z = Z.apply_stats(kept, Z.stats_frame(kept, ["l_quantity"], Z.Z_SCORE), ["l_quantity"], Z.Z_SCORE)
    z = z.withColumnRenamed("l_quantity", "zq")
    out = z.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.avg("zq").alias("zq_mean"), F.stddev_samp("zq").alias("zq_std"),
        F.avg("l_extendedprice").alias("price_mean"))
    q = quantile_table(z, ["zq", "l_extendedprice"], [0.25, 0.5, 0.75], by=["l_returnflag"])
    q = q.groupBy("l_returnflag").agg(  # two rows per flag → one
        F.max(F.when(F.col("column") == "zq", F.col("quantiles"))).alias("_q"),
        F.max(F.when(F.col("column") == "l_extendedprice", F.col("quantiles"))).alias("_p"))
    out = out.join(q, out.l_returnflag.eqNullSafe(q.l_returnflag)).drop(q.l_returnflag)
    return out.select(
        "l_returnflag", "n", rnd("zq_mean").alias("zq_mean"), rnd("zq_std").alias("zq_std"),
        rnd(F.col("_q")[0]).alias("zq_q1"), rnd(F.col("_q")[1]).alias("zq_median"),
        rnd(F.col("_q")[2]).alias("zq_q3"), rnd("price_mean", 4).alias("price_mean"),
        rnd(F.col("_p")[1], 4).alias("price_median"))


reg.add("flagship_iqr_zscore_profile", FLAGSHIP_SQL)(flagship)


# ---------------------------------------------------------------- A1, A2
@reg.add("a1_summary_lineitem", _summary_sql("lineitem", LI_NUM))
def a1_summary(spark, sf):
    return _round_cols(A.summary(load(spark, sf, "lineitem"), LI_NUM), SUMMARY_COLS[1:])


@reg.add("a2_moments_lineitem", _summary_sql("lineitem", LI_NUM, moments=True))
def a2_moments(spark, sf):
    s = A.summary(load(spark, sf, "lineitem"), LI_NUM, moments=True)
    return _round_cols(s, SUMMARY_COLS[1:] + ["skewness", "kurtosis"])


A1_GROUPED_SQL = " UNION ALL ".join(
    f"SELECT l_returnflag, l_linestatus, '{c}' AS \"column\", count({c}) AS count, {R(f'avg({c})')} AS mean, "
    f"{R(f'stddev_samp({c})')} AS std, {R(f'min({c})')} AS min, {R(f'quantile_cont({c}, 0.25)')} AS q1, "
    f"{R(f'quantile_cont({c}, 0.5)')} AS median, {R(f'quantile_cont({c}, 0.75)')} AS q3, {R(f'max({c})')} AS max "
    f"FROM lineitem GROUP BY l_returnflag, l_linestatus" for c in ["l_quantity", "l_extendedprice"])


@reg.add("a1_summary_by_group", A1_GROUPED_SQL)
def a1_grouped(spark, sf):
    s = A.summary(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"],
                  by=["l_returnflag", "l_linestatus"])
    return _round_cols(s, SUMMARY_COLS[1:])


# ---------------------------------------------------------------- A3, A4, A5
EVENTS_WITH_NULLS = """(SELECT event_id, ts, user_id,
       CASE WHEN event_id % 13 <> 0 THEN event_type END AS event_type,
       CASE WHEN event_id % 7 <> 0 THEN value END AS value,
       CASE WHEN event_id % 11 <> 0 THEN props END AS props FROM events)"""


def events_with_nulls(spark, sf):
    e = load(spark, sf, "events")
    return e.select("event_id", "ts", "user_id",
                    F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("event_type"),
                    F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
                    F.when(F.col("event_id") % 11 != 0, F.col("props")).alias("props"))


EV_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
A3_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count_if({c} IS NULL) AS BIGINT) AS null_count, "
    f"count_if({c} IS NULL) * 100.0 / count(*) AS null_pct FROM {EVENTS_WITH_NULLS}" for c in EV_COLS)


@reg.add("a3_null_counts", f"SELECT \"column\", null_count, {R('null_pct')} AS null_pct FROM ({A3_SQL})")
def a3_nulls(spark, sf):
    return A.null_counts(events_with_nulls(spark, sf)).withColumn("null_pct", rnd("null_pct"))


@reg.add("a4_missing_table",
         f"SELECT \"column\", null_count, {R('null_pct')} AS null_pct FROM ({A3_SQL}) WHERE null_count > 0")
def a4_missing(spark, sf):
    return A.missing_table(events_with_nulls(spark, sf)).withColumn("null_pct", rnd("null_pct"))


@reg.add("a3_total_nulls",
         f"SELECT CAST(sum(null_count) AS BIGINT) AS total_nulls FROM ({A3_SQL})")
def a3_total(spark, sf):
    return A.total_nulls(events_with_nulls(spark, sf)).select(F.col("total_nulls").cast("long"))


@reg.add("a5_distinct_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM {EVENTS_WITH_NULLS}"
    for c in EV_COLS))
def a5_distinct(spark, sf):
    return A.distinct_counts(events_with_nulls(spark, sf))


# ---------------------------------------------------------------- A6, A7, A8
@reg.add("a6_duplicate_rows", """SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows
    FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount)""")
def a6_dups(spark, sf):
    li = load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    return A.duplicate_rows(li)


@reg.add("a6_duplicate_full_rows", """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_rows
    FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 3 = 0)""")
def a6_full(spark, sf):
    li = load(spark, sf, "lineitem")
    return A.duplicate_rows(li.unionByName(li.filter(F.col("l_orderkey") % 3 == 0)))


@reg.add("a6_duplicate_rows_with_nulls", f"""SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows
    FROM (SELECT count(*) AS c FROM {EVENTS_WITH_NULLS} GROUP BY user_id, event_type)""")
def a6_dups_nulls(spark, sf):
    return A.duplicate_rows(events_with_nulls(spark, sf).select("user_id", "event_type"))


@reg.add("a7_value_counts_top10", """SELECT p_brand, count(*) AS count FROM part WHERE p_brand IS NOT NULL
    GROUP BY p_brand ORDER BY count DESC, p_brand LIMIT 10""")
def a7_top(spark, sf):
    return A.value_counts(load(spark, sf, "part"), "p_brand", 10)


@reg.add("a7_value_counts_all", """SELECT p_type, count(*) AS count FROM part WHERE p_type IS NOT NULL
    GROUP BY p_type""")
def a7_all(spark, sf):
    return A.value_counts(load(spark, sf, "part"), "p_type")


@reg.add("a8_frequency_table", f"""
    WITH t AS (SELECT count(*) AS total FROM {EVENTS_WITH_NULLS}),
    g AS (SELECT event_type AS v, count(*) AS count FROM {EVENTS_WITH_NULLS} GROUP BY event_type)
    SELECT coalesce(CAST(v AS VARCHAR), 'null') AS value, count,
           {PYROUND('count * 100.0 / total', 2)} AS percentage
    FROM g, t ORDER BY (v IS NULL), count DESC, v LIMIT 100""")
def a8_freq(spark, sf):
    return A.frequency_table(events_with_nulls(spark, sf), "event_type", 100)


# ---------------------------------------------------------------- A9, A15
def _hist_sql(table: str, c: str, bins: int) -> str:
    return f"""
    WITH d AS (SELECT CAST({c} AS DOUBLE) AS x FROM {table} WHERE {c} IS NOT NULL),
    r0 AS (SELECT min(x) AS lo, max(x) AS hi FROM d),
    r AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo,
                 CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM r0),
    c AS (SELECT CAST(least(greatest(floor((x - lo) / ((hi - lo) / {float(bins)})), 0), {bins - 1}) AS INTEGER) AS bin,
                 count(*) AS n FROM d, r GROUP BY 1),
    f AS (SELECT CAST(range AS INTEGER) AS bin FROM range({bins}))
    SELECT f.bin, lo + f.bin * ((hi - lo) / {float(bins)}) AS bin_start,
           CASE WHEN f.bin = {bins - 1} THEN hi ELSE lo + (f.bin + 1) * ((hi - lo) / {float(bins)}) END AS bin_end,
           CAST(coalesce(c.n, 0) AS BIGINT) AS count
    FROM f CROSS JOIN r LEFT JOIN c ON f.bin = c.bin"""


def _hist_round(df):
    return df.withColumns({"bin_start": rnd("bin_start", 4), "bin_end": rnd("bin_end", 4)})


def _hist_round_sql(sql):
    return f"SELECT bin, {R('bin_start', 4)} AS bin_start, {R('bin_end', 4)} AS bin_end, count FROM ({sql})"


@reg.add("a9_histogram_20", _hist_round_sql(_hist_sql("lineitem", "l_extendedprice", 20)))
def a9_hist(spark, sf):
    return _hist_round(A.histogram(load(spark, sf, "lineitem"), "l_extendedprice", 20))


IQR_KEPT = """(SELECT l_extendedprice FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.25) AS q1,
      quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem) b
      WHERE l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"""


@reg.add("a15_histogram_without_outliers", _hist_round_sql(_hist_sql(IQR_KEPT, "l_extendedprice", 20)))
def a15_hist(spark, sf):
    return _hist_round(A.histogram_without_outliers(load(spark, sf, "lineitem"), "l_extendedprice", 20))


@reg.add("f4_iqr_filter", f"""SELECT count(*) AS kept, {R('sum(l_extendedprice)', 2)} AS total_price
    FROM {IQR_KEPT}""")
def f4_filter(spark, sf):
    k = A.iqr_filter(load(spark, sf, "lineitem"), "l_extendedprice")
    return k.agg(F.count(F.lit(1)).alias("kept"), rnd(F.sum("l_extendedprice"), 2).alias("total_price"))


# ---------------------------------------------------------------- A10–A12
# Order-level measures derived by Spark from lineitem (grows with it).
ORDER_LINES_SQL = """(SELECT l_orderkey, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_price,
    count(*) AS n_lines, avg(l_discount) AS avg_discount, avg(l_tax) AS avg_tax FROM lineitem GROUP BY l_orderkey)"""
OL_NUM = ["sum_qty", "sum_price", "n_lines", "avg_discount", "avg_tax"]


def order_lines(spark, sf):
    return (load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("sum_qty"), F.sum("l_extendedprice").alias("sum_price"),
        F.count(F.lit(1)).alias("n_lines"), F.avg("l_discount").alias("avg_discount"),
        F.avg("l_tax").alias("avg_tax")))


def _corr_sql(table: str, cols: list[str]) -> str:
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, {R(f'corr({a}, {b})')} AS r FROM {table}")
    return " UNION ALL ".join(parts)


@reg.add("a10_correlation_matrix", _corr_sql(ORDER_LINES_SQL, OL_NUM))
def a10_corr(spark, sf):
    return A.correlation_matrix(order_lines(spark, sf), OL_NUM).withColumn("r", rnd("r"))


def _pairs_sql(cols):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS r, {i} AS i, {j} AS j FROM {ORDER_LINES_SQL}"
        for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j)


@reg.add("a11_strong_correlations",
         f"SELECT var1, var2, {R('r')} AS r FROM ({_pairs_sql(OL_NUM)}) WHERE abs(r) > 0.7")
def a11_strong(spark, sf):
    return A.strong_correlations(order_lines(spark, sf), OL_NUM, 0.7).withColumn("r", rnd("r"))


@reg.add("a12_top_correlations",
         f"""SELECT var1, var2, {R('coalesce(r, 0)')} AS r FROM ({_pairs_sql(OL_NUM)})
             WHERE abs(coalesce(r, 0)) > 0.5 ORDER BY abs(coalesce(r, 0)) DESC, i, j LIMIT 10""")
def a12_top(spark, sf):
    return A.top_correlations(order_lines(spark, sf), OL_NUM, 0.5, 10).withColumn("r", rnd("r"))


# ---------------------------------------------------------------- A13–A17
def _outlier_summary_sql(k: float) -> str:
    return f"""
    WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
               FROM events),
    f AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - {k} * (q3 - q1) AS lo, q3 + {k} * (q3 - q1) AS hi FROM b)
    SELECT {R('q1')} AS q1, {R('q3')} AS q3, {R('iqr')} AS iqr, {R('lo')} AS lower_bound, {R('hi')} AS upper_bound,
           count(*) AS non_null, CAST(count_if(value < lo) AS BIGINT) AS below, CAST(count_if(value > hi) AS BIGINT) AS above,
           {R('min(value)')} AS min, {R('max(value)')} AS max,
           {R('quantile_cont(value, 0.5)')} AS median,
           CAST(count_if(value < lo) + count_if(value > hi) AS BIGINT) AS outlier_count,
           {R('(count_if(value < lo) + count_if(value > hi)) * 100.0 / count(*)')} AS outlier_pct
    FROM events, f WHERE value IS NOT NULL GROUP BY q1, q3, iqr, lo, hi"""


def _outlier_summary(spark, sf, k):
    s = A.outlier_summary(load(spark, sf, "events"), "value", k)
    return _round_cols(s, ["q1", "q3", "iqr", "lower_bound", "upper_bound", "min", "max", "median", "outlier_pct"])


reg.add("a13_outlier_summary_iqr15", _outlier_summary_sql(1.5))(lambda spark, sf: _outlier_summary(spark, sf, 1.5))
reg.add("a16_boxplot_stats_iqr3", _outlier_summary_sql(3.0))(lambda spark, sf: _outlier_summary(spark, sf, 3.0))


def _outlier_rows_sql(k: float, limit: int | None) -> str:
    lim = f"ORDER BY event_id LIMIT {limit}" if limit else ""
    return f"""
    WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
               FROM events)
    SELECT event_id, value FROM events, b
    WHERE value < q1 - {k} * (q3 - q1) OR value > q3 + {k} * (q3 - q1) {lim}"""


@reg.add("a13_first_50_outliers", _outlier_rows_sql(1.5, 50))
def a13_rows(spark, sf):
    li = load(spark, sf, "events").select("event_id", "value")
    return A.outlier_rows(li, "value", 1.5, order_by=["event_id"], limit=50)


@reg.add("a14_outlier_rows_3iqr", _outlier_rows_sql(3.0, None))
def a14_rows(spark, sf):
    li = load(spark, sf, "events").select("event_id", "value")
    return A.outlier_rows(li, "value", 3.0)


@reg.add("a17_outlier_map", f"""WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
    f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b),
    o AS (SELECT event_id, value FROM events, f WHERE value < lo OR value > hi)
    SELECT {R('lo')} AS lower_bound, {R('hi')} AS upper_bound, (SELECT count(*) FROM o) AS outlier_count,
      {R('(SELECT count(*) FROM o) * 100.0 / (SELECT count(value) FROM events)')} AS outlier_pct,
      (SELECT {R('sum(value)')} FROM (SELECT value FROM o ORDER BY event_id LIMIT 20)) AS sum_of_values,
      (SELECT count(*) FROM (SELECT value FROM o ORDER BY event_id LIMIT 20)) AS n_values FROM f""")
def a17_full(spark, sf):
    m = A.outlier_map(load(spark, sf, "events"), "value", 1.5, ["event_id"], 20)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return m.select(rnd("lower_bound").alias("lower_bound"), rnd("upper_bound").alias("upper_bound"), "outlier_count",
                    rnd("outlier_pct").alias("outlier_pct"), rnd(total).alias("sum_of_values"),
                    F.size("values").cast("long").alias("n_values"))


@reg.add("a17_outlier_map_first_20", _outlier_rows_sql(1.5, 20))
def a17_map(spark, sf):
    li = load(spark, sf, "events").select("event_id", "value")
    return A.outlier_rows(li, "value", 1.5, order_by=["event_id"], limit=20)


# ---------------------------------------------------------------- A21
def _report_sql(cols, table=EVENTS_WITH_NULLS):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS count, {R(f'avg({c})')} AS mean,
            {R(f'stddev_samp({c})')} AS std, {R(f'min({c})')} AS min, {R(f'quantile_cont({c}, 0.25)')} AS q1,
            {R(f'quantile_cont({c}, 0.5)')} AS median, {R(f'quantile_cont({c}, 0.75)')} AS q3,
            {R(f'max({c})')} AS max, CAST(count_if({c} IS NULL) AS BIGINT) AS null_count,
            {R(f'count_if({c} IS NULL) * 100.0 / count(*)')} AS null_pct, count(DISTINCT {c}) AS distinct_count,
            (SELECT count(*) FROM {table} e2, (SELECT quantile_cont({c}, 0.25) AS a,
                quantile_cont({c}, 0.75) AS b FROM {table}) q
             WHERE e2.{c} < a - 1.5 * (b - a) OR e2.{c} > b + 1.5 * (b - a)) AS outlier_count
            FROM {table}""")
    return " UNION ALL ".join(parts)


@reg.add("a21_column_report", _report_sql(["value", "user_id"]))
def a21_report(spark, sf):
    r = A.column_report(events_with_nulls(spark, sf), ["value", "user_id"])
    return _round_cols(r, SUMMARY_COLS[1:] + ["null_pct"])
