"""Data report (S9, D9, D11): the tables behind the reference's report —
info, statistics, per-column analysis, missing data, correlations,
variable data, preview — as a dict of DataFrames. Each is one aggregate
(or a top-n); nothing is drawn here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrus.functions.common import numeric_columns
from cirrus.operators import profile as A


def report(df: DataFrame, order_by: Sequence[str] = (), preview_rows: int = 10) -> dict[str, DataFrame]:
    num = numeric_columns(df)
    info = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))
    out = {
        "info": info,
        "statistics": A.summary(df, num, moments=True) if num else None,
        "column_analysis": A.column_report(df, num) if num else None,
        "missing": A.missing_table(df),
        "correlations": A.top_correlations(df, num) if len(num) > 1 else None,
        "duplicates": A.duplicate_rows(df),
        "preview": (df.orderBy(*order_by) if order_by else df).limit(preview_rows),
    }
    return {k: v for k, v in out.items() if v is not None}


def column_info(df: DataFrame, c: str, max_distribution: int = 20) -> dict[str, DataFrame]:
    """Counts, statistics, and the value distribution when the column
    has ≤ 20 distinct values."""
    from cirrus.operators.encode import cyclic_period_by_name
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.count(c).alias("non_null"),
                    F.count_distinct(c).alias("distinct"))
    res = {"counts": counts.withColumn("cyclic_period", F.lit(cyclic_period_by_name(c)))}
    if c in numeric_columns(df):
        res["statistics"] = A.summary(df, [c])
    k = counts.first()["distinct"]
    if k <= max_distribution:
        res["distribution"] = A.value_counts(df, c)
    return res


def available_normalizers(df: DataFrame) -> DataFrame:
    """Per column its coarse kind (D2) and the methods that apply, with
    mean/std/min/max for numeric columns or distinct count and top-3 values
    for text: one aggregate for the numbers, one for the kinds of all text columns and
    one job for their values."""
    from cirrus.operators.detect import coarse_kinds, probe
    from cirrus.operators.normalize import NUMERIC_METHODS
    from pyspark.sql.types import NumericType
    spark = df.sparkSession
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    txt = [f.name for f in df.schema.fields if f.name not in num]
    rows = []
    if num:
        a = df.agg(*[x for i, c in enumerate(num) for x in (
            F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"), F.min(c).cast("double").alias(f"lo{i}"),
            F.max(c).cast("double").alias(f"hi{i}"))]).first()
        for i, c in enumerate(num):
            rows.append((c, "numeric", ",".join(NUMERIC_METHODS), a[f"m{i}"], a[f"s{i}"], a[f"lo{i}"], a[f"hi{i}"],
                         None, None))
    if txt:
        kinds = {r["column"]: r["coarse_kind"] for r in coarse_kinds(df, txt).collect()}  # one row per column
        values = probe(df, txt, top=3)
        for c in txt:
            methods = "LOWER,STRIP,LABEL_ENCODING,ONE_HOT" if kinds[c] == "text" else \
                ",".join(NUMERIC_METHODS) + ",LOWER,STRIP,LABEL_ENCODING,ONE_HOT"
            rows.append((c, kinds[c], methods, None, None, None, None, values[c]["distinct"], ",".join(values[c]["top"])))
    return spark.createDataFrame(rows, "column string, kind string, methods string, mean double, std double, "
                                       "min double, max double, distinct_count long, top3 string")
