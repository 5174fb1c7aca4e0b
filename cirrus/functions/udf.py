"""User functions as Arrow-batched pandas UDFs (UD1–UD5).

The user gives a Python callable `normalize(value)` (UD1) or one returning a
dict of new columns (UD2, declared schema). It runs inside Spark tasks on
Arrow batches; a value that raises gives null (numeric) or '' (text) and the
error message lands in an `_error` field so that failures can be counted
(UD5). Column statistics (UD3) are computed by one aggregate and handed to
the function by closure; an `init(stats)` callable (UD4) runs once per task
through an iterator UDF.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegralType, StringType, StructField, StructType


def column_stats(df: DataFrame, c: str) -> dict:
    """UD3: min, max, mean, std, median, count, sum of a numeric column."""
    from cirrus.operators.quantiles import quantile_row
    x = F.col(c).cast("double")
    r = df.agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
               F.stddev_samp(x).alias("std"), F.count(x).alias("count"), F.sum(x).alias("sum")).first().asDict()
    q = quantile_row(df, c, [0.5])
    r["median"] = q[0] if q else None
    return r


def _caller(fn: Callable, stats: dict | None, state) -> Callable:
    """`fn` with the extra arguments that its signature names, decided once per task."""
    params = inspect.signature(fn).parameters
    kwargs = {}
    if "series" in params or "stats" in params:
        kwargs["stats" if "stats" in params else "series"] = stats
    if "state" in params:
        kwargs["state"] = state
    return (lambda v: fn(v, **kwargs)) if kwargs else fn


def _values(s: pd.Series, whole: bool) -> list:
    """The values of a batch, None for missing ones; whole numbers stay whole beside nulls."""
    missing = s.isna().tolist()
    return [None if m else int(v) if whole else v for v, m in zip(s.tolist(), missing)]


def value_udf(fn: Callable, return_type: DataType = DoubleType(), stats: dict | None = None,
              init: Callable | None = None, whole: bool = False) -> Callable[[Column], Column]:
    """UD1 (+UD3, UD4): one value in → one value out; returns a function
    Column → struct<value, _error>. `whole`: the input is an integer column."""
    is_text = isinstance(return_type, StringType)
    schema = StructType([StructField("value", return_type), StructField("_error", StringType())])
    fail = "" if is_text else None

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = _caller(fn, stats, init(stats) if init else None)  # once per task
        for s in batches:
            vals, errs = [], []
            for v in _values(s, whole):
                if v is None:
                    vals.append(fail)
                    errs.append(None)
                    continue
                try:
                    vals.append(call(v))
                    errs.append(None)
                except Exception as e:  # noqa: BLE001 - user code
                    vals.append(fail)
                    errs.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"value": vals, "_error": errs})

    return run


def dict_udf(fn: Callable, schema: StructType, stats: dict | None = None,
             init: Callable | None = None, whole: bool = False) -> Callable[[Column], Column]:
    """UD2: a function returning a dict → one struct field per declared
    output column, plus `_error`; missing keys are null, and where the function
    fails text fields are ''."""
    fields = [f.name for f in schema.fields]
    failed = {f.name: "" if isinstance(f.dataType, StringType) else None for f in schema.fields}
    out_schema = StructType(list(schema.fields) + [StructField("_error", StringType())])

    @F.pandas_udf(out_schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = _caller(fn, stats, init(stats) if init else None)  # once per task
        for s in batches:
            rows = []
            for v in _values(s, whole):
                try:
                    d = call(v) if v is not None else {}
                    rows.append({**{k: d.get(k) for k in fields}, "_error": None})
                except Exception as e:  # noqa: BLE001
                    rows.append({**failed, "_error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=fields + ["_error"])

    return run


def apply_value_function(df: DataFrame, c: str, fn: Callable, return_type: DataType = DoubleType(),
                         out: str | None = None, with_stats: bool = False, init: Callable | None = None) -> DataFrame:
    """UD1 on a column: `<out>` plus `<out>_error`."""
    from cirrus.session import ship_package
    ship_package(df.sparkSession)
    stats = column_stats(df, c) if with_stats else None
    whole = isinstance(df.schema[c].dataType, IntegralType)
    r = value_udf(fn, return_type, stats, init, whole)(F.col(c))
    name = out or c
    return df.withColumn("_r", r).withColumn(name, F.col("_r.value")).withColumn(
        f"{name}_error", F.col("_r._error")).drop("_r")


def apply_dict_function(df: DataFrame, c: str, fn: Callable, schema: StructType, prefix: str = "") -> DataFrame:
    """UD2 on a column: one new column per declared field."""
    from cirrus.session import ship_package
    ship_package(df.sparkSession)
    r = dict_udf(fn, schema, whole=isinstance(df.schema[c].dataType, IntegralType))(F.col(c))
    out = df.withColumn("_r", r)
    return out.select(*df.columns, *[F.col(f"_r.{f.name}").alias(f"{prefix}{f.name}") for f in schema.fields],
                      F.col("_r._error").alias(f"{prefix}_error"))


def error_summary(df: DataFrame, error_col: str, value_col: str, examples: int = 5) -> DataFrame:
    """UD5: per error message, its count and its first `examples` distinct values
    in text order. The values are made distinct with partial aggregation and
    their ranks limited before the shuffle, so a message hit by a third of the
    rows never gathers its rows in one place."""
    e = df.filter(F.col(error_col).isNotNull())
    counts = e.groupBy(error_col).agg(F.count(F.lit(1)).alias("count"))
    values = e.select(error_col, F.col(value_col).cast("string").alias("_v")).filter("_v is not null").distinct()
    first = values.withColumn("_r", F.row_number().over(Window.partitionBy(error_col).orderBy("_v")))
    ex = (first.filter(F.col("_r") <= examples).groupBy(error_col)
               .agg(F.array_sort(F.collect_list("_v")).alias("examples")))  # ≤ examples per message
    return counts.join(ex, error_col, "left")
