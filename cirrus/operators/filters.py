"""Row filters (F1–F8) and column checks.

Filters are plain predicates so Catalyst pushes them into the Parquet scan
(`PushedFilters`) and prunes the columns they do not need.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, FractionalType, IntegralType, TimestampType

from cirrus.functions.common import numeric_columns
from cirrus.operators.profile import iqr_filter  # noqa: F401  (F4)
from cirrus.sources.ingest import ROW_ID


def _coerce(values: Sequence, dtype) -> tuple[list, bool]:
    """F1 value coercion to the column type: int via float, float, datetime,
    else text; 'null'/None selects nulls."""
    out, want_null = [], False
    for v in values:
        if v is None or (isinstance(v, str) and v.strip().lower() == "null"):
            want_null = True
            continue
        try:
            if isinstance(dtype, IntegralType):
                f = float(v)
                if f.is_integer():
                    out.append(int(f))
            elif isinstance(dtype, FractionalType):
                out.append(float(v))
            elif isinstance(dtype, (TimestampType, DateType)):
                out.append(v if isinstance(v, (datetime, date)) else datetime.fromisoformat(str(v)))
            else:
                out.append(str(v))
        except (TypeError, ValueError):
            continue
    return out, want_null


def remove_values(df: DataFrame, c: str, values: Sequence, must_remove: bool = True) -> DataFrame:
    """drop rows whose value is listed. A plain `~isin` would also drop
    the null rows (null → unknown), so the predicate is null-aware. When no
    row holds any of the values that is an error, unless `must_remove` is off
    (which also saves the look)."""
    vals, want_null = _coerce(values, df.schema[c].dataType)
    x = F.col(c)
    hit = F.coalesce(x.isin(vals), F.lit(False)) if vals else F.lit(False)
    if want_null:
        hit = hit | x.isNull()
    if must_remove and df.filter(hit).isEmpty():
        raise ValueError(f"no row of {c!r} has any of the values to remove")
    return df.filter(~hit)


def drop_null_rows(df: DataFrame, c: str | None = None) -> DataFrame:
    """F2 (one column) / F3 (any column)."""
    return df.na.drop(how="any", subset=[c]) if c else df.na.drop(how="any")


def preview_non_null(df: DataFrame, c: str, n: int = 20, start: int | None = None,
                     end: int | None = None, row_id: str = ROW_ID) -> DataFrame:
    """first n non-null values (inside [start, end] when scoped)."""
    out = df.filter(F.col(c).isNotNull())
    if start is not None or end is not None:
        out = out.filter(F.col(row_id).between(start or 0, end if end is not None else 2**62))
    return out.orderBy(row_id).limit(n)


def prediction_log_filter(df: DataFrame, ts: str = "created_at", model: str = "model_name",
                          accuracy: str = "accuracy", date_from: str | None = None,
                          date_to: str | None = None, model_name: str | None = None,
                          min_accuracy: float | None = None) -> DataFrame:
    """date range (end day included up to 23:59:59), model, minimum
    accuracy — one conjunction."""
    cond: Column = F.lit(True)
    # literals of the column's own timestamp type: no session-zone shift and
    # the comparison stays a pushed-down Parquet filter
    to_ts = F.to_timestamp_ntz if dict(df.dtypes).get(ts) == "timestamp_ntz" else F.to_timestamp
    if date_from:
        cond = cond & (F.col(ts) >= to_ts(F.lit(date_from)))
    if date_to:
        cond = cond & (F.col(ts) <= to_ts(F.lit(f"{date_to} 23:59:59")))
    if model_name:
        cond = cond & (F.col(model) == model_name)
    if min_accuracy is not None:
        cond = cond & (F.col(accuracy) >= F.lit(float(min_accuracy)))
    return df.filter(cond)


def completed(df: DataFrame, status: str = "status") -> DataFrame:
    """F8."""
    return df.filter(F.col(status) == "completed")


# --- column checks -------------------------------------------------------

def select_features(df: DataFrame, predictors: Sequence[str] = (), targets: Sequence[str] = ()) -> DataFrame:
    """Predictors ∪ targets in that order (all columns if none given)."""
    cols = list(dict.fromkeys(list(predictors) + list(targets)))
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*cols) if cols else df


def drop_column(df: DataFrame, c: str) -> DataFrame:
    """P2."""
    if c not in df.columns:
        raise ValueError(f"column {c!r} not found")
    return df.drop(c)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Trimmed, non-empty, different, not already used."""
    new = (new or "").strip()
    if old not in df.columns:
        raise ValueError(f"column {old!r} not found")
    if not new:
        raise ValueError("new name is empty")
    if new == old:
        raise ValueError("new name equals the old one")
    if new in df.columns:
        raise ValueError(f"column {new!r} already exists")
    return df.withColumnRenamed(old, new)


def column_as_text(df: DataFrame, c: str) -> tuple[DataFrame, DataFrame]:
    """P5: the column as text (null kept) and its total/unique/null counts."""
    values = df.select(F.col(c).cast("string").alias(c))
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(c).alias("unique"),
                    F.count_if(F.col(c).isNull()).alias("nulls"))
    return values, counts


def preview(df: DataFrame, n: int = 10, row_id: str = ROW_ID) -> DataFrame:
    """First n rows in row order."""
    return (df.orderBy(row_id) if row_id in df.columns else df).limit(n)


def numeric_only(df: DataFrame) -> DataFrame:
    """P7."""
    return df.select(*numeric_columns(df))


def validate(df: DataFrame, min_rows: int = 10) -> DataFrame:
    """Not empty, ≥ min_rows rows, ≥ 1 column, unique names, not all
    null — one aggregate; returns (ok, message)."""
    names = df.columns
    if not names:
        return df.sparkSession.createDataFrame([(False, "no columns")], "ok boolean, message string")
    if len(set(names)) != len(names):
        return df.sparkSession.createDataFrame([(False, "duplicate column names")], "ok boolean, message string")
    any_value = F.greatest(*[F.max(F.col(f"`{c}`").isNotNull().cast("int")) for c in names]) \
        if len(names) > 1 else F.max(F.col(f"`{names[0]}`").isNotNull().cast("int"))
    a = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(any_value, F.lit(0)).alias("v"))
    return a.select(
        ((F.col("n") >= min_rows) & (F.col("v") == 1)).alias("ok"),
        F.when(F.col("n") == 0, "empty table")
         .when(F.col("n") < min_rows, F.concat(F.lit("fewer than "), F.lit(str(min_rows)), F.lit(" rows")))
         .when(F.col("v") == 0, "all values are null")
         .otherwise("ok").alias("message"))
