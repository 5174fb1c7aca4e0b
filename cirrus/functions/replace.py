"""Value replacement at chosen rows (R1–R5) and row-range scoping.

Rows are chosen by the explicit `_row_id` (H1). A short id list becomes an
`isin` literal; a long one is a DataFrame of ids joined with a broadcast
(its size is the length of the list the caller gave).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from cirrus.functions.common import col, tcast
from cirrus.sources.ingest import ROW_ID

ISIN_MAX = 10_000


def valid_positions(ids: Sequence, n_rows: int | None = None) -> list[int]:
    """Keep integer entries inside [0, n_rows)."""
    out = []
    for i in ids:
        try:
            k = int(i)
        except (TypeError, ValueError):
            continue
        if k >= 0 and (n_rows is None or k < n_rows):
            out.append(k)
    return out


def replace_substring(c, find: str, repl: str) -> Column:
    """R2: literal replacement of all occurrences (`replace` is not a regex)."""
    x = col(c).cast("string")
    return F.replace(x, F.lit(find), F.lit(repl))


def replace_chars_at(c, positions: Sequence[int], new_value: str) -> Column:
    """R3 charByChar: the character at positions[i] becomes new_value[i]
    (deleted when new_value is shorter); a repeated position keeps the last."""
    x = col(c).cast("string")
    mapping: dict[int, str] = {}
    for i, p in enumerate(positions):
        if isinstance(p, int) and p >= 0:
            mapping[p] = new_value[i] if i < len(new_value) else ""
    if not mapping:
        return x
    m = F.create_map(*[v for p, ch in mapping.items() for v in (F.lit(p), F.lit(ch))])
    chars = F.split(x, "")
    return F.when(x.isNotNull(), F.array_join(
        F.transform(chars, lambda ch, j: F.coalesce(F.try_element_at(m, j), ch)), ""))


def replace_span(c, positions: Sequence[int], new_value: str) -> Column:
    """R4 complete: delete the characters at `positions`, then insert
    new_value at min(positions) when that position still exists."""
    x = col(c).cast("string")
    pos = [p for p in positions if isinstance(p, int)]
    if not pos:
        return x
    arr = F.array(*[F.lit(p) for p in pos])
    kept = F.array_join(F.filter(F.split(x, ""), lambda ch, j: ~F.array_contains(arr, j)), "")
    if not new_value:
        return F.when(x.isNotNull(), kept)
    at = min(pos)
    inserted = F.concat(F.substring(kept, 1, at), F.lit(new_value), F.substring(kept, at + 1, 2147483647))
    return F.when(x.isNotNull(), F.when(F.length(kept) >= at, inserted).otherwise(kept))


def reparse(text: Column, dtype) -> Column:
    """Back to the column type; a value that does not parse is null (a
    Spark column has one type) and is counted by `failed_reparse`."""
    if isinstance(dtype, IntegralType):
        d = tcast(text, "double")
        return F.when(d == F.floor(d), tcast(d, dtype.simpleString()))
    if isinstance(dtype, NumericType):
        return tcast(text, dtype.simpleString())
    return text


def _row_flag(df: DataFrame, ids: Sequence[int], row_id: str) -> tuple[DataFrame, Column]:
    ids = sorted(set(ids))
    if len(ids) <= ISIN_MAX:
        return df, F.col(row_id).isin(ids)
    spark = df.sparkSession
    flags = spark.createDataFrame([(i,) for i in ids], f"{row_id} long").withColumn("_hit", F.lit(True))
    return df.join(F.broadcast(flags), row_id, "left"), F.coalesce(F.col("_hit"), F.lit(False))


def replace_values(df: DataFrame, c: str, ids: Sequence, mode: str = "direct", new_value: str = "",
                   find: str | None = None, positions: Sequence[int] = (),
                   row_id: str = ROW_ID) -> DataFrame:
    """R1–R5 on the rows whose `_row_id` is listed. Modes: direct (R1: '' →
    null; numeric columns must parse the value), substring (R2),
    charByChar (R3), complete (R4); numeric columns are re-parsed (R5)."""
    dtype = df.schema[c].dataType
    is_num = isinstance(dtype, NumericType)
    j, hit = _row_flag(df, valid_positions(ids), row_id)
    x = F.col(c)
    if mode == "direct":
        if new_value == "":
            v = F.lit(None).cast(dtype)
        elif is_num:
            try:
                float(new_value)
            except ValueError as e:
                raise ValueError(f"Invalid numeric value: {new_value!r} for numeric column {c!r}") from e
            v = reparse(F.lit(new_value), dtype)
        else:
            v = F.lit(new_value)
        out = F.when(hit, v).otherwise(x)
    else:
        if mode == "substring":
            t = replace_substring(x, find or "", new_value)
        elif mode == "charByChar":
            t = replace_chars_at(x, positions, new_value)
        elif mode == "complete":
            t = replace_span(x, positions, new_value)
        else:
            raise ValueError(f"unknown replacement mode: {mode}")
        out = F.when(hit & x.isNotNull(), reparse(t, dtype) if is_num else t).otherwise(x)
    res = j.withColumn(c, out.cast(dtype) if is_num else out)
    return res.drop("_hit") if "_hit" in res.columns else res


def failed_reparse(df: DataFrame, c: str, ids: Sequence, mode: str, row_id: str = ROW_ID, **change) -> DataFrame:
    """How many of the listed values of a numeric column no longer parse as
    its type after the replacement (one row: failed)."""
    after = replace_values(df.withColumn("_before", F.col(c)), c, ids, mode, row_id=row_id, **change)
    return after.agg(F.count_if(F.col("_before").isNotNull() & F.col(c).isNull()).alias("failed"))


def in_range(row_id: str, start: int, end: int, n_rows: int | None = None) -> Column:
    """rows [start, end] inclusive, clamped to the table."""
    lo = max(0, start)
    hi = end if n_rows is None else min(end, n_rows - 1)
    return F.col(row_id).between(lo, hi)


def apply_in_range(df: DataFrame, c: str, expr: Column, start: int | None = None,
                   end: int | None = None, row_id: str = ROW_ID, out: str | None = None) -> DataFrame:
    """apply a column expression to all rows or only inside a row range."""
    target = out or c
    if start is None and end is None:
        return df.withColumn(target, expr)
    cond = in_range(row_id, start or 0, end if end is not None else 2**62)
    return df.withColumn(target, F.when(cond, expr).otherwise(F.col(c)))
