"""Small helpers shared by the column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Offset of the comparison rounding (fixed value): not 0.5, so that values
# sitting exactly on a decimal tie (means of cents, e.g. 0.0499185 at 6
# decimals) are not split by last-bit noise between two engines.
ROUND_OFFSET = 0.4999871


def round_half_up(c: str | Column, decimals: int = 4) -> Column:
    """Rounding for reproducible output, in binary arithmetic:
    `floor(x·10^d + c) / 10^d` with c slightly below one half. Two engines
    holding nearly the same double agree unless the value lies within noise
    of an off-centre boundary (Spark's `round` works on the decimal text of
    the double, other engines do not, and a plain half offset makes exact
    decimal ties flip on the last bit)."""
    f = float(10 ** decimals)
    return F.floor(col(c) * F.lit(f) + F.lit(ROUND_OFFSET)) / F.lit(f)


def is_numeric_type(dt) -> bool:
    from pyspark.sql.types import NumericType
    return isinstance(dt, NumericType)


def numeric_columns(df, exclude=()) -> list[str]:
    """Numeric columns only."""
    return [f.name for f in df.schema.fields
            if is_numeric_type(f.dataType) and f.name not in exclude]


def text_columns(df, exclude=()) -> list[str]:
    from pyspark.sql.types import StringType
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in exclude]


def tcast(c: str | Column, dtype: str) -> Column:
    """`try_cast`: null instead of an ANSI cast error."""
    return col(c).try_cast(dtype)
