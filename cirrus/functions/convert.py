"""Type conversions (C1–C10), dates (DT1–DT6) and map/JSON scalars
(JM1–JM3). ANSI mode is on, so every lossy conversion goes through
`try_cast`: a value that does not fit becomes null and can be counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrus.functions import numeric as M
from cirrus.functions.common import col, tcast

# Candidate date formats (fixed values), in the reference's order, as
# Python strptime patterns and the equivalent Spark datetime patterns.
DATE_FORMATS = [
    ("%Y-%m-%d", "yyyy-MM-dd"),
    ("%d/%m/%Y", "dd/MM/yyyy"),
    ("%m/%d/%Y", "MM/dd/yyyy"),
    ("%Y/%m/%d", "yyyy/MM/dd"),
    ("%Y-%m-%d %H:%M:%S", "yyyy-MM-dd HH:mm:ss"),
    ("%d/%m/%Y %H:%M:%S", "dd/MM/yyyy HH:mm:ss"),
    ("%m/%d/%Y %H:%M:%S", "MM/dd/yyyy HH:mm:ss"),
]

INT_TYPES = {"TO_INT64": "bigint", "TO_INT32": "int", "TO_INT16": "smallint"}
FLOAT_TYPES = {"TO_FLOAT64": "double", "TO_FLOAT32": "float"}
CONVERSIONS = ("TO_FLOAT64", "TO_FLOAT32", "TO_INT64", "TO_INT32", "TO_INT16",
               "TO_STRING", "TO_NUMERIC", "TRUNCATE")


def to_float(c, kind: str = "TO_FLOAT64") -> Column:
    """C1."""
    return tcast(col(c), FLOAT_TYPES[kind])


def to_int(c, kind: str = "TO_INT64") -> Column:
    """Round half-even first (pandas `round()`), then an integer type;
    a value out of range becomes null instead of raising."""
    return tcast(M.round_even(tcast(col(c), "double"), 0), INT_TYPES[kind])


def to_string(c) -> Column:
    """Text, null → ''."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def to_numeric(c) -> Column:
    """Parse as double; unparsable → null, and the text `NaN` (which
    Spark parses) → null too."""
    v = tcast(F.trim(col(c).cast("string")), "double")
    return F.when(~F.isnan(v), v)


def truncate_text(c, chars: int) -> Column:
    """Keep the first `chars` characters; chars ≤ 0 is an error."""
    if chars <= 0:
        raise ValueError(f"character limit must be positive, got {chars}")
    return F.substring(col(c).cast("string"), 1, chars)


def convert(c, method: str, is_numeric: bool = True, **params) -> Column:
    """Dispatch by conversion name; unknown names are an error."""
    m = method.upper()
    if m in FLOAT_TYPES:
        return to_float(c, m)
    if m in INT_TYPES:
        return to_int(c, m)
    if m == "TO_STRING":
        return to_string(c)
    if m == "TO_NUMERIC":
        return to_numeric(c)
    if m == "TRUNCATE":
        if is_numeric:
            return M.truncate_decimals(c, params.get("decimals", 2))
        chars = params.get("chars")
        return truncate_text(c, chars if chars is not None else params.get("decimals", 2))
    raise ValueError(f"Unknown conversion method: {method}")


def lost_by_conversion(c, converted: Column) -> Column:
    """An aggregate counting values that the conversion turned to null."""
    return F.count_if(col(c).isNotNull() & converted.isNull())


def conversion_report(df: DataFrame, conversions: dict[str, str]) -> DataFrame:
    """Per column, the number of values lost by its conversion (one
    aggregate for all columns)."""
    aggs = [lost_by_conversion(c, convert(c, m, _is_numeric(df, c))).alias(f"l{i}")
            for i, (c, m) in enumerate(conversions.items())]
    r = df.agg(*aggs)
    return r.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(m).alias("conversion"), F.col(f"l{i}").alias("lost"))
        for i, (c, m) in enumerate(conversions.items())])))


def _is_numeric(df, c) -> bool:
    from cirrus.functions.common import is_numeric_type
    return is_numeric_type(df.schema[c].dataType)


# --- dates ---------------------------------------------------------------

def parse_datetime(c, formats: list[str] | None = None) -> Column:
    """DT1: first candidate format that parses; unparsable → null. The
    result is a timestamp without zone (the text's wall clock), like the
    naive datetimes of the reference, whatever the session time zone."""
    fmts = formats or [s for _, s in DATE_FORMATS]
    x = col(c).cast("string")
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in fmts]).cast("timestamp_ntz")


def parse_request_date(c) -> Column:
    """DT2: `yyyy-MM-dd`, else today."""
    return F.coalesce(F.try_to_date(col(c).cast("string"), "yyyy-MM-dd"), F.current_date())


def calendar_day(c) -> Column:
    """DT3."""
    return F.to_date(col(c))


# Seasons by month (fixed values): December–February winter, March–May
# spring, June–August summer, September–November autumn.
def season(c) -> Column:
    """DT4."""
    m = F.month(col(c))
    return (F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring")
             .when(m.isin(6, 7, 8), "summer").when(m.isNotNull(), "autumn"))


def duration_seconds(start, end) -> Column:
    """DT5: end − start in seconds (microsecond difference: independent of
    the session time zone for timestamps with and without zone)."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end)) / F.lit(1e6)


EPOCH_NTZ = "1970-01-01 00:00:00"


def ntz_to_instant(c) -> Column:
    """A timestamp without zone read as UTC wall-clock → an instant
    (`timestamp`), whatever the session time zone (event-time operators such
    as watermarks need an instant)."""
    micros = F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), col(c))
    return F.timestamp_micros(micros)


def instant_to_ntz(c) -> Column:
    """Inverse of `ntz_to_instant`: the UTC wall-clock of an instant."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(col(c)), F.lit(EPOCH_NTZ).cast("timestamp_ntz"))


def clock_time(c) -> Column:
    """DT6: `HH:mm`."""
    return F.date_format(col(c), "HH:mm")


DATE_PARTS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour,
    "minute": F.minute, "second": F.second, "dayofweek": F.dayofweek,
    "dayofyear": F.dayofyear, "weekofyear": F.weekofyear,
}


def date_parts(df: DataFrame, c: str, parts=tuple(DATE_PARTS)) -> DataFrame:
    """`<col>_<part>` integer columns."""
    return df.withColumns({f"{c}_{p}": DATE_PARTS[p](F.col(c)) for p in parts})


# --- map / JSON ------------------------------------------------------------

def map_lookup(m, key: str, fallback: str | None = None) -> Column:
    """JM1: value of `key`, else of `fallback` (missing key → null)."""
    x = col(m)
    v = F.try_element_at(x, F.lit(key))
    return F.coalesce(v, F.try_element_at(x, F.lit(fallback))) if fallback else v


def to_json_records(*cols) -> Column:
    """JM2: one JSON object per row (nulls kept as JSON null)."""
    return F.to_json(F.struct(*[col(c) for c in cols]), {"ignoreNullFields": "false"})


def from_json_text(c, schema: str) -> Column:
    """JM3: parse JSON text with a declared schema."""
    return F.from_json(col(c), schema)
