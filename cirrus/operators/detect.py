"""Type and semantic detection (D1–D4, D8, D10, D11): counts of all columns in one
aggregate, and one job that brings the first values and the most frequent values of all
text columns, a bounded number of rows for each column (`probe`)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from cirrus.functions.common import tcast
from cirrus.functions.convert import DATE_FORMATS
from cirrus.sources.ingest import ROW_ID

MIN_SAMPLE = 100
MAX_CATEGORICAL = 50
# Name fragments that flag a possible leak (fixed values).
LEAK_WORDS = ["future", "next", "forecast", "prediction", "will", "tomorrow"]


def _num(c):
    v = tcast(F.trim(F.col(c).cast("string")), "double")
    return v.isNotNull() & ~F.isnan(v)


def probe(df: DataFrame, cols: Sequence[str], first: int = 0, top: int = 0, row_id: str = ROW_ID) -> dict[str, dict]:
    """Of each column, as text: its `first` values that are not null in row order, its `top` most
    frequent values (ties in text order) and the number of distinct ones. One job for any
    number of columns; first + top + 1 rows of each come to the driver.

    Tasks keep their own first rows of a column before anything is shuffled, and values
    are counted with partial aggregation."""
    cols = list(cols)
    out = {c: {"first": [], "top": [], "distinct": 0} for c in cols}
    if not cols or not (first or top):
        return out
    text = [F.col(f"`{c}`").cast("string") for c in cols]
    parts = []
    if first:
        cells = df.select(F.col(row_id).alias("_r"), F.inline(F.array(*[F.struct(F.lit(i).alias("_ci"), t.alias("_v")) for i, t in enumerate(text)])))
        place = F.row_number().over(Window.partitionBy("_ci").orderBy("_r"))
        kept = cells.where(F.col("_v").isNotNull()).withColumn("_n", place).where(F.col("_n") <= first)
        parts.append(kept.select(F.lit("first").alias("_what"), "_ci", F.col("_n").cast("long").alias("_n"), "_v"))
    if top:
        cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_ci"), t.alias("_v")) for i, t in enumerate(text)])))
        counts = cells.where(F.col("_v").isNotNull()).groupBy("_ci", "_v").agg(F.count(F.lit(1)).alias("_c"))
        place = F.row_number().over(Window.partitionBy("_ci").orderBy(F.desc("_c"), "_v"))
        kept = counts.withColumn("_n", place).where(F.col("_n") <= top)
        parts.append(kept.select(F.lit("top").alias("_what"), "_ci", F.col("_n").cast("long").alias("_n"), "_v"))
        parts.append(counts.groupBy("_ci").agg(F.count(F.lit(1)).alias("_n")).select(F.lit("distinct").alias("_what"), "_ci", "_n", F.lit(None).cast("string").alias("_v")))
    got = parts[0]
    for more in parts[1:]:
        got = got.unionByName(more)
    for r in sorted(got.collect(), key=lambda r: r["_n"]):
        own = out[cols[r["_ci"]]]
        if r["_what"] == "distinct":
            own["distinct"] = r["_n"]
        else:
            own[r["_what"]].append(r["_v"])
    return out


def column_kinds(df: DataFrame, cols: Sequence[str] | None = None, row_id: str = ROW_ID) -> DataFrame:
    """Per column: insufficient_data (< 100 non-null), numeric, or for
    text — judged on the first 100 non-null values in row order — datetime
    (> 80 % parse under one format, first format wins), numeric_string
    (> 80 % numeric), categorical (< 50 distinct over the column) or text.
    Three jobs for any number of columns: counts, first values, what these are."""
    cols = list(cols) if cols else df.columns
    spark = df.sparkSession
    base = df.agg(*[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(cols)],
                  *[F.count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    texts = [c for i, c in enumerate(cols) if base[f"n{i}"] >= MIN_SAMPLE and isinstance(df.schema[c].dataType, StringType)]
    sample = [(c, v) for c, p in probe(df, texts, first=MIN_SAMPLE, row_id=row_id).items() for v in p["first"]]
    share = {}
    if sample:
        aggs = [F.avg(F.try_to_timestamp(F.col("v"), F.lit(s)).isNotNull().cast("double")).alias(f"f{j}")
                for j, (_, s) in enumerate(DATE_FORMATS)]
        rows = spark.createDataFrame(sample, "c string, v string").groupBy("c").agg(*aggs, F.avg(_num("v").cast("double")).alias("num"))
        share = {r["c"]: r for r in rows.collect()}
    rows = []
    for i, c in enumerate(cols):
        nn, nd = base[f"n{i}"], base[f"d{i}"]
        kind, fmt = None, None
        if nn < MIN_SAMPLE:
            kind = "insufficient_data"
        elif isinstance(df.schema[c].dataType, NumericType):
            kind = "numeric"
        elif c in share:
            fmt = next((p for j, (p, _) in enumerate(DATE_FORMATS) if share[c][f"f{j}"] > 0.8), None)
            kind = ("datetime" if fmt else "numeric_string" if share[c]["num"] > 0.8 else
                    "categorical" if nd < MAX_CATEGORICAL else "text")
        else:
            kind = "other"
        rows.append((c, kind, fmt, int(nn), int(nd)))
    return spark.createDataFrame(rows, "column string, kind string, date_format string, non_null long, "
                                       "distinct_count long")


def coarse_kinds(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """D2 (> 50 % of non-null values numeric → numeric) and D3 (> 80 % of
    ALL rows numeric → numeric string override), one aggregate."""
    cols = list(cols) if cols else [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    a = df.agg(F.count(F.lit(1)).alias("_rows"),
               *[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(cols)],
               *[F.count_if(_num(c)).alias(f"p{i}") for i, c in enumerate(cols)])
    return a.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"),
        F.when(F.col(f"p{i}") > F.col(f"n{i}") * 0.5, "numeric").otherwise("text").alias("coarse_kind"),
        (F.col(f"p{i}") > F.col("_rows") * 0.8).alias("numeric_string")) for i, c in enumerate(cols)])))


def output_dtype(df: DataFrame, c: str) -> DataFrame:
    """Kind and dtype for a new text column: boolean if every value is a
    spelling of true or false, integer (int32 where all fit, else int64) or
    float if all are numbers, datetime if all are dates, else text."""
    text = F.col(c).cast("string")
    v = tcast(F.trim(text), "double")
    a = df.filter(F.col(c).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(text.isin("true", "false", "True", "False")).alias("b"),
        F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.count_if(v.isNotNull()).alias("num"),
        F.count_if(v.isNotNull() & (v == F.floor(v))).alias("ints"),
        F.count_if(F.coalesce(*[F.try_to_timestamp(F.col(c).cast("string"), F.lit(s)) for _, s in DATE_FORMATS])
                   .isNotNull()).alias("dates"))
    kind = (F.when(F.col("n") == 0, "text").when(F.col("b") == F.col("n"), "boolean")
             .when(F.col("ints") == F.col("n"), "integer").when(F.col("num") == F.col("n"), "float")
             .when(F.col("dates") == F.col("n"), "datetime").otherwise("text"))
    small = (F.col("lo") >= -(1 << 31)) & (F.col("hi") <= (1 << 31) - 1)
    dtype = (F.when(kind == "boolean", "bool").when((kind == "integer") & small, "int32")
              .when(kind == "integer", "int64").when(kind == "float", "float64")
              .when(kind == "datetime", "datetime64").otherwise("string"))
    return a.select(F.lit(c).alias("column"), kind.alias("kind"), dtype.alias("dtype"))


def categorical_flags(df: DataFrame, cols: Sequence[str] | None = None, threshold: int = 10) -> DataFrame:
    """Text columns, or columns with fewer than 10 distinct values."""
    cols = list(cols) if cols else df.columns
    a = df.agg(*[F.count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)])
    return a.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct_count"),
        (F.lit(isinstance(df.schema[c].dataType, StringType)) | (F.col(f"d{i}") < threshold)).alias("categorical"))
        for i, c in enumerate(cols)])))


def leak_check(df: DataFrame, predictors: Sequence[str], target: str, threshold: float = 0.99) -> DataFrame:
    """Predictors whose name suggests the future or, without `_` and
    `-`, contains the target's name (also without them), or whose |corr| with the target exceeds 0.99 (one
    aggregate of correlations)."""
    from cirrus.operators.profile import correlation_matrix
    num = [p for p in predictors if isinstance(df.schema[p].dataType, NumericType)]
    variants = {target.lower(), target.upper(), target.replace("_", ""), target.replace("-", "")}
    rows = []
    corr = {}
    if num and isinstance(df.schema[target].dataType, NumericType):
        m = correlation_matrix(df, num + [target]).filter(F.col("var2") == target).collect()  # one row per predictor
        corr = {r["var1"]: r["r"] for r in m}
    for p in predictors:
        name = p.lower()
        reasons = [w for w in LEAK_WORDS if w in name]
        plain = name.replace("_", "").replace("-", "")
        if any(v in plain for v in variants):
            reasons.append("target name")
        r = corr.get(p)
        if r is not None and abs(r) > threshold:
            reasons.append("correlation")
        rows.append((p, r, ",".join(reasons) or None))
    return df.sparkSession.createDataFrame(rows, "column string, corr_with_target double, reasons string")
