"""Null filling (N1–N12) and the fill windows.

Forward fill, backward fill and linear interpolation follow the row order.
A plain `Window.orderBy(...)` without a partition key would move the whole
table into one task, and a window partitioned by a series key puts a hot
key (a third of the rows) into one task. Instead the table is cut into runs of its (keys,
order) order (`placed`): the fill runs as a window over (keys, run) groups — bounded
whatever the key distribution. What earlier and later runs of the same key
hand over comes from one narrow aggregate, of which only keys that lie in several runs
are kept: two rows for each run at most. The rows themselves move once, and nothing is
checkpointed but that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from cirrus.operators.encode import label_encode
from cirrus.operators.placed import RUN, cut_points, order_struct, place, runs_of
from cirrus.sources.held import hold
from cirrus.sources.ingest import ROW_ID


def _carry(rows: DataFrame, c: str, keys: list[str], order: list[str]) -> DataFrame:
    """For each (keys, RUN) of a key that lies in several runs: rows of the key before the
    run (_before), the value and position of the key's last value before the run (_cv, _cp)
    and of its first value after it (_dv, _dp)."""
    at, there = order_struct(order), F.col(c).isNotNull()
    known = F.when(there, at)
    summary = rows.groupBy(*keys, RUN).agg(F.count(F.lit(1)).alias("_rows"), F.max_by(c, known).alias("_lv"), F.max(known).alias("_lo"),
                                          F.min_by(c, known).alias("_fv"), F.min(known).alias("_fo"))
    if keys:
        # the first and the last key of a run are all that other runs can share
        several = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
        summary = summary.withColumn("_several", several).where("_several").drop("_several")
    summary = hold(summary, "runs")
    # positions of those values in their run: the rows before the first and after the last one
    own = summary.select(*[F.col(k).alias(f"_s_{k}") for k in [*keys, RUN]], "_lo", "_fo")
    same = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in [*keys, RUN]]
    edges = rows.select(*keys, RUN, at.alias("_at")).join(F.broadcast(own), same).where((F.col("_at") > F.col("_lo")) | (F.col("_at") < F.col("_fo")))
    edges = edges.groupBy(*keys, RUN).agg(F.count_if(F.col("_at") > F.col("_lo")).alias("_tail"), F.count_if(F.col("_at") < F.col("_fo")).alias("_head"))
    edges = edges.select(*[F.col(k).alias(f"_s_{k}") for k in [*keys, RUN]], "_tail", "_head")
    summary = summary.join(edges, same, "left").drop(*[f"_s_{k}" for k in [*keys, RUN]])
    up = Window.partitionBy(*keys).orderBy(F.col(RUN)).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.col(RUN).desc()).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("_before", F.coalesce(F.sum("_rows").over(up), F.lit(0)))
    tail, head = (F.coalesce(F.col(x), F.lit(0)) for x in ("_tail", "_head"))
    summary = summary.withColumn("_lp", F.when(F.col("_lo").isNotNull(), F.col("_before") + F.col("_rows") - 1 - tail))
    summary = summary.withColumn("_fp", F.when(F.col("_fo").isNotNull(), F.col("_before") + head))
    return summary.select(*keys, RUN, "_before", F.last("_lv", True).over(up).alias("_cv"), F.last("_lp", True).over(up).alias("_cp"),
                          F.last("_fv", True).over(down).alias("_dv"), F.last("_fp", True).over(down).alias("_dp"))


def neighbours(df: DataFrame, c: str, order_by: Sequence[str] | None = None,
               keys: Sequence[str] = (), runs: int | None = None, back: bool = True, ahead: bool = True) -> DataFrame:
    """Add, for every row, its position in its key (`_pos`), the previous non-null value of `c`
    and its position (`_pv`, `_pp`, current row included; `back`) and the next one (`_nv`,
    `_np`; `ahead`), within the same key."""
    keys = list(keys)
    order_by = list(order_by) if order_by else [ROW_ID] if ROW_ID in df.columns else None
    if order_by is None:
        raise ValueError("a fill in row order needs order_by (a total order) or a _row_id column")
    order = list(dict.fromkeys([*keys, *order_by]))
    runs = runs or runs_of(df)
    cuts = cut_points(df, order, runs)
    data = place(df, order, cuts)
    narrow = place(df.select(*dict.fromkeys([*order, c])), order, cuts)
    # two rows for each run at most: a proven bound for the broadcast
    carry = F.broadcast(hold(_carry(narrow, c, keys, order), "carry").withColumnsRenamed({k: f"_ck_{k}" for k in [*keys, RUN]}))
    on = [F.col(k).eqNullSafe(F.col(f"_ck_{k}")) for k in [*keys, RUN]]
    data = data.join(carry, on, "left").drop(*[f"_ck_{k}" for k in [*keys, RUN]]).repartition(runs, RUN)
    # Both directions use running frames (unbounded preceding → current row, O(n) per group); the
    # "next" value runs over the reversed order, since a current-row → unbounded-following
    # frame is re-evaluated per row.
    up = Window.partitionBy(*keys, RUN).orderBy(*order_by)
    down = Window.partitionBy(*keys, RUN).orderBy(*[F.desc(x) for x in order_by]).rowsBetween(Window.unboundedPreceding, 0)
    upto = up.rowsBetween(Window.unboundedPreceding, 0)
    data = data.withColumn("_pos", F.coalesce("_before", F.lit(0)) + F.row_number().over(up) - 1)
    at = F.when(F.col(c).isNotNull(), F.col("_pos"))
    if back:
        data = data.withColumns({"_pv": F.coalesce(F.last(c, True).over(upto), "_cv"), "_pp": F.coalesce(F.last(at, True).over(upto), "_cp")})
    if ahead:
        data = data.withColumns({"_nv": F.coalesce(F.last(c, True).over(down), "_dv"), "_np": F.coalesce(F.last(at, True).over(down), "_dp")})
    return data.drop("_before", "_cv", "_cp", "_dv", "_dp", RUN)


def fills(df: DataFrame, c: str, order_by=None, keys: Sequence[str] = (), runs: int | None = None,
          names=("ffill", "bfill", "interpolated")) -> DataFrame:
    """N7, N8 and N9 together from ONE neighbour pass."""
    n = neighbours(df, c, order_by, keys, runs)
    return n.withColumns({names[0]: F.col("_pv"), names[1]: F.col("_nv"),
                          names[2]: _interp(F.col(c))}).drop("_pv", "_pp", "_nv", "_np", "_pos")


def _interp(x: Column) -> Column:
    pv, pp, nv, np_, pos = (F.col(n) for n in ("_pv", "_pp", "_nv", "_np", "_pos"))
    lin = pv + (nv - pv) * (pos - pp).cast("double") / (np_ - pp).cast("double")
    return (F.when(x.isNotNull(), x.cast("double"))
             .when(pv.isNull(), F.lit(None).cast("double"))
             .when(nv.isNull(), pv.cast("double"))
             .otherwise(lin))


def ffill(df: DataFrame, c: str, order_by=None, keys: Sequence[str] = (), out: str | None = None,
          runs: int | None = None) -> DataFrame:
    """Last non-null value in row order; leading nulls stay."""
    n = neighbours(df, c, order_by, keys, runs, ahead=False)
    return n.withColumn(out or c, F.col("_pv")).drop("_pv", "_pp", "_nv", "_np", "_pos")


def bfill(df: DataFrame, c: str, order_by=None, keys: Sequence[str] = (), out: str | None = None,
          runs: int | None = None) -> DataFrame:
    """Next non-null value in row order; trailing nulls stay."""
    n = neighbours(df, c, order_by, keys, runs, back=False)
    return n.withColumn(out or c, F.col("_nv")).drop("_pv", "_pp", "_nv", "_np", "_pos")


def interpolate(df: DataFrame, c: str, order_by=None, keys: Sequence[str] = (), out: str | None = None,
                runs: int | None = None) -> DataFrame:
    """Linear in row position (pandas default): leading nulls stay,
    trailing nulls take the last value."""
    n = neighbours(df, c, order_by, keys, runs)
    return n.withColumn(out or c, _interp(F.col(c))).drop("_pv", "_pp", "_nv", "_np", "_pos")


def column_mode(df: DataFrame, c: str):
    """Most frequent non-null value, smallest on ties. A `groupBy` count
    (partial aggregation, scales with distinct values) and a top-1."""
    r = (df.filter(F.col(c).isNotNull()).groupBy(c).count()
           .orderBy(F.desc("count"), F.asc(c)).limit(1).collect())
    return r[0][0] if r else None


def fill_value(df: DataFrame, c: str, method: str, custom=None):
    """The constant that N1–N6, N10 put in place of nulls (one aggregate):
    N1 mean, N2 exact median, N3 mode (smallest on ties), N4 zero, N5 empty,
    N6 'Unknown', N10 custom."""
    dtype = df.schema[c].dataType
    is_num = isinstance(dtype, NumericType)
    m = method.lower()
    if m in ("mean", "median"):
        if not is_num:
            raise ValueError(f"{method} needs a numeric column")
        if m == "mean":
            return df.agg(F.avg(F.col(c).cast("double")).alias("v")).first()["v"]
        from cirrus.operators.quantiles import quantile_row
        q = quantile_row(df, c, [0.5])
        return q[0] if q else None
    if m == "mode":
        return column_mode(df, c)
    if m == "zero":
        return 0 if is_num else "0"
    if m in ("empty", "unknown"):
        if is_num:
            raise ValueError(f"{method} fill is for text columns")
        return "" if m == "empty" else "Unknown"
    if m == "custom":
        return float(custom) if is_num else str(custom)
    raise ValueError(f"unknown fill method: {method}")


def fill_nulls(df: DataFrame, c: str, method: str, custom=None, order_by=None,
               keys: Sequence[str] = ()) -> DataFrame:
    """N1–N10 in one entry point."""
    m = method.lower()
    if m == "ffill":
        return ffill(df, c, order_by, keys)
    if m == "bfill":
        return bfill(df, c, order_by, keys)
    if m == "interpolate":
        return interpolate(df, c, order_by, keys)
    v = fill_value(df, c, m, custom)
    dtype = df.schema[c].dataType
    lit = F.lit(v)
    if isinstance(dtype, NumericType):
        target = dtype if m in ("zero", "mode") else "double"
        return df.withColumn(c, F.coalesce(F.col(c).cast(target), lit.cast(target)))
    return df.withColumn(c, F.coalesce(F.col(c), lit.cast(dtype)))


def impute_for_training(df: DataFrame, features: Sequence[str], target: str | None = None,
                        target_by_mode: bool = False, encode: bool = True) -> DataFrame:
    """Numeric features by mean, text features by most frequent
    value and then, with `encode`, as label codes (sorted order); the target
    by its mode when asked. One aggregate for all means."""
    num = [c for c in features if isinstance(df.schema[c].dataType, NumericType)]
    txt = [c for c in features if isinstance(df.schema[c].dataType, StringType)]
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in num]).first() if num else {}
    out = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) for c in num})
    for c in txt:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(column_mode(df, c))))
        if encode:
            out = label_encode(out, c)
    if target and target_by_mode:
        out = out.withColumn(target, F.coalesce(F.col(target), F.lit(column_mode(df, target))))
    return out
