"""Sliding sequence windows.

A frame of L rows in global row order would need `Window.orderBy` without a
partition key (one task for the whole table). Instead the table is cut into runs
of its (keys, order) order (`placed`); two narrow passes over the order columns say
which rows lie within L rows of a run's edge, and those are also copied to the
neighbouring run (a halo), so every frame lies inside one run. The rows move
once, to their run; the window runs per (key, run) — bounded groups
whatever the key distribution — and the halo copies are dropped afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrus.operators.placed import RUN, cut_points, order_struct, place, runs_of
from cirrus.sources.held import hold
from cirrus.sources.ingest import ROW_ID

#: Rows of a run in a large table, which gets more runs than asked for, MAX_RUNS by this rule at most.
RUN_ROWS, MAX_RUNS = 100_000, 1000

def _wide_cuts(narrow: DataFrame, order: list[str], cuts: list, least: int) -> list:
    """`cuts` without those that leave fewer than `least` rows between them, so that a
    frame reaches into the neighbouring run at most."""
    if not cuts:
        return []
    counts = {r[RUN]: r["count"] for r in place(narrow, order, cuts).groupBy(RUN).count().collect()}  # a row for each run
    left, own, kept = sum(counts.values()), 0, []
    for i, cut in enumerate(cuts):
        n = counts.get(i, 0)
        own, left = own + n, left - n
        if own >= least and left >= least:
            kept.append(cut)
            own = 0
    return kept


def _haloed(df: DataFrame, order: list[str], before: int, after: int, runs: int) -> DataFrame:
    """Each row in its own run (`_home` = true) plus copies in the neighbouring
    runs whose frames reach it, moved to their run."""
    narrow = df.select(*[F.col(f"`{c}`") for c in order])
    cuts = _wide_cuts(narrow, order, cut_points(df, order, runs), max(before, after, 1))
    at = order_struct(order)
    targets = F.array(F.struct(F.col(RUN).alias("_blk"), F.lit(True).alias("_home")))
    data = place(df, order, cuts)
    if cuts:
        placed = place(narrow, order, cuts).select(RUN, at.alias("_at"))
        edges = None
        for name, n, key, end in (("_late", before, F.desc("_at"), F.min), ("_early", after, F.asc("_at"), F.max)):
            # tasks keep their own first rows of a run before they are shuffled
            rank = F.row_number().over(Window.partitionBy(RUN).orderBy(key))
            e = placed.withColumn("_n", rank).where(F.col("_n") <= n).groupBy(F.col(RUN).alias("_r")).agg(end("_at").alias(name)) if n else \
                placed.select(F.col(RUN).alias("_r")).distinct().withColumn(name, F.lit(None).cast(placed.schema["_at"].dataType))
            edges = e if edges is None else edges.join(e, "_r", "full")
        # one row for each run: a proven bound for the broadcast
        data = data.join(F.broadcast(hold(edges, "edges")), F.col(RUN) == F.col("_r"), "left")
        copy = lambda step: F.array(F.struct((F.col(RUN) + step).alias("_blk"), F.lit(False).alias("_home")))
        none = F.array().cast("array<struct<_blk:int,_home:boolean>>")
        targets = F.concat(targets, F.when((F.col(RUN) < len(cuts)) & (at >= F.col("_late")), copy(1)).otherwise(none),
                           F.when((F.col(RUN) > 0) & (at <= F.col("_early")), copy(-1)).otherwise(none))
    return data.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(targets)).repartition(max(1, len(cuts) + 1), "_blk")


def frames(df: DataFrame, cols: Sequence[str], before: int, after: int, order_by: Sequence[str] | None = None,
           keys: Sequence[str] = (), runs: int | None = None, name: str = "window") -> DataFrame:
    """Attach to every row the array of `cols` structs of the rows in
    [i−before, i+after] (same key), as `name`, with its size `<name>_size`. `runs` is the
    least number of runs: it grows with the rows, as a run is one task's."""
    keys = list(keys)
    if order_by is None and ROW_ID not in df.columns:
        raise ValueError("frames need order_by (a total order) or a _row_id column")
    order_by = list(order_by or [ROW_ID])
    runs = max(runs or runs_of(df), min(MAX_RUNS, df.count() // RUN_ROWS))
    h = _haloed(df, list(dict.fromkeys([*keys, *order_by])), before, after, runs)
    w = Window.partitionBy(*keys, "_blk").orderBy(*order_by).rowsBetween(-before, after)
    item = F.struct(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0])
    out = h.withColumn(name, F.collect_list(item).over(w)).filter("_home").drop("_blk", "_home")
    return out.withColumn(f"{name}_size", F.size(name))


def training_sequences(df: DataFrame, features: Sequence[str], target: str, length: int = 10,
                       order_by: Sequence[str] | None = None, keys: Sequence[str] = (),
                       runs: int | None = None) -> DataFrame:
    """W1/W3 (W4 with `keys`): the L previous rows' features → the target of
    the current row; rows without L predecessors (in the same key) are not
    sequences."""
    f = frames(df, features, length, 0, order_by, keys, runs, name="_w")
    # frame [i-L, i] includes the current row last: drop it
    seq = F.slice(F.col("_w"), 1, length)
    return (f.filter(F.col("_w_size") == length + 1)
             .withColumn("sequence", seq).drop("_w", "_w_size"))


def scoring_windows(df: DataFrame, features: Sequence[str], length: int = 10,
                    order_by: Sequence[str] | None = None, keys: Sequence[str] = (),
                    runs: int | None = None) -> DataFrame:
    """Rows [i−L+1, i]; the result belongs to the last row."""
    f = frames(df, features, length - 1, 0, order_by, keys, runs, name="sequence")
    return f.filter(F.col("sequence_size") == length).drop("sequence_size")


def horizon_windows(df: DataFrame, feature: str, past: int = 24, horizon: int = 336,
                    order_by: Sequence[str] | None = None, keys: Sequence[str] = (),
                    runs: int | None = None) -> DataFrame:
    """Input window of the `past` previous rows and target window of the
    next `horizon` rows (current row first); only complete windows."""
    f = frames(df, [feature], past, horizon - 1, order_by, keys, runs, name="_w")
    return (f.filter(F.col("_w_size") == past + horizon)
             .withColumn("past", F.slice("_w", 1, past))
             .withColumn("future", F.slice("_w", past + 1, horizon))
             .drop("_w", "_w_size"))


def multiscale_pool(df: DataFrame, value: str, scales: Sequence[int] = (1, 2, 4, 8),
                    row_id: str = ROW_ID) -> DataFrame:
    """Average of `value` over consecutive runs of s rows, for every
    scale s; one grouped aggregate over the union of scales."""
    s = df.select(F.col(row_id), F.col(value).cast("double").alias("_v"),
                  F.explode(F.array(*[F.lit(x) for x in scales])).alias("scale"))
    return (s.groupBy("scale", F.floor(F.col(row_id) / F.col("scale")).cast("long").alias("position"))
             .agg(F.avg("_v").alias("pooled")))


def sequence_stats(c: str | Column) -> list[Column]:
    """Digest columns of an array of doubles (size, sum, first, last)."""
    x = F.col(c) if isinstance(c, str) else c
    return [F.size(x).alias("n"), F.aggregate(x, F.lit(0.0), lambda a, v: a + v).alias("sum"),
            F.element_at(x, 1).alias("first"), F.element_at(x, -1).alias("last")]
