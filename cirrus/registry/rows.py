"""Registered row-order queries: splits (SP), folds (CV), fills (N, W5),
sequence windows (W, X9, X10), set operations (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cirrus.operators import nulls as N
from cirrus.operators import profile as A
from cirrus.operators import sequences as W
from cirrus.operators import split as S
from cirrus.registry.base import R, Registry, load, rnd
from cirrus.registry.profiles import EVENTS_WITH_NULLS, events_with_nulls
from cirrus.sources.ingest import with_row_id

reg = Registry()

LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]  # unique row key
LI_COLS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
LI_HASH = ("md5(concat_ws(':', '42', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
           "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)))")
TR, VA, TE = 0.7, 0.15, 0.15


def d(x: float) -> str:
    """A Python double as a DuckDB DOUBLE literal (same bits)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


# ------------------------------------------------------------------ splits
SP1_SQL = f"""WITH r AS (SELECT {LI_COLS},
      row_number() OVER (ORDER BY {LI_HASH}, {LI_COLS}) - 1 AS rk, count(*) OVER () AS n FROM lineitem),
    c AS (SELECT *, ceil({d(TE)} * n) AS nt FROM r)
    SELECT {LI_COLS}, CASE WHEN rk < nt THEN 'test'
        WHEN rk < nt + ceil({d(VA / (TR + VA))} * (n - nt)) THEN 'val' ELSE 'train' END AS split FROM c"""


@reg.add("sp1_random_split", SP1_SQL)
def sp1(spark, sf):
    li = load(spark, sf, "lineitem").select(*LI_KEY)
    return S.random_split(li, LI_KEY, TR, VA, TE, seed=42)


@reg.add("sp2_random_split_indices", f"""WITH r AS (SELECT {LI_COLS},
      row_number() OVER (ORDER BY {LI_HASH}, {LI_COLS}) - 1 AS rk, count(*) OVER () AS n FROM lineitem)
    SELECT {LI_COLS}, CASE WHEN rk < floor(n * {d(TR)}) THEN 'train'
        WHEN rk < floor(n * {d(TR + VA)}) THEN 'val' ELSE 'test' END AS split FROM r""")
def sp2(spark, sf):
    li = load(spark, sf, "lineitem").select(*LI_KEY)
    return S.random_split_indices(li, LI_KEY, TR, VA, TE, seed=42)


@reg.add("sp3_stratified_split", f"""WITH r AS (SELECT {LI_COLS},
      row_number() OVER (PARTITION BY l_returnflag ORDER BY {LI_HASH}, {LI_COLS}) - 1 AS rk,
      count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
    c AS (SELECT *, ceil(n * {d(TE)}) AS nt FROM r)
    SELECT {LI_COLS}, CASE WHEN rk < nt THEN 'test'
        WHEN rk < nt + ceil({d(VA / (TR + VA))} * (n - nt)) THEN 'val' ELSE 'train' END AS split FROM c""")
def sp3(spark, sf):
    li = load(spark, sf, "lineitem").select(*LI_KEY, "l_returnflag")
    return S.stratified_split(li, "l_returnflag", LI_KEY, TR, VA, TE, seed=42).drop("l_returnflag")


# a quarter of the rows without a class, a group or both
LI_NULL_CLASS = "CASE WHEN l_linenumber % 4 <> 0 THEN l_returnflag END"


@reg.add("sp3_stratified_split_null_classes", f"""WITH r AS (SELECT {LI_COLS}, {LI_NULL_CLASS} AS cls,
      row_number() OVER (PARTITION BY {LI_NULL_CLASS} ORDER BY {LI_HASH}, {LI_COLS}) - 1 AS rk,
      count(*) OVER (PARTITION BY {LI_NULL_CLASS}) AS n FROM lineitem),
    c AS (SELECT *, ceil(n * {d(TE)}) AS nt FROM r)
    SELECT {LI_COLS}, cls, CASE WHEN rk < nt THEN 'test'
        WHEN rk < nt + ceil({d(VA / (TR + VA))} * (n - nt)) THEN 'val' ELSE 'train' END AS split FROM c""")
def sp3_null(spark, sf):
    li = load(spark, sf, "lineitem")
    li = li.select(*LI_KEY, F.when(F.col("l_linenumber") % 4 != 0, F.col("l_returnflag")).alias("cls"))
    return S.stratified_split(li, "cls", LI_KEY, TR, VA, TE, seed=42)


@reg.add("sp4_group_split_null_group", f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS grp FROM orders),
    g AS (SELECT grp, row_number() OVER (ORDER BY md5(concat_ws(':', '42', CAST(grp AS VARCHAR))), grp) - 1 AS gk,
      count(*) OVER () AS gn FROM (SELECT DISTINCT grp FROM o))
    SELECT o_orderkey, o.grp, CASE WHEN gk < floor(gn * {d(TR)}) THEN 'train'
        WHEN gk < floor(gn * {d(TR)}) + floor(gn * {d(VA)}) THEN 'val' ELSE 'test' END AS split
    FROM o JOIN g ON o.grp IS NOT DISTINCT FROM g.grp""")
def sp4_null(spark, sf):
    o = load(spark, sf, "orders")
    o = o.select("o_orderkey", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("grp"))
    return S.group_split(o, "grp", TR, VA, TE, seed=42)


@reg.add("sp4_group_split", f"""WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY
      md5(concat_ws(':', '42', CAST(o_custkey AS VARCHAR))), o_custkey) - 1 AS gk, count(*) OVER () AS gn
      FROM (SELECT DISTINCT o_custkey FROM orders))
    SELECT o_orderkey, o.o_custkey, CASE WHEN gk < floor(gn * {d(TR)}) THEN 'train'
        WHEN gk < floor(gn * {d(TR)}) + floor(gn * {d(VA)}) THEN 'val' ELSE 'test' END AS split
    FROM orders o JOIN g ON o.o_custkey = g.o_custkey""")
def sp4(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return S.group_split(o, "o_custkey", TR, VA, TE, seed=42)


EV_RID = "(SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS rid, count(*) OVER () AS n FROM events)"


def events_rid(spark, sf):
    return with_row_id(load(spark, sf, "events"), ["ts", "event_id"])


@reg.add("sp5_temporal_holdout_gap", f"""SELECT event_id, CASE
    WHEN rid < floor(n * {d(TR)}) - 5 THEN 'train'
    WHEN rid >= floor(n * {d(TR)}) AND rid < floor(n * {d(TR + VA)}) - 5 THEN 'val'
    WHEN rid >= floor(n * {d(TR + VA)}) THEN 'test' END AS split FROM {EV_RID}""")
def sp5(spark, sf):
    return S.temporal_holdout(events_rid(spark, sf), TR, VA, TE, gap=5).select("event_id", "split")


@reg.add("sp6_temporal_blocked", f"""WITH r AS (SELECT event_id, rid, n, n // 10 AS b FROM {EV_RID}),
    nb AS (SELECT DISTINCT n // (n // 10) AS nb FROM r),
    blocks AS (SELECT range AS blk, row_number() OVER (ORDER BY md5(concat_ws(':', '42', CAST(range AS VARCHAR))), range) - 1 AS bo,
               nb FROM nb, range(nb.nb))
    SELECT event_id, CASE WHEN bo < floor(nb * {d(TR)}) THEN 'train'
        WHEN bo < floor(nb * {d(TR)}) + floor(nb * {d(VA)}) THEN 'val' WHEN bo IS NOT NULL THEN 'test' END AS split
    FROM r LEFT JOIN blocks ON r.rid // r.b = blocks.blk""")
def sp6(spark, sf):
    return S.temporal_blocked(events_rid(spark, sf), TR, VA, TE, seed=42).select("event_id", "split")


@reg.add("sp7_walk_forward", f"""WITH r AS (SELECT event_id, rid, n, n - n // 6 AS ts0 FROM {EV_RID})
    SELECT event_id, CASE WHEN rid < floor((ts0 - 3) * {d(TR / (TR + VA))}) THEN 'train'
        WHEN rid < ts0 - 3 THEN 'val' WHEN rid >= ts0 THEN 'test' END AS split FROM r""")
def sp7(spark, sf):
    return S.walk_forward(events_rid(spark, sf), TR, VA, TE, n_splits=5, gap=3).select("event_id", "split")


@reg.add("sp8_sequential_split", f"""SELECT event_id, CASE WHEN rid < floor(n * {d(TR)}) THEN 'train'
    WHEN rid < floor(n * {d(TR + VA)}) THEN 'val' ELSE 'test' END AS split FROM {EV_RID}""")
def sp8(spark, sf):
    return S.sequential_split(events_rid(spark, sf), TR, VA, TE).select("event_id", "split")


@reg.add("sp9_split_counts", f"""SELECT split, count(*) AS count,
    CAST(CASE split WHEN 'train' THEN 70 WHEN 'val' THEN 15 ELSE 15 END AS INTEGER) AS percentage
    FROM ({SP1_SQL}) GROUP BY split""")
def sp9(spark, sf):
    return S.split_counts(sp1(spark, sf), TR, VA, TE)


SP1_WITH_PRICE = SP1_SQL.replace(f"SELECT {LI_COLS},", f"SELECT {LI_COLS}, l_extendedprice,")


@reg.add("a27_target_stats_by_split", f"""SELECT split, 'l_extendedprice' AS "column", count(l_extendedprice) AS count,
    {R('avg(l_extendedprice)')} AS mean, {R('stddev_samp(l_extendedprice)')} AS std, {R('min(l_extendedprice)')} AS min,
    {R('quantile_cont(l_extendedprice, 0.25)')} AS q1, {R('quantile_cont(l_extendedprice, 0.5)')} AS median,
    {R('quantile_cont(l_extendedprice, 0.75)')} AS q3, {R('max(l_extendedprice)')} AS max
    FROM ({SP1_WITH_PRICE}) GROUP BY split""")
def a27(spark, sf):
    li = load(spark, sf, "lineitem").select(*LI_KEY, "l_extendedprice")
    s = S.random_split(li, LI_KEY, TR, VA, TE, seed=42)
    out = S.stats_by_split(s, "l_extendedprice")
    return out.withColumns({c: rnd(c) for c in ["mean", "std", "min", "q1", "median", "q3", "max"]})


@reg.add("u1_train_val_union", f"SELECT {LI_COLS} FROM ({SP1_SQL}) WHERE split IN ('train', 'val')")
def u1(spark, sf):
    return S.train_val_union(sp1(spark, sf)).select(*LI_KEY)


# ------------------------------------------------------------------- folds
OR_HASH = "md5(concat_ws(':', '42', CAST(o_orderkey AS VARCHAR)))"


def _kfold_sql(rank, n, k=5):
    q = f"({n} // {k})"
    rem = f"({n} % {k})"
    return (f"CAST(CASE WHEN {rank} < {rem} * ({q} + 1) THEN {rank} // ({q} + 1) "
            f"ELSE {rem} + ({rank} - {rem} * ({q} + 1)) // {q} END AS INTEGER)")


@reg.add("cv2_kfold", f"""SELECT o_orderkey, {_kfold_sql('rk', 'n')} AS fold FROM
    (SELECT o_orderkey, row_number() OVER (ORDER BY {OR_HASH}, o_orderkey) - 1 AS rk, count(*) OVER () AS n FROM orders)""")
def cv2(spark, sf):
    return S.kfold(load(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 5, seed=42)


@reg.add("cv3_stratified_kfold", f"""SELECT o_orderkey, CAST((row_number() OVER
    (ORDER BY o_orderstatus, {OR_HASH}, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders""")
def cv3(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return S.stratified_kfold(o, "o_orderstatus", ["o_orderkey"], 5, seed=42).drop("o_orderstatus")


@reg.add("cv3_stratified_kfold_null_classes", f"""SELECT o_orderkey, CAST((row_number() OVER
    (ORDER BY cls NULLS FIRST, {OR_HASH}, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM
    (SELECT o_orderkey, CASE WHEN o_custkey % 4 <> 0 THEN o_orderstatus END AS cls FROM orders)""")
def cv3_null(spark, sf):
    o = load(spark, sf, "orders")
    o = o.select("o_orderkey", F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderstatus")).alias("cls"))
    return S.stratified_kfold(o, "cls", ["o_orderkey"], 5, seed=42).drop("cls")


@reg.add("cv4_time_series_folds", f"""WITH r AS (SELECT event_id, rid, n, n // 6 AS ts FROM {EV_RID}),
    f AS (SELECT CAST(range AS INTEGER) AS fold FROM range(5))
    SELECT event_id, fold, CASE WHEN rid < n - (5 - fold) * ts - 2 THEN 'train' ELSE 'test' END AS role
    FROM r, f WHERE (rid < n - (5 - fold) * ts - 2) OR (rid >= n - (5 - fold) * ts AND rid < n - (5 - fold) * ts + ts)""")
def cv4(spark, sf):
    return S.time_series_folds(events_rid(spark, sf), 5, gap=2).select("event_id", "fold", "role")


@reg.add("cv5_leave_one_out", """SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS fold FROM labels""")
def cv5(spark, sf):
    lab = with_row_id(load(spark, sf, "labels"), ["doc_id"])
    return S.leave_one_out(lab).select("doc_id", "fold")


def _repeated_sql(stratified: bool):
    h = "md5(concat_ws(':', CAST(42 + rep AS VARCHAR), CAST(o_orderkey AS VARCHAR)))"
    order = f"o_orderstatus, {h}, o_orderkey" if stratified else f"{h}, o_orderkey"
    fold = ("CAST(rk % 5 AS INTEGER)" if stratified else _kfold_sql("rk", "n"))
    return f"""SELECT o_orderkey, CAST(rep AS INTEGER) AS repeat, {fold} AS fold FROM
    (SELECT o_orderkey, rep, row_number() OVER (PARTITION BY rep ORDER BY {order}) - 1 AS rk,
            count(*) OVER (PARTITION BY rep) AS n
     FROM orders, (SELECT range AS rep FROM range(3)))"""


@reg.add("cv6_repeated_kfold", _repeated_sql(False))
def cv6(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey")
    return S.repeated_kfold(o, ["o_orderkey"], 5, 3, seed=42)


@reg.add("cv7_repeated_stratified_kfold", _repeated_sql(True))
def cv7(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return S.repeated_kfold(o, ["o_orderkey"], 5, 3, seed=42, label="o_orderstatus").drop("o_orderstatus")


@reg.add("w7_running_mean_of_fold_scores", f"""WITH f AS ({_kfold_sql('rk', 'n')} AS fold, o_totalprice FROM
    (SELECT o_totalprice, row_number() OVER (ORDER BY {OR_HASH}, o_orderkey) - 1 AS rk, count(*) OVER () AS n FROM orders)),
    s AS (SELECT fold, avg(o_totalprice) AS score FROM f GROUP BY fold)
    SELECT fold, {R('score')} AS score, {R('avg(score) OVER (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')}
        AS running_mean FROM s""".replace("WITH f AS (CAST", "WITH f AS (SELECT CAST"))
def w7(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    folds = S.kfold(o, ["o_orderkey"], 5, seed=42)
    scores = folds.groupBy("fold").agg(F.avg("o_totalprice").alias("score"))  # one row per fold
    out = A.running_mean(scores, "score", "fold")
    return out.select("fold", rnd("score").alias("score"), rnd("running_mean").alias("running_mean"))


# ------------------------------------------------------------------- fills
EVN_RID = f"(SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS rid FROM {EVENTS_WITH_NULLS})"
FRAME_B = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
FRAME_F = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"


def _fill_sql(part: str = ""):
    p = f"PARTITION BY {part} " if part else ""
    return f"""WITH e AS (SELECT *, row_number() OVER ({p}ORDER BY ts, event_id) - 1 AS rid FROM {EVENTS_WITH_NULLS}),
      x AS (SELECT event_id, value, rid,
        last_value(value IGNORE NULLS) OVER ({p}ORDER BY ts, event_id {FRAME_B}) AS pv,
        last_value(CASE WHEN value IS NOT NULL THEN rid END IGNORE NULLS) OVER ({p}ORDER BY ts, event_id {FRAME_B}) AS pp,
        first_value(value IGNORE NULLS) OVER ({p}ORDER BY ts, event_id {FRAME_F}) AS nv,
        first_value(CASE WHEN value IS NOT NULL THEN rid END IGNORE NULLS) OVER ({p}ORDER BY ts, event_id {FRAME_F}) AS np
      FROM e)
    SELECT event_id, pv AS ffill, nv AS bfill,
      {R('CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (rid - pp) / (np - pp) END', 9)} AS interpolated
    FROM x"""


def _fills(spark, sf, keys=(), runs=None):
    e = events_with_nulls(spark, sf).select("event_id", "ts", "user_id", "value")
    f = N.fills(e, "value", ["ts", "event_id"], keys, runs=runs)
    return f.select("event_id", "ffill", "bfill", rnd("interpolated", 9).alias("interpolated"))


reg.add("n7_n9_fill_in_row_order", _fill_sql())(lambda spark, sf: _fills(spark, sf))
reg.add("n7_n9_fill_small_blocks", _fill_sql())(lambda spark, sf: _fills(spark, sf, runs=40))
reg.add("n7_n9_fill_per_user", _fill_sql("user_id"))(lambda spark, sf: _fills(spark, sf, ["user_id"], 64))


def _const_fill_sql():
    return f"""WITH s AS (SELECT avg(value) AS mu, quantile_cont(value, 0.5) AS med FROM {EVENTS_WITH_NULLS}),
    m AS (SELECT event_type AS mode_v FROM {EVENTS_WITH_NULLS} WHERE event_type IS NOT NULL
          GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)
    SELECT event_id, {R('coalesce(value, mu)')} AS mean_fill, {R('coalesce(value, med)')} AS median_fill,
      coalesce(value, 0.0) AS zero_fill, coalesce(event_type, mode_v) AS mode_fill,
      coalesce(event_type, '') AS empty_fill, coalesce(event_type, 'Unknown') AS unknown_fill,
      coalesce(props, '0') AS zero_text_fill, coalesce(value, -1.5) AS custom_fill
    FROM {EVENTS_WITH_NULLS}, s, m"""


@reg.add("n1_n10_constant_fills", _const_fill_sql())
def n_const(spark, sf):
    e = events_with_nulls(spark, sf)
    out = e.select("event_id", "value", "event_type", "props")
    out = out.withColumn("mean_fill", F.col("value")).withColumn("median_fill", F.col("value"))
    out = out.withColumn("zero_fill", F.col("value")).withColumn("custom_fill", F.col("value"))
    out = out.withColumn("mode_fill", F.col("event_type")).withColumn("empty_fill", F.col("event_type"))
    out = out.withColumn("unknown_fill", F.col("event_type")).withColumn("zero_text_fill", F.col("props"))
    for c, m in [("mean_fill", "mean"), ("median_fill", "median"), ("zero_fill", "zero"), ("mode_fill", "mode"),
                 ("empty_fill", "empty"), ("unknown_fill", "unknown"), ("zero_text_fill", "zero")]:
        out = N.fill_nulls(out, c, m)
    out = N.fill_nulls(out, "custom_fill", "custom", custom="-1.5")
    return out.select("event_id", rnd("mean_fill").alias("mean_fill"), rnd("median_fill").alias("median_fill"),
                      "zero_fill", "mode_fill", "empty_fill", "unknown_fill", "zero_text_fill", "custom_fill")


@reg.add("n11_n12_training_imputation", f"""WITH s AS (SELECT avg(value) AS mu FROM {EVENTS_WITH_NULLS}),
    m AS (SELECT event_type AS mode_v FROM {EVENTS_WITH_NULLS} WHERE event_type IS NOT NULL
          GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)
    SELECT event_id, {R('coalesce(value, mu)')} AS value, coalesce(event_type, mode_v) AS event_type
    FROM {EVENTS_WITH_NULLS}, s, m""")
def n11(spark, sf):
    e = events_with_nulls(spark, sf).select("event_id", "value", "event_type")
    out = N.impute_for_training(e, ["value"], target="event_type", target_by_mode=True)
    return out.select("event_id", rnd("value").alias("value"), "event_type")


@reg.add("n11_text_feature_codes", f"""WITH m AS (SELECT event_type AS mode_v FROM {EVENTS_WITH_NULLS} WHERE event_type IS NOT NULL
          GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1),
    f AS (SELECT event_id, coalesce(event_type, mode_v) AS t FROM {EVENTS_WITH_NULLS}, m)
    SELECT event_id, CAST(dense_rank() OVER (ORDER BY t) - 1 AS BIGINT) AS event_type FROM f""")
def n11_codes(spark, sf):
    e = events_with_nulls(spark, sf).select("event_id", "event_type")
    return N.impute_for_training(e, ["event_type"])


# ----------------------------------------------------------------- windows
@reg.add("w1_training_sequences", f"""SELECT event_id, list(value) OVER (ORDER BY ts, event_id
        ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS sequence, value AS target FROM events
    QUALIFY count(*) OVER (ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) = 10""")
def w1(spark, sf):
    e = load(spark, sf, "events").select("event_id", "ts", "value")
    s = W.training_sequences(e, ["value"], "value", 10, ["ts", "event_id"], runs=12)
    return s.select("event_id", "sequence", F.col("value").alias("target"))


@reg.add("w2_scoring_windows", f"""SELECT event_id, list(value) OVER (ORDER BY ts, event_id
        ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS sequence FROM events
    QUALIFY count(*) OVER (ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) = 10""")
def w2(spark, sf):
    e = load(spark, sf, "events").select("event_id", "ts", "value")
    return W.scoring_windows(e, ["value"], 10, ["ts", "event_id"], runs=12).select("event_id", "sequence")


@reg.add("w4_sequences_per_user", f"""SELECT event_id, user_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS sequence FROM events
    QUALIFY count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 5""")
def w4(spark, sf):
    e = load(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    s = W.training_sequences(e, ["value"], "value", 5, ["ts", "event_id"], keys=["user_id"], runs=24)
    return s.select("event_id", "user_id", "sequence")


@reg.add("x9_horizon_windows", f"""SELECT event_id,
    CAST(len(p) AS INTEGER) AS n_past, {R('list_sum(p)')} AS past_sum, p[1] AS past_first,
    CAST(len(f) AS INTEGER) AS n_future, {R('list_sum(f)')} AS future_sum, f[336] AS future_last
    FROM (SELECT event_id, list(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS p,
                 list(value) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 335 FOLLOWING) AS f FROM events)
    WHERE len(p) = 24 AND len(f) = 336""")
def x9(spark, sf):
    e = load(spark, sf, "events").select("event_id", "ts", "value")
    h = W.horizon_windows(e, "value", 24, 336, ["ts", "event_id"], runs=6)
    agg = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda a, v: a + v)
    return h.select("event_id", F.size("past").alias("n_past"), rnd(agg("past")).alias("past_sum"),
                    F.element_at("past", 1).alias("past_first"), F.size("future").alias("n_future"),
                    rnd(agg("future")).alias("future_sum"), F.element_at("future", -1).alias("future_last"))


@reg.add("x10_multiscale_pooling", f"""SELECT CAST(scale AS INTEGER) AS scale, CAST(rid // scale AS BIGINT) AS position,
    {R('avg(value)')} AS pooled FROM {EV_RID}, (SELECT unnest([1, 2, 4, 8]) AS scale) GROUP BY scale, rid // scale""")
def x10(spark, sf):
    p = W.multiscale_pool(events_rid(spark, sf), "value")
    return p.withColumn("pooled", rnd("pooled"))
