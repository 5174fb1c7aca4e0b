"""Registered queries for user functions (UD1–UD5), the live summary
(ST1), sinks (S6–S8, S12, S13), detection (D1–D4, D8, D10) and the report
(S9)."""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from cirrus.functions import udf as U
from cirrus.functions.convert import DATE_FORMATS as C_DATE_FORMATS
from cirrus.operators import detect as D
from cirrus.operators import profile as A
from cirrus.operators import split as S
from cirrus.plans import report as REP
from cirrus.operators.normalize import NUMERIC_METHODS
from cirrus.registry.base import R, Registry, load, rnd
from cirrus.registry.profiles import EVENTS_WITH_NULLS, _report_sql, events_with_nulls
from cirrus.registry.rows import EV_RID, TR, VA, TE, d
from cirrus.session import ensure_checkpoint_dir
from cirrus.sources import sinks as SK
from cirrus.sources.ingest import with_row_id
from cirrus.streaming import live

reg = Registry()


def _scaled_log(value, stats):
    if value <= 0:
        raise ValueError("non-positive value")
    return math.log(value) / math.log(stats["max"])


@reg.add("ud1_ud3_value_function", f"""WITH s AS (SELECT max(value) AS mx FROM {EVENTS_WITH_NULLS})
    SELECT event_id, CASE WHEN value IS NULL OR value <= 0 THEN NULL ELSE {R('ln(value) / ln(mx)', 9)} END AS value,
    CASE WHEN value IS NOT NULL AND value <= 0 THEN 'ValueError: non-positive value' END AS value_error
    FROM {EVENTS_WITH_NULLS}, s""")
def ud1(spark, sf):
    e = events_with_nulls(spark, sf).select("event_id", "value")
    out = U.apply_value_function(e, "value", _scaled_log, DoubleType(), with_stats=True)
    return out.select("event_id", rnd("value", 9).alias("value"), "value_error")


def _split_props(value):
    k = int(value.split(":")[1].strip(" }"))
    if k % 10 == 0:
        raise KeyError("round k")
    return {"k": k, "k_bucket": "high" if k >= 50 else "low"}


UD2_SCHEMA = StructType([StructField("k", LongType()), StructField("k_bucket", StringType())])


@reg.add("ud2_ud5_dict_function_errors", f"""WITH r AS (SELECT event_id,
      TRY_CAST(trim(split_part(props, ':', 2), ' }}') AS BIGINT) AS k FROM {EVENTS_WITH_NULLS} WHERE props IS NOT NULL)
    SELECT 'KeyError: ''round k''' AS _error, count(*) AS count, (SELECT string_agg(props, '|' ORDER BY props) FROM
      (SELECT DISTINCT props FROM {EVENTS_WITH_NULLS} WHERE TRY_CAST(trim(split_part(props, ':', 2), ' }}') AS BIGINT) % 10 = 0
       ORDER BY props LIMIT 5)) AS examples FROM r WHERE k % 10 = 0""")
def ud2(spark, sf):
    e = events_with_nulls(spark, sf).select("event_id", "props").filter(F.col("props").isNotNull())
    out = U.apply_dict_function(e, "props", _split_props, UD2_SCHEMA)
    return U.error_summary(out, "_error", "props").select("_error", "count", F.array_join("examples", "|").alias("examples"))


@reg.add("ud2_dict_function_columns", f"""WITH r AS (SELECT event_id, props,
      TRY_CAST(trim(split_part(props, ':', 2), ' }}') AS BIGINT) AS k FROM {EVENTS_WITH_NULLS})
    SELECT event_id, CASE WHEN k % 10 <> 0 THEN k END AS k,
      CASE WHEN props IS NULL THEN NULL WHEN k % 10 = 0 THEN '' WHEN k >= 50 THEN 'high' ELSE 'low' END AS k_bucket,
      CASE WHEN k % 10 = 0 THEN 'KeyError: ''round k''' END AS _error FROM r""")
def ud2_columns(spark, sf):
    e = events_with_nulls(spark, sf).select("event_id", "props")
    return U.apply_dict_function(e, "props", _split_props, UD2_SCHEMA).drop("props")


@reg.add("ud4_init_once_per_task", f"""SELECT event_id, {R('value - (SELECT avg(value) FROM events)', 9)} AS value
    FROM events""")
def ud4(spark, sf):
    e = load(spark, sf, "events").select("event_id", "value")

    def init(stats):
        return {"centre": stats["mean"]}

    out = U.apply_value_function(e, "value", lambda v, state: v - state["centre"], DoubleType(),
                                 with_stats=True, init=init)
    return out.select("event_id", rnd("value", 9).alias("value"))


@reg.add("st1_live_daily_summary", f"""WITH p AS (SELECT ts, event_type, value FROM events),
    m AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM p)
    SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
      event_type AS model_name, {R('avg(value)')} AS avg_accuracy, count(*) AS predictions
    FROM p, m GROUP BY 1, 2, 3, wm HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= wm""")
def st1(spark, sf):
    def prepare(raw):
        from cirrus.functions.convert import ntz_to_instant
        return raw.select(ntz_to_instant("ts").alias("created_at"),
                          F.col("event_type").alias("model_name"), F.col("value").alias("accuracy"))
    out = live.run_to_completion(spark, f"{sf.rstrip('/')}/events.parquet", prepare)
    from cirrus.functions.convert import instant_to_ntz
    return out.select(instant_to_ntz("window_start").alias("window_start"),
                      instant_to_ntz("window_end").alias("window_end"), "model_name",
                      rnd("avg_accuracy").alias("avg_accuracy"), "predictions")


def _scratch(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


@reg.add("s6_s7_split_export_roundtrip", f"""SELECT rid AS original_index, event_id, user_id, event_type
    FROM {EV_RID} WHERE rid >= floor(n * {d(TR + VA)})""")
def s6(spark, sf):
    e = with_row_id(load(spark, sf, "events").select("event_id", "ts", "user_id", "event_type"), ["ts", "event_id"])
    e = S.sequential_split(e, TR, VA, TE).drop("ts")
    path = _scratch(spark, "export")
    SK.export_split(e, "test", path)
    back = spark.read.option("header", True).schema(
        "original_index long, event_id long, user_id long, event_type string").csv(path)
    return back


@reg.add("s7_split_info", f"""SELECT 'events' AS name, 'sequential' AS method,
    CAST(count_if(rid < floor(n * {d(TR)})) AS BIGINT) AS train_rows,
    CAST(count_if(rid >= floor(n * {d(TR)}) AND rid < floor(n * {d(TR + VA)})) AS BIGINT) AS val_rows,
    CAST(count_if(rid >= floor(n * {d(TR + VA)})) AS BIGINT) AS test_rows, CAST(NULL AS BIGINT) AS seed,
    'event_id,ts,user_id,event_type,value,props,_row_id' AS columns FROM {EV_RID}""")
def s7(spark, sf):
    e = S.sequential_split(with_row_id(load(spark, sf, "events"), ["ts", "event_id"]), TR, VA, TE)
    return SK.split_info(e, "events", "sequential", None)


@reg.add("s8_json_safe", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN isinf(exp(l_quantity * 20.0)) THEN NULL ELSE {R('ln(exp(l_quantity * 20.0))')} END AS x
    FROM lineitem""")
def s8(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                             F.exp(F.col("l_quantity") * 20.0).alias("x"))
    safe = SK.json_safe(li)
    return safe.withColumn("x", rnd(F.ln("x")))


@reg.add("s12_s13_split_preview", f"""SELECT min(rid) AS min_index, max(rid) AS max_index, count(*) AS rows
    FROM {EV_RID} WHERE rid >= floor(n * {d(TR)}) AND rid < floor(n * {d(TR + VA)})""")
def s13(spark, sf):
    e = S.sequential_split(with_row_id(load(spark, sf, "events"), ["ts", "event_id"]), TR, VA, TE)
    _, rng, _, _ = SK.split_preview(e, "val", 20, ["value", "event_type"])
    return rng


@reg.add("s13_preview_rows", f"""SELECT event_id, rid AS _row_id FROM {EV_RID}
    WHERE rid >= floor(n * {d(TR)}) AND rid < floor(n * {d(TR + VA)}) ORDER BY rid LIMIT 20""")
def s13_rows(spark, sf):
    e = S.sequential_split(with_row_id(load(spark, sf, "events"), ["ts", "event_id"]), TR, VA, TE)
    head, _, _, _ = SK.split_preview(e, "val", 20, ["value", "event_type"])
    return head.select("event_id", "_row_id")


@reg.add("s13_preview_statistics", f"""WITH v AS (SELECT * FROM {EV_RID} WHERE rid >= floor(n * {d(TR)}) AND rid < floor(n * {d(TR + VA)}))
    SELECT 'value' AS "column", count(value) AS count, {R('avg(value)')} AS mean, {R('quantile_cont(value, 0.5)')} AS median,
      {R('min(value)')} AS min, {R('max(value)')} AS max FROM v""")
def s13_stats(spark, sf):
    e = S.sequential_split(with_row_id(load(spark, sf, "events"), ["ts", "event_id"]), TR, VA, TE)
    _, _, stats, _ = SK.split_preview(e, "val", 20, ["value", "event_type"])
    return stats.select("column", "count", *[rnd(c).alias(c) for c in ("mean", "median", "min", "max")])


@reg.add("s13_preview_value_counts", f"""SELECT event_type, count(*) AS count FROM {EV_RID}
    WHERE rid >= floor(n * {d(TR)}) AND rid < floor(n * {d(TR + VA)}) AND event_type IS NOT NULL GROUP BY event_type""")
def s13_counts(spark, sf):
    e = S.sequential_split(with_row_id(load(spark, sf, "events"), ["ts", "event_id"]), TR, VA, TE)
    _, _, _, counts = SK.split_preview(e, "val", 20, ["value", "event_type"])
    return counts["event_type"]


def _report(spark, sf):
    return REP.report(events_with_nulls(spark, sf), order_by=["event_id"])


@reg.add("s9_report_info", f"""SELECT count(*) AS rows, CAST(6 AS INTEGER) AS columns, (SELECT count(*) FROM {EVENTS_WITH_NULLS}) -
    (SELECT count(*) FROM (SELECT DISTINCT * FROM {EVENTS_WITH_NULLS})) AS duplicate_rows FROM {EVENTS_WITH_NULLS}""")
def s9_info(spark, sf):
    r = _report(spark, sf)
    return r["info"].crossJoin(r["duplicates"])  # two one-row tables


@reg.add("s9_report_missing", f"""SELECT * FROM ({" UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST(count_if({c} IS NULL) AS BIGINT) AS null_count,
    count_if({c} IS NULL) * 100.0 / count(*) AS null_pct FROM {EVENTS_WITH_NULLS}""" for c in ("event_type", "value", "props"))}) WHERE null_count > 0""")
def s9_missing(spark, sf):
    return _report(spark, sf)["missing"]


@reg.add("s9_report_preview", f"SELECT event_id, user_id, event_type FROM {EVENTS_WITH_NULLS} ORDER BY event_id LIMIT 10")
def s9_preview(spark, sf):
    return _report(spark, sf)["preview"].select("event_id", "user_id", "event_type")


@reg.add("d11_column_counts_and_statistics", f"""SELECT count(*) AS rows, count(value) AS non_null, count(DISTINCT value) AS "distinct",
    {R('avg(value)')} AS mean, {R('quantile_cont(value, 0.5)')} AS median FROM {EVENTS_WITH_NULLS}""")
def d11_counts(spark, sf):
    info = REP.column_info(events_with_nulls(spark, sf), "value")
    c = info["counts"].select("rows", "non_null", "distinct")
    return c.crossJoin(info["statistics"].select(rnd("mean").alias("mean"), rnd("median").alias("median")))


def _d1_sql(name, table, expr, order, numeric=False):
    sample = f"(SELECT {expr} AS v FROM {table} WHERE {expr} IS NOT NULL ORDER BY {order} LIMIT 100)"
    fits = [(f, f"(SELECT avg(CAST(try_strptime(v, '{f}') IS NOT NULL AS INTEGER)) > 0.8 FROM {sample})") for f, _ in C_DATE_FORMATS]
    fmt = "CASE " + " ".join(f"WHEN {x} THEN '{f}'" for f, x in fits) + " END"
    num = f"(SELECT avg(CAST(TRY_CAST(trim(v) AS DOUBLE) IS NOT NULL AS INTEGER)) > 0.8 FROM {sample})"
    kind = "'numeric'" if numeric else (f"CASE WHEN {fmt} IS NOT NULL THEN 'datetime' WHEN {num} THEN 'numeric_string' "
                                        f"WHEN count(DISTINCT {expr}) < 50 THEN 'categorical' ELSE 'text' END")
    return (f"SELECT '{name}' AS \"column\", CASE WHEN count({expr}) < 100 THEN 'insufficient_data' ELSE {kind} END AS kind, "
            f"{'NULL' if numeric else f'CASE WHEN count({expr}) >= 100 THEN {fmt} END'} AS date_format, "
            f"count({expr}) AS non_null, count(DISTINCT {expr}) AS distinct_count FROM {table}")


@reg.add("d1_column_kinds", " UNION ALL ".join([
    *[_d1_sql(c, "documents", c, "doc_id", c == "n_chars") for c in ("lang", "source", "text", "n_chars")],
    _d1_sql("ts_text", "events", "strftime(ts, '%Y-%m-%d %H:%M:%S')", "ts, event_id"),
    _d1_sql("v_text", "events", "CAST(value AS VARCHAR)", "ts, event_id"),
    _d1_sql("event_type", "events", "event_type", "ts, event_id"), _d1_sql("props", "events", "props", "ts, event_id")]))
def d1(spark, sf):
    d_ = load(spark, sf, "documents")
    e = load(spark, sf, "events")
    a = D.column_kinds(with_row_id(d_, ["doc_id"]), ["lang", "source", "text", "n_chars"])
    b = D.column_kinds(with_row_id(e.withColumn("ts_text", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
                                   .withColumn("v_text", F.col("value").cast("string")), ["ts", "event_id"]),
                       ["ts_text", "v_text", "event_type", "props"])
    return a.unionByName(b)


@reg.add("d2_d3_coarse_kinds", """SELECT 'v_text' AS "column",
    CASE WHEN count_if(TRY_CAST(trim(v_text) AS DOUBLE) IS NOT NULL) > count(v_text) * 0.5 THEN 'numeric' ELSE 'text' END AS coarse_kind,
    count_if(TRY_CAST(trim(v_text) AS DOUBLE) IS NOT NULL) > count(*) * 0.8 AS numeric_string
    FROM (SELECT CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS v_text FROM events)
    UNION ALL SELECT 'event_type', 'text', false FROM (SELECT 1)""")
def d2(spark, sf):
    e = load(spark, sf, "events").select(
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string")).alias("v_text"),
        "event_type")
    return D.coarse_kinds(e, ["v_text", "event_type"])


def _d4_sql(name, expr):
    v = f"TRY_CAST(trim({expr}) AS DOUBLE)"
    dates = "coalesce(" + ", ".join(f"try_strptime({expr}, '{f}')" for f, _ in C_DATE_FORMATS) + ")"
    return (f"SELECT '{name}' AS \"column\", CASE WHEN count(*) = 0 THEN 'text' "
            f"WHEN count_if({expr} IN ('true', 'false', 'True', 'False')) = count(*) THEN 'boolean' "
            f"WHEN count_if({v} IS NOT NULL AND {v} = floor({v})) = count(*) THEN 'integer' "
            f"WHEN count_if({v} IS NOT NULL) = count(*) THEN 'float' "
            f"WHEN count_if({dates} IS NOT NULL) = count(*) THEN 'datetime' ELSE 'text' END AS kind, "
            f"min({v}) AS lo, max({v}) AS hi FROM events WHERE {expr} IS NOT NULL")


# text columns made of the events table, one of each kind
D4_COLUMNS = {
    "a": "CAST(user_id AS VARCHAR)", "b": "CAST(value AS VARCHAR)", "c": "strftime(ts, '%Y-%m-%d')",
    "event_type": "event_type", "bits": "CAST(event_id % 2 AS VARCHAR)",
    "flag": "CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'false' END",
    "yes": "CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END",
    "big": "CAST(event_id * 3000000000 + 3000000000 AS VARCHAR)",
}


@reg.add("d4_output_dtype", "SELECT \"column\", kind, CASE kind WHEN 'boolean' THEN 'bool' "
         "WHEN 'integer' THEN CASE WHEN lo >= -2147483648 AND hi <= 2147483647 THEN 'int32' ELSE 'int64' END "
         "WHEN 'float' THEN 'float64' WHEN 'datetime' THEN 'datetime64' ELSE 'string' END AS dtype FROM ("
         + " UNION ALL ".join(_d4_sql(c, x) for c, x in D4_COLUMNS.items()) + ")")
def d4(spark, sf):
    k = F.col("event_id")
    e = load(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("a"), F.col("value").cast("string").alias("b"),
        F.date_format("ts", "yyyy-MM-dd").alias("c"), "event_type", (k % 2).cast("string").alias("bits"),
        F.when(k % 2 == 0, "True").otherwise("false").alias("flag"),
        F.when(k % 2 == 0, "yes").otherwise("no").alias("yes"),
        (k * 3_000_000_000 + 3_000_000_000).cast("string").alias("big"))
    out = None
    for c in D4_COLUMNS:
        x = D.output_dtype(e, c)
        out = x if out is None else out.unionByName(x)
    return out


@reg.add("d8_categorical_flags", """SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS distinct_count, true AS categorical FROM orders
    UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), count(DISTINCT o_custkey) < 10 FROM orders
    UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), count(DISTINCT o_totalprice) < 10 FROM orders""")
def d8(spark, sf):
    return D.categorical_flags(load(spark, sf, "orders"), ["o_orderstatus", "o_custkey", "o_totalprice"])


D10_J = """(SELECT o_totalprice, gross, next_qty, disc, o_totalprice * 2 AS o_totalprice_copy FROM orders
    JOIN (SELECT l_orderkey, sum(l_extendedprice) AS gross, sum(l_quantity) AS next_qty, avg(l_discount) AS disc
          FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""


def _d10_part(c, words):
    r = f"corr({c}, o_totalprice)"
    base = ",".join(words)
    with_corr = ",".join(words + ["correlation"])
    other = f"'{base}'" if base else "NULL"
    return (f"SELECT '{c}' AS \"column\", {R(r)} AS corr_with_target, "
            f"CASE WHEN abs({r}) > 0.99 THEN '{with_corr}' ELSE {other} END AS reasons FROM {D10_J}")


@reg.add("d10_leak_check", " UNION ALL ".join([
    _d10_part("gross", []), _d10_part("next_qty", ["next"]), _d10_part("disc", []),
    _d10_part("o_totalprice_copy", ["target name"])]))
def d10(spark, sf):
    li = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_extendedprice").alias("gross"), F.sum("l_quantity").alias("next_qty"),
        F.avg("l_discount").alias("disc"))
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    j = o.join(li, o.o_orderkey == li.l_orderkey).withColumn("o_totalprice_copy", F.col("o_totalprice") * 2)
    out = D.leak_check(j, ["gross", "next_qty", "disc", "o_totalprice_copy"], "o_totalprice")
    return out.withColumn("corr_with_target", rnd("corr_with_target"))


LI_REPORT_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax"]


@reg.add("s9_report_columns", _report_sql(LI_REPORT_COLS, "lineitem"))
def s9(spark, sf):
    rep = REP.report(load(spark, sf, "lineitem"), order_by=["l_orderkey", "l_linenumber"])
    r = rep["column_analysis"]
    return r.withColumns({c: rnd(c) for c in ["mean", "std", "min", "q1", "median", "q3", "max", "null_pct"]})


@reg.add("x3_leave_one_group_out", """SELECT o_orderkey, o_orderpriority,
    CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS fold FROM orders""")
def x3(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return S.leave_one_group_out(o, "o_orderpriority")


@reg.add("x11_parquet_json_export_roundtrip", """SELECT c_custkey, c_name, c_acctbal FROM customer""")
def x11(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    base = _scratch(spark, "x11")
    p = SK.write_version(c, base, 1, "parquet", compression="zstd")
    j = os.path.join(base, "json")
    SK.export_json(spark.read.parquet(p), j)
    return spark.read.schema("c_custkey long, c_name string, c_acctbal double").json(j)


@reg.add("x12_grid_search")
def x12(spark, sf):
    from cirrus.plans import train as TRN
    from cirrus.registry.models import FEATS, _order_features
    rows = S.kfold(_order_features(spark, sf), ["o_orderkey"], 3, seed=42)
    m = TRN.grid_search(rows, FEATS, "o_totalprice", {"maxDepth": [2, 4]}, folds=3, model_type="decision_tree",
                        fold_col="fold")
    rows = [(i, float(v)) for i, v in enumerate(m.avgMetrics)]
    return spark.createDataFrame(rows, "grid_point int, avg_rmse double")


@reg.add("s1_csv_scan_inferred", """SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier""")
def s1(spark, sf):
    from cirrus.sources.ingest import read_csv
    path = _scratch(spark, "csv")
    SK.export_csv(load(spark, sf, "supplier").select(F.col("s_suppkey").alias(" s_suppkey "), "s_name",
                                                     "s_nationkey", "s_acctbal"), path)
    back = read_csv(spark, path)  # inferred types, trimmed names
    return back.select(F.col("s_suppkey").cast("long"), "s_name", F.col("s_nationkey").cast("int"), "s_acctbal")


@reg.add("s4_s5_s12_catalog", """SELECT 'orders' AS name, false AS is_normalized, CAST(NULL AS BIGINT) AS parent_id,
    CAST(1 AS BIGINT) AS root_id, (SELECT count(*) FROM orders) AS row_count, 6 AS column_count
    UNION ALL SELECT 'orders_copy', false, NULL, 2, (SELECT count(*) FROM orders), 6
    UNION ALL SELECT 'orders_normalized', true, 1, 1, (SELECT count(*) FROM orders), 6""")
def s4(spark, sf):
    from cirrus.operators import normalize as Z
    base = _scratch(spark, "catalog")
    cat = SK.Catalog(spark, os.path.join(base, "catalog"))
    o = load(spark, sf, "orders")
    first = cat.register(o, os.path.join(base, "d1"), "orders", user_id=7)
    cat.register(o, os.path.join(base, "d2"), "orders_copy", user_id=7)  # S5 duplicate under a new name
    norm = Z.normalize(o, ["o_totalprice"], "MIN_MAX")
    cat.register(norm, os.path.join(base, "d3"), "orders_normalized", user_id=7, parent_id=first, method="MIN_MAX")
    try:
        cat.register(o, os.path.join(base, "d4"), "orders", user_id=7)
        raise AssertionError("a duplicate (user, name) must be refused")
    except ValueError:
        pass
    return cat.table().select("name", "is_normalized", "parent_id", "root_id", "row_count", "column_count")


@reg.add("s10_model_save_load_score")
def s10(spark, sf):
    from cirrus.plans import train as TRN
    from cirrus.registry.models import FEATS, _order_features
    o = S.random_split(_order_features(spark, sf), ["o_orderkey"], 0.7, 0.15, 0.15, seed=42)
    res = TRN.train(o, FEATS, "o_totalprice", "decision_tree", {"max_depth": 4}, classification=False)
    path = _scratch(spark, "model")
    TRN.save_model(res.model, path)
    return TRN.score(TRN.load_model(path), o, keep=["o_orderkey"])


@reg.add("x1_remove_duplicate_full_rows", """SELECT DISTINCT * FROM (SELECT * FROM lineitem UNION ALL
    SELECT * FROM lineitem WHERE l_orderkey % 3 = 0)""")
def x1_full(spark, sf):
    li = load(spark, sf, "lineitem")
    return A.distinct_rows(li.unionByName(li.filter(F.col("l_orderkey") % 3 == 0)))


@reg.add("x1_remove_duplicate_rows", """SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem""")
def x1(spark, sf):
    """Remove duplicate rows."""
    return A.distinct_rows(load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@reg.add("d11_column_info", """SELECT o_orderstatus, count(*) AS count FROM orders WHERE o_orderstatus IS NOT NULL
    GROUP BY o_orderstatus""")
def d11(spark, sf):
    info = REP.column_info(load(spark, sf, "orders"), "o_orderstatus")
    return info["distribution"]


def _d9_text_sql(name, expr):
    num = f"count_if(TRY_CAST(trim({expr}) AS DOUBLE) IS NOT NULL) > count({expr}) * 0.5"
    text, every = "LOWER,STRIP,LABEL_ENCODING,ONE_HOT", ",".join(NUMERIC_METHODS) + ",LOWER,STRIP,LABEL_ENCODING,ONE_HOT"
    top = (f"(SELECT string_agg(v, ',' ORDER BY n DESC, v) FROM (SELECT {expr} AS v, count(*) AS n FROM events "
           f"WHERE {expr} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 3))")
    return (f"SELECT '{name}', CASE WHEN {num} THEN 'numeric' ELSE 'text' END, CASE WHEN {num} THEN '{every}' ELSE '{text}' END, "
            f"NULL, NULL, NULL, NULL, count(DISTINCT {expr}), {top} FROM events")


@reg.add("d9_available_normalizers", f"""SELECT 'value' AS "column", 'numeric' AS kind, '{",".join(NUMERIC_METHODS)}' AS methods,
    {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS std, {R('min(value)')} AS min, {R('max(value)')} AS max,
    CAST(NULL AS BIGINT) AS distinct_count, CAST(NULL AS VARCHAR) AS top3 FROM events
    UNION ALL {_d9_text_sql("event_type", "event_type")} UNION ALL {_d9_text_sql("uid_text", "CAST(user_id AS VARCHAR)")}""")
def d9(spark, sf):
    e = load(spark, sf, "events").select("value", "event_type", F.col("user_id").cast("string").alias("uid_text"))
    return REP.available_normalizers(e).withColumns({c: rnd(c) for c in ("mean", "std", "min", "max")})


@reg.add("z16_chain_preview", f"""WITH a AS (SELECT *, {R("(l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ())")} AS q
    FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q AS l_quantity FROM a
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000""")
def z16(spark, sf):
    from cirrus.plans import chain as CH
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    p = CH.preview(li, {"l_quantity": "MIN_MAX"}, 1000, order_by=["l_orderkey", "l_linenumber", "l_partkey",
                                                                  "l_suppkey"])
    return p.withColumn("l_quantity", rnd("l_quantity"))


@reg.add("j3_unique_value_mapping", f"""WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
    d AS (SELECT DISTINCT l_quantity AS original FROM lineitem WHERE l_quantity IS NOT NULL)
    SELECT original, {R('(original - lo) / (hi - lo)')} AS normalized FROM d, s""")
def j3(spark, sf):
    from cirrus.plans import chain as CH
    m = CH.unique_mapping(load(spark, sf, "lineitem"), "l_quantity", "MIN_MAX", 100)
    return m.withColumn("normalized", rnd("normalized"))


@reg.add("j3_unique_value_mapping_spaced", """WITH d AS (SELECT DISTINCT p_type AS original FROM part),
    r AS (SELECT original, row_number() OVER (ORDER BY original) - 1 AS k, count(*) OVER () AS n FROM d)
    SELECT original, lower(original) AS normalized FROM r WHERE k % CAST(ceil(n / 4.0) AS BIGINT) = 0""")
def j3b(spark, sf):
    from cirrus.plans import chain as CH
    return CH.unique_mapping(load(spark, sf, "part"), "p_type", "LOWER", 4)
