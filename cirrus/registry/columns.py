"""Registered column-operator queries: text (T), numeric (M), conversion
(C), date/map/JSON (DT, JM, X14), replacement (R), filters (F) and column
checks (P). Long texts are reported as (length, md5) of the WHOLE result."""

from __future__ import annotations

from pyspark.sql import functions as F

from cirrus.functions import convert as C
from cirrus.functions import numeric as M
from cirrus.functions import replace as RP
from cirrus.functions import text as T
from cirrus.operators import filters as FL
from cirrus.registry.base import PYROUND, R, Registry, load, rnd
from cirrus.registry.profiles import EVENTS_WITH_NULLS, events_with_nulls
from cirrus.sources.ingest import with_row_id

reg = Registry()
WS = T.WHITESPACE_CLASS


def _digest(df, key, expr, name="r"):
    """(key, length, md5) of a text result."""
    keys = key if isinstance(key, list) else [key]
    return df.select(*keys, F.length(expr).alias(f"{name}_len"), F.md5(expr).alias(f"{name}_md5"))


def _digest_sql(table, key, expr, name="r"):
    return f"SELECT {key}, CAST(length({expr}) AS INTEGER) AS {name}_len, md5({expr}) AS {name}_md5 FROM {table}"


# ------------------------------------------------------------------- text
@reg.add("t1_truncate_ellipsis", """SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...'
    ELSE text END AS r FROM documents""")
def t1(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", T.truncate("text", 50, True).alias("r"))


@reg.add("t2_extract", "SELECT doc_id, substr(text, 6, 20) AS r FROM documents")
def t2(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.extract("text", 5, 20).alias("r"))


@reg.add("t2_extract_negative_start", """SELECT doc_id,
    substr(text, greatest(length(text) - 12, 0) + 1,
           greatest(least(greatest(length(text) - 4, 0), length(text)) - greatest(length(text) - 12, 0), 0)) AS r
    FROM documents""")
def t2n(spark, sf):
    # Python text[-12:-4]
    return load(spark, sf, "documents").select("doc_id", T.extract("text", -12, 8).alias("r"))


@reg.add("t3_remove_chars", _digest_sql("documents", "doc_id", "translate(text, 'aeiou.,', '')"))
def t3(spark, sf):
    d = load(spark, sf, "documents")
    return _digest(d, "doc_id", T.remove_chars("text", "aeiou.,"))


@reg.add("t4_upper", _digest_sql("documents", "doc_id", "replace(upper(text), 'ẞ', 'SS')"))
def t4(spark, sf):
    d = load(spark, sf, "documents")
    return _digest(d, "doc_id", T.upper("text"))


@reg.add("t5_lower", _digest_sql("documents", "doc_id", "lower(text)"))
def t5(spark, sf):
    d = load(spark, sf, "documents")
    return _digest(d, "doc_id", T.lower("text"))


TITLE_SQL = """array_to_string(list_transform(string_split({x}, ''), lambda ch, i:
    CASE WHEN i = 1 OR upper(string_split({x}, '')[i - 1]) = lower(string_split({x}, '')[i - 1])
         THEN upper(ch) ELSE lower(ch) END), '')"""


@reg.add("t6_title_case", f"SELECT p_partkey, {TITLE_SQL.format(x='p_name')} AS r, "
         f"{TITLE_SQL.format(x='p_type')} AS r2 FROM part")
def t6(spark, sf):
    p = load(spark, sf, "part")
    return p.select("p_partkey", T.title("p_name").alias("r"), T.title("p_type").alias("r2"))


@reg.add("t7_capitalize", _digest_sql("conversations", "conv_id, turn",
                                      "upper(substr(text, 1, 1)) || lower(substr(text, 2))"))
def t7(spark, sf):
    c = load(spark, sf, "conversations")
    return _digest(c, ["conv_id", "turn"], T.capitalize("text"))


@reg.add("t8_trim_both", _digest_sql("conversations", "conv_id, turn",
                                     f"regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')"))
def t8(spark, sf):
    c = load(spark, sf, "conversations")
    return _digest(c, ["conv_id", "turn"], T.trim_ws("text"))


@reg.add("t8_trim_left_right", f"""SELECT doc_id, md5(regexp_replace(text, '^{WS}+', '')) AS l_md5,
    md5(regexp_replace(text, '{WS}+$', '')) AS r_md5 FROM documents""")
def t8lr(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.trim_ws("text", "left")).alias("l_md5"),
                    F.md5(T.trim_ws("text", "right")).alias("r_md5"))


def _split_sql(x, sep, part):
    parts = f"string_split({x}, '{sep}')"
    k = f"{part}" if part >= 0 else f"(len({parts}) + ({part}))"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {k} >= 0 AND {k} < len({parts}) "
            f"THEN regexp_replace({parts}[{k} + 1], '^{WS}+|{WS}+$', '', 'g') ELSE '' END")


@reg.add("t9_split_part", f"""SELECT page_id, {_split_sql('url', '/', 2)} AS host,
    {_split_sql('url', '/', -1)} AS tail, {_split_sql('url', '/', 9)} AS missing,
    {_split_sql('url', '.', 1)} AS dot1 FROM pages""")
def t9(spark, sf):
    p = load(spark, sf, "pages")
    return p.select("page_id", T.split_part("url", "/", 2).alias("host"), T.split_part("url", "/", -1).alias("tail"),
                    T.split_part("url", "/", 9).alias("missing"), T.split_part("url", ".", 1).alias("dot1"))


@reg.add("t10_t11_pad", """SELECT c_custkey,
    CASE WHEN length(c_name) < 20 THEN lpad(c_name, 20, '*') ELSE c_name END AS left_pad,
    CASE WHEN length(c_mktsegment) < 12 THEN rpad(c_mktsegment, 12, '-') ELSE c_mktsegment END AS right_pad,
    CASE WHEN length(c_name) < 3 THEN lpad(c_name, 3, '0') ELSE c_name END AS short_pad FROM customer""")
def t10(spark, sf):
    c = load(spark, sf, "customer")
    return c.select("c_custkey", T.pad("c_name", 20, "*", "left").alias("left_pad"),
                    T.pad("c_mktsegment", 12, "-", "right").alias("right_pad"),
                    T.pad("c_name", 3, "0", "left").alias("short_pad"))


# ---------------------------------------------------------------- numeric
NUM_SQL = f"""SELECT l_orderkey, l_linenumber,
    {PYROUND('l_extendedprice', 1)} AS round1,
    {PYROUND('l_discount', 2)} AS round2,
    floor(l_extendedprice / 7.0) AS floor7, ceil(l_extendedprice / 7.0) AS ceil7,
    {R('l_extendedprice * 3.6')} AS kmh,
    CASE WHEN l_quantity IS NOT NULL THEN least(greatest(l_quantity, 10.0), 40.0) END AS clipped,
    {R('l_extendedprice + 12.5')} AS added, {R('l_extendedprice - 12.5')} AS subtracted,
    {R('l_extendedprice * 0.3')} AS multiplied, {R('l_extendedprice / 3.0')} AS divided,
    CAST(NULL AS DOUBLE) AS divided_by_zero,
    {R('power(l_quantity, 2.0)')} AS squared,
    CASE WHEN l_extendedprice * 100 < 0 THEN ceil(l_extendedprice * 10.0) ELSE floor(l_extendedprice * 10.0) END / 10.0 AS trunc1,
    floor(l_extendedprice / 100.0) * 100.0 AS trunc_neg2
    FROM lineitem"""


@reg.add("m1_m11_numeric_ops", NUM_SQL)
def m_ops(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        M.round_even("l_extendedprice", 1).alias("round1"), M.round_even("l_discount", 2).alias("round2"),
        M.floor(F.col("l_extendedprice") / 7.0).alias("floor7"), M.ceil(F.col("l_extendedprice") / 7.0).alias("ceil7"),
        rnd(M.ms_to_kmh("l_extendedprice")).alias("kmh"), M.clip("l_quantity", 10, 40).alias("clipped"),
        rnd(M.arithmetic("l_extendedprice", "add", 12.5)).alias("added"),
        rnd(M.arithmetic("l_extendedprice", "subtract", 12.5)).alias("subtracted"),
        rnd(M.arithmetic("l_extendedprice", "multiply", 0.3)).alias("multiplied"),
        rnd(M.arithmetic("l_extendedprice", "divide", 3)).alias("divided"),
        M.arithmetic("l_extendedprice", "divide", 0).alias("divided_by_zero"),
        rnd(M.power("l_quantity", 2)).alias("squared"),
        M.truncate_decimals("l_extendedprice", 1).alias("trunc1"),
        M.truncate_decimals("l_extendedprice", -2).alias("trunc_neg2"))


@reg.add("m8_m9_log_power_nulls", f"""SELECT event_id,
    CASE WHEN value - 20 > 0 THEN {R('ln(value - 20)')} END AS ln_v,
    CASE WHEN value - 20 > 0 THEN {R('log10(value - 20)')} END AS log10_v,
    CASE WHEN value - 20 > 0 THEN {R('log2(value - 20)')} END AS log2_v,
    CASE WHEN value - 20 >= 0 THEN {R('sqrt(value - 20)')} END AS sqrt_v,
    CASE WHEN value IS NOT NULL THEN least(greatest(value, 5.0), 100.0) END AS clip_v,
    floor((value - 40) / 10.0) * 10.0 AS trunc_neg,
    CASE WHEN value - 40 < 0 THEN ceil((value - 40) * 10.0) ELSE floor((value - 40) * 10.0) END / 10.0 AS trunc_pos,
    CASE WHEN value >= 90 THEN 'high' WHEN value >= 80 THEN 'medium' WHEN value IS NOT NULL THEN 'low' END AS band
    FROM {EVENTS_WITH_NULLS}""")
def m_log(spark, sf):
    e = events_with_nulls(spark, sf)
    v = F.col("value") - 20
    w = F.col("value") - 40
    return e.select("event_id", rnd(M.log(v, "natural")).alias("ln_v"), rnd(M.log(v, "10")).alias("log10_v"),
                    rnd(M.log(v, "2")).alias("log2_v"), rnd(M.power(v, 0.5)).alias("sqrt_v"),
                    M.clip("value", 5, 100).alias("clip_v"), M.truncate_decimals(w, -1).alias("trunc_neg"),
                    M.truncate_decimals(w, 1).alias("trunc_pos"), M.accuracy_band("value").alias("band"))


# ------------------------------------------------------------- conversion
@reg.add("c1_c4_conversions", f"""SELECT event_id,
    TRY_CAST(value AS FLOAT) AS f32,
    TRY_CAST(round_even(value * 200.0, 0) AS SMALLINT) AS i16,
    TRY_CAST(round_even(value, 0) AS INTEGER) AS i32,
    TRY_CAST(round_even(value * 1000.0, 0) AS BIGINT) AS i64,
    coalesce(CAST(user_id AS VARCHAR), '') AS s,
    TRY_CAST(trim(replace(replace(props, '{{"k": ', ''), '}}', '')) AS DOUBLE) AS num_from_text,
    TRY_CAST(trim(event_type) AS DOUBLE) AS num_from_word,
    substr(event_type, 1, 3) AS text3
    FROM {EVENTS_WITH_NULLS}""")
def c_conv(spark, sf):
    e = events_with_nulls(spark, sf)
    k = F.replace(F.replace(F.col("props"), F.lit('{"k": '), F.lit("")), F.lit("}"), F.lit(""))
    return e.select("event_id", C.convert("value", "TO_FLOAT32").alias("f32"),
                    C.convert(F.col("value") * 200.0, "TO_INT16").alias("i16"),
                    C.convert("value", "TO_INT32").alias("i32"),
                    C.convert(F.col("value") * 1000.0, "TO_INT64").alias("i64"),
                    C.convert("user_id", "TO_STRING").alias("s"),
                    C.convert(k, "TO_NUMERIC").alias("num_from_text"),
                    C.convert("event_type", "TO_NUMERIC").alias("num_from_word"),
                    C.convert("event_type", "TRUNCATE", is_numeric=False, chars=3).alias("text3"))


@reg.add("c8_conversion_losses", f"""
    SELECT 'value' AS "column", 'TO_INT16' AS conversion,
           CAST(count_if(v IS NOT NULL AND TRY_CAST(round_even(v, 0) AS SMALLINT) IS NULL) AS BIGINT) AS lost
    FROM (SELECT value * 200.0 AS v FROM {EVENTS_WITH_NULLS})
    UNION ALL
    SELECT 'event_type', 'TO_NUMERIC', CAST(count_if(event_type IS NOT NULL AND TRY_CAST(trim(event_type) AS DOUBLE) IS NULL) AS BIGINT)
    FROM {EVENTS_WITH_NULLS}""")
def c8(spark, sf):
    e = events_with_nulls(spark, sf).withColumn("value", F.col("value") * 200.0)
    return C.conversion_report(e, {"value": "TO_INT16", "event_type": "TO_NUMERIC"})


# ------------------------------------------------------------- dates, maps
DATE_TEXT_SQL = """(SELECT event_id, CASE event_id % 6
    WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%d/%m/%Y')
    WHEN 2 THEN strftime(ts, '%Y/%m/%d') WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    WHEN 4 THEN strftime(ts, '%m/%d/%Y %H:%M:%S') ELSE '2020-13-01' END AS s FROM events)"""
PY_FORMATS = [p for p, _ in C.DATE_FORMATS]


def date_text(spark, sf):
    e = load(spark, sf, "events")
    k = F.col("event_id") % 6
    s = (F.when(k == 0, F.date_format("ts", "yyyy-MM-dd")).when(k == 1, F.date_format("ts", "dd/MM/yyyy"))
          .when(k == 2, F.date_format("ts", "yyyy/MM/dd")).when(k == 3, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
          .when(k == 4, F.date_format("ts", "MM/dd/yyyy HH:mm:ss")).otherwise(F.lit("2020-13-01")))
    return e.select("event_id", s.alias("s"))


@reg.add("dt1_parse_datetimes", "SELECT event_id, s, coalesce(" + ", ".join(
    f"try_strptime(s, '{p}')" for p in PY_FORMATS) + f") AS parsed FROM {DATE_TEXT_SQL}")
def dt1(spark, sf):
    d = date_text(spark, sf)
    return d.select("event_id", "s", C.parse_datetime("s").alias("parsed"))


@reg.add("dt2_dt6_date_scalars", """SELECT event_id, CAST(ts AS DATE) AS day,
    CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) IN (3, 4, 5) THEN 'spring'
         WHEN month(ts) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season,
    strftime(ts, '%H:%M') AS clock,
    coalesce(try_strptime(CASE WHEN event_id % 5 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d') END, '%Y-%m-%d')::DATE,
             current_date) AS request_day
    FROM events""")
def dt_scalars(spark, sf):
    e = load(spark, sf, "events")
    req = F.when(F.col("event_id") % 5 == 0, F.lit("bad")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return e.select("event_id", C.calendar_day("ts").alias("day"), C.season("ts").alias("season"),
                    C.clock_time("ts").alias("clock"), C.parse_request_date(req).alias("request_day"))


@reg.add("dt5_duration_seconds", f"""SELECT l_orderkey, l_linenumber,
    {R('(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6', 3)} AS seconds
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def dt5(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select("l_orderkey", "l_linenumber", rnd(C.duration_seconds("o_orderdate", "l_shipdate"), 3).alias("seconds"))


@reg.add("x14_date_parts", "SELECT event_id, " + ", ".join(
    f"CAST({e} AS INTEGER) AS ts_{n}" for n, e in [
        ("year", "year(ts)"), ("month", "month(ts)"), ("day", "day(ts)"), ("hour", "hour(ts)"),
        ("minute", "minute(ts)"), ("second", "second(ts)"), ("dayofweek", "dayofweek(ts) + 1"),
        ("dayofyear", "dayofyear(ts)"), ("weekofyear", "weekofyear(ts)")]) + " FROM events")
def x14(spark, sf):
    e = load(spark, sf, "events").select("event_id", "ts")
    return C.date_parts(e, "ts").drop("ts")


@reg.add("jm1_jm3_map_json", f"""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    coalesce(TRY_CAST(json_extract_string(props, '$.missing') AS INTEGER),
             TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)) AS k_fallback
    FROM {EVENTS_WITH_NULLS}""")
def jm(spark, sf):
    e = events_with_nulls(spark, sf)
    m = C.from_json_text("props", "map<string,int>")
    parsed = C.from_json_text("props", "k INT")
    return e.select("event_id", parsed["k"].alias("k"), C.map_lookup(m, "missing", "k").alias("k_fallback"))


@reg.add("jm2_json_records", """SELECT event_id,
    CAST(to_json({'event_id': event_id, 'user_id': user_id, 'event_type': event_type}) AS VARCHAR) AS record FROM events""")
def jm2(spark, sf):
    e = load(spark, sf, "events")
    return e.select("event_id", C.to_json_records("event_id", "user_id", "event_type").alias("record"))


# ------------------------------------------------------------ replacement
REPLACE_IDS = [0, 1, 7, 42, 99, 500, 1234, 2048, 4095, 5000, 7777, 9000, 9999]
EV_ROWID_SQL = "(SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS _row_id FROM events)"
IDS_SQL = ", ".join(str(i) for i in REPLACE_IDS)


@reg.add("r1_r2_replace_at_rows", f"""SELECT event_id,
    CASE WHEN _row_id IN ({IDS_SQL}) THEN 'replaced' ELSE event_type END AS event_type,
    CASE WHEN _row_id IN ({IDS_SQL}) THEN NULL ELSE props END AS props,
    CASE WHEN _row_id IN ({IDS_SQL}) AND value IS NOT NULL
         THEN TRY_CAST(replace(CAST(user_id AS VARCHAR), '1', '7') AS BIGINT) ELSE user_id END AS user_id
    FROM {EV_ROWID_SQL}""")
def r1(spark, sf):
    e = with_row_id(load(spark, sf, "events"), ["ts", "event_id"])
    e = RP.replace_values(e, "event_type", REPLACE_IDS, "direct", "replaced")
    e = RP.replace_values(e, "props", REPLACE_IDS, "direct", "")
    e = RP.replace_values(e, "user_id", REPLACE_IDS, "substring", "7", find="1")
    return e.select("event_id", "event_type", "props", "user_id")


@reg.add("r3_r4_char_positions", f"""SELECT c_custkey,
    CASE WHEN c_custkey IN ({IDS_SQL}) THEN array_to_string(list_transform(string_split(c_name, ''),
        lambda ch, i: CASE WHEN i - 1 = 0 THEN 'c' WHEN i - 1 = 8 THEN '' WHEN i - 1 = 3 THEN 'X' ELSE ch END), '')
        ELSE c_name END AS by_char,
    CASE WHEN c_custkey IN ({IDS_SQL}) THEN
        CASE WHEN length(array_to_string(list_filter(string_split(c_name, ''), lambda ch, i: i - 1 NOT IN (2, 4, 5)), '')) >= 2
             THEN substr(array_to_string(list_filter(string_split(c_name, ''), lambda ch, i: i - 1 NOT IN (2, 4, 5)), ''), 1, 2)
                  || 'NEW' || substr(array_to_string(list_filter(string_split(c_name, ''), lambda ch, i: i - 1 NOT IN (2, 4, 5)), ''), 3)
             ELSE array_to_string(list_filter(string_split(c_name, ''), lambda ch, i: i - 1 NOT IN (2, 4, 5)), '') END
        ELSE c_name END AS span
    FROM customer""")
def r3(spark, sf):
    c = load(spark, sf, "customer").withColumn("_row_id", F.col("c_custkey"))
    a = RP.replace_values(c, "c_name", REPLACE_IDS, "charByChar", "cX", positions=[0, 3, 8])
    a = a.withColumnRenamed("c_name", "by_char")
    span =RP.replace_values(c, "c_name", REPLACE_IDS, "complete", "NEW", positions=[4, 2, 5])
    return a.select("c_custkey", "by_char").join(
        span.select("c_custkey", F.col("c_name").alias("span")), "c_custkey")


# ---------------------------------------------------------------- filters
@reg.add("f1_remove_values", f"""SELECT event_id, event_type FROM {EVENTS_WITH_NULLS}
    WHERE NOT (coalesce(event_type IN ('view', 'click'), false) OR event_type IS NULL)""")
def f1(spark, sf):
    e = events_with_nulls(spark, sf).select("event_id", "event_type")
    return FL.remove_values(e, "event_type", ["view", "click", "null"])


@reg.add("f1_remove_numeric_values", f"""SELECT event_id, user_id FROM {EVENTS_WITH_NULLS}
    WHERE NOT coalesce(user_id IN (8, 46, 7), false)""")
def f1n(spark, sf):
    e = events_with_nulls(spark, sf).select("event_id", "user_id")
    return FL.remove_values(e, "user_id", ["8", "46.0", 7, "x"])


@reg.add("r5_failed_reparse", f"""SELECT CAST(count_if(value IS NOT NULL AND event_id < 500 AND
      TRY_CAST(replace(CAST(value AS VARCHAR), '1', 'x') AS DOUBLE) IS NULL) AS BIGINT) AS failed FROM {EVENTS_WITH_NULLS}""")
def r5_failed(spark, sf):
    e = events_with_nulls(spark, sf).select(F.col("event_id").alias("_row_id"), "value")
    return RP.failed_reparse(e, "value", range(500), "substring", find="1", new_value="x")


@reg.add("f2_drop_nulls_one_column", f"SELECT * FROM {EVENTS_WITH_NULLS} WHERE value IS NOT NULL")
def f2(spark, sf):
    return FL.drop_null_rows(events_with_nulls(spark, sf), "value")


@reg.add("f3_drop_rows_any_null", f"""SELECT * FROM {EVENTS_WITH_NULLS}
    WHERE event_type IS NOT NULL AND value IS NOT NULL AND props IS NOT NULL""")
def f3(spark, sf):
    return FL.drop_null_rows(events_with_nulls(spark, sf))


@reg.add("f5_range_scope", f"""SELECT event_id,
    CASE WHEN _row_id BETWEEN 100 AND 2000 THEN upper(event_type) ELSE event_type END AS event_type
    FROM {EV_ROWID_SQL}""")
def f5(spark, sf):
    e = with_row_id(load(spark, sf, "events"), ["ts", "event_id"])
    return RP.apply_in_range(e, "event_type", T.upper("event_type"), 100, 2000).select("event_id", "event_type")


@reg.add("f6_preview_non_null_in_range", f"""SELECT _row_id, event_id, value FROM
    (SELECT e.*, row_number() OVER (ORDER BY ts, event_id) - 1 AS _row_id FROM {EVENTS_WITH_NULLS} e)
    WHERE value IS NOT NULL AND _row_id BETWEEN 50 AND 5000 ORDER BY _row_id LIMIT 20""")
def f6(spark, sf):
    e = with_row_id(events_with_nulls(spark, sf), ["ts", "event_id"])
    return FL.preview_non_null(e, "value", 20, 50, 5000).select("_row_id", "event_id", "value")


@reg.add("f7_f8_log_filters", """SELECT event_id, event_type, value FROM events
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 23:59:59'
      AND event_type = 'purchase' AND value >= 25.0""")
def f7(spark, sf):
    e = load(spark, sf, "events")
    return FL.prediction_log_filter(e, "ts", "event_type", "value", "2024-01-05", "2024-01-20",
                                    "purchase", 25.0).select("event_id", "event_type", "value")


@reg.add("f8_completed_runs", """SELECT o_orderkey FROM orders WHERE
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END = 'completed'""")
def f8(spark, sf):
    o = load(spark, sf, "orders").withColumn(
        "status", F.when(F.col("o_orderstatus") == "F", "completed")
                   .when(F.col("o_orderstatus") == "O", "running").otherwise("failed"))
    return FL.completed(o).select("o_orderkey")


# ------------------------------------------------------------ column checks
@reg.add("p1_p3_select_drop_rename", """SELECT l_quantity AS qty, l_discount, l_extendedprice
    FROM lineitem""")
def p1(spark, sf):
    li = load(spark, sf, "lineitem")
    s = FL.select_features(li, ["l_quantity", "l_discount", "l_tax"], ["l_extendedprice"])
    s = FL.drop_column(s, "l_tax")
    return FL.rename_column(s, "l_quantity", "  qty ")


@reg.add("p5_column_as_text_counts", f"""SELECT count(*) AS total, count(DISTINCT event_type) AS "unique",
    CAST(count_if(event_type IS NULL) AS BIGINT) AS nulls FROM {EVENTS_WITH_NULLS}""")
def p5(spark, sf):
    _, counts = FL.column_as_text(events_with_nulls(spark, sf), "event_type")
    return counts


@reg.add("p5_column_as_text", f"""SELECT value, count(*) AS n FROM (SELECT CAST(user_id AS VARCHAR) AS value
    FROM {EVENTS_WITH_NULLS}) GROUP BY value""")
def p5_text(spark, sf):
    values, _ = FL.column_as_text(events_with_nulls(spark, sf), "user_id")
    return values.groupBy(F.col("user_id").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@reg.add("m2_m3_m11_large_numbers", """SELECT o_orderkey, floor(x) AS fl, ceil(x) AS ce, trunc(x) AS tr
    FROM (SELECT o_orderkey, o_totalprice * 1e16 AS x FROM orders)""")
def m_large(spark, sf):
    x = F.col("o_totalprice") * 1e16
    return load(spark, sf, "orders").select("o_orderkey", M.floor(x).alias("fl"), M.ceil(x).alias("ce"),
                                            M.truncate_decimals(x, 0).alias("tr"))


@reg.add("p6_preview_first_10", f"SELECT _row_id, event_id, value FROM {EV_ROWID_SQL} ORDER BY _row_id LIMIT 10")
def p6(spark, sf):
    e = with_row_id(load(spark, sf, "events"), ["ts", "event_id"])
    return FL.preview(e, 10).select("_row_id", "event_id", "value")


@reg.add("p7_numeric_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, "
         "l_extendedprice, l_discount, l_tax FROM lineitem")
def p7(spark, sf):
    return FL.numeric_only(load(spark, sf, "lineitem"))


@reg.add("p9_validate_table", """SELECT count(*) >= 10 AS ok,
    CASE WHEN count(*) = 0 THEN 'empty table' WHEN count(*) < 10 THEN 'fewer than 10 rows' ELSE 'ok' END AS message
    FROM customer""")
def p9(spark, sf):
    return FL.validate(load(spark, sf, "customer"))
