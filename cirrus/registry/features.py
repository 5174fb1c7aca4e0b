"""Registered normaliser / encoder / chain queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cirrus.operators import encode as E
from cirrus.operators import normalize as Z
from cirrus.operators import split as S
from cirrus.plans import chain as CH
from cirrus.registry.base import R, Registry, load, rnd
from cirrus.registry.rows import LI_COLS, LI_KEY, SP1_SQL, TR, VA, TE, d
from cirrus.sources.ingest import with_row_id

reg = Registry()
ZC = ["l_quantity", "l_extendedprice", "l_discount"]


def _z_sql(c, m):
    if m == "MIN_MAX":
        return f"(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()))"
    if m == "LSTM_TCN":
        return f"(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 2.0 - 1.0)"
    if m == "Z_SCORE":
        return f"(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ())"
    if m == "TRANSFORMER":
        return (f"(({c} - quantile_cont({c}, 0.5) OVER ()) / "
                f"(quantile_cont({c}, 0.75) OVER () - quantile_cont({c}, 0.25) OVER ()))")
    return c


METHODS = {"l_quantity": "MIN_MAX", "l_extendedprice": "Z_SCORE", "l_discount": "TRANSFORMER"}


@reg.add("z1_z5_normalizers", f"""SELECT {LI_COLS}, {R(_z_sql('l_quantity', 'MIN_MAX'))} AS q_minmax,
    {R(_z_sql('l_quantity', 'LSTM_TCN'))} AS q_lstm, {R(_z_sql('l_extendedprice', 'Z_SCORE'))} AS p_z,
    {R(_z_sql('l_discount', 'TRANSFORMER'))} AS d_robust, l_tax AS t_tree FROM lineitem""")
def z1(spark, sf):
    li = load(spark, sf, "lineitem")
    a = Z.fit(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
              {"l_quantity": "MIN_MAX", "l_extendedprice": "Z_SCORE", "l_discount": "TRANSFORMER",
               "l_tax": "TREE"})
    b = Z.fit(li, ["l_quantity"], "LSTM_TCN")
    return li.select(*LI_KEY, rnd(a.expr("l_quantity")).alias("q_minmax"), rnd(b.expr("l_quantity")).alias("q_lstm"),
                     rnd(a.expr("l_extendedprice")).alias("p_z"), rnd(a.expr("l_discount")).alias("d_robust"),
                     a.expr("l_tax").alias("t_tree"))


@reg.add("z4_z18_cnn_fitted_on_all_rows", f"""SELECT {LI_COLS}, {R(_z_sql('l_quantity', 'Z_SCORE'))} AS l_quantity,
    {R(_z_sql('l_extendedprice', 'MIN_MAX'))} AS l_extendedprice FROM lineitem""")
def z4_z18(spark, sf):
    li = load(spark, sf, "lineitem").select(*LI_KEY, "l_quantity", "l_extendedprice")
    li = li.withColumn("split", F.when(F.col("l_linenumber") == 1, "test").otherwise("train"))
    a = Z.fit_on_split(li, ["l_quantity"], "CNN", fit_split=None)
    b = Z.fit_on_split(li, ["l_extendedprice"], "minmax", fit_split=None)
    out = b.transform(a.transform(li))
    return out.select(*LI_KEY, *[rnd(c).alias(c) for c in ("l_quantity", "l_extendedprice")])


@reg.add("z9_normalize_whole_table", f"""SELECT {R(_z_sql('CAST(s_suppkey AS DOUBLE)', 'MIN_MAX'))} AS s_suppkey,
    lower(s_name) AS s_name, {R(_z_sql('CAST(s_nationkey AS DOUBLE)', 'MIN_MAX'))} AS s_nationkey,
    {R(_z_sql('s_acctbal', 'MIN_MAX'))} AS s_acctbal FROM supplier""")
def z9(spark, sf):
    out = Z.normalize_table(load(spark, sf, "supplier"), "MIN_MAX", "LOWER")
    return out.select(rnd("s_suppkey").alias("s_suppkey"), "s_name", rnd("s_nationkey").alias("s_nationkey"),
                      rnd("s_acctbal").alias("s_acctbal"))


EV_SEQ = """(SELECT *, CASE WHEN row_number() OVER (ORDER BY ts, event_id) - 1 < floor(count(*) OVER () * {tr})
    THEN 'train' ELSE 'rest' END AS split FROM events)"""


@reg.add("z17_z19_fit_on_train_inverse", f"""WITH e AS {EV_SEQ.format(tr=d(TR))},
    s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi FROM e WHERE split = 'train')
    SELECT event_id, {R('(value - mu) / sd')} AS z, {R('((value - lo) / (hi - lo)) * 2.0 - 1.0')} AS m,
           {R('((value - mu) / sd) * sd + mu')} AS z_back FROM e, s""")
def z17(spark, sf):
    e = with_row_id(load(spark, sf, "events"), ["ts", "event_id"])
    e = S.sequential_split(e, TR, 1 - TR, 0.0)
    zm = Z.fit_on_split(e, ["value"], "standard")
    mm = Z.fit_on_split(e, ["value"], "LSTM_TCN")
    z = zm.expr("value")
    return e.select("event_id", rnd(z).alias("z"), rnd(mm.expr("value")).alias("m"),
                    rnd(zm.inverse_expr("value", z)).alias("z_back"))


@reg.add("z7_label_encoding", """SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS p_brand,
    CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS p_type FROM part""")
def z7(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return E.label_encode(E.label_encode(p, "p_brand"), "p_type")


@reg.add("j1_code_lookup_with_nulls", """WITH c AS (SELECT CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS seg,
    c_custkey FROM customer), m AS (SELECT seg, CAST(row_number() OVER (ORDER BY seg) - 1 AS BIGINT) AS code
    FROM (SELECT DISTINCT seg FROM c WHERE seg IS NOT NULL))
    SELECT c_custkey, code AS seg FROM c LEFT JOIN m USING (seg)""")
def j1(spark, sf):
    c = load(spark, sf, "customer")
    c = c.select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("seg"))
    return E.label_encode(c, "seg")


@reg.add("z8_one_hot", """SELECT o_orderkey, """ + ", ".join(
    f"CAST(coalesce(o_orderpriority = '{v}', false) AS BIGINT) AS \"o_orderpriority_{v}\""
    for v in ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]) + " FROM orders")
def z8(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return E.one_hot(o, "o_orderpriority")


@reg.add("z20_one_hot_drop_first_fit_on_train", """SELECT o_orderkey, """ + ", ".join(
    f"CAST(coalesce(o_orderstatus = '{v}', false) AS BIGINT) AS \"o_orderstatus_{v}\"" for v in ["O", "P"])
    + " FROM orders")
def z20(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    o = S.sequential_split(with_row_id(o, ["o_orderdate", "o_orderkey"]), TR, VA, TE)
    cats = E.categories(o.filter(F.col("split") == "train"), "o_orderstatus")
    return E.one_hot(o.select("o_orderkey", "o_orderstatus"), "o_orderstatus", cats=cats, drop_first=True)


@reg.add("z8_sparse_one_hot", """SELECT p_partkey, (SELECT CAST(count(DISTINCT p_name) AS INTEGER) FROM part) AS size,
    CAST([dense_rank() OVER (ORDER BY p_name) - 1] AS INTEGER[]) AS indices, CAST([1] AS DOUBLE[]) AS "values" FROM part""")
def z8_sparse(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_name")
    v = F.unwrap_udt("p_name_onehot")
    return E.one_hot_vector(p, "p_name").select("p_partkey", v["size"].alias("size"), v["indices"].alias("indices"), v["values"].alias("values"))


@reg.add("z20_sparse_drop_first_fit_on_train", f"""WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS t FROM part),
    m AS (SELECT t, row_number() OVER (ORDER BY t) - 2 AS i FROM (SELECT DISTINCT t FROM c WHERE p_partkey % 2 = 0 AND t IS NOT NULL))
    SELECT p_partkey, (SELECT CAST(greatest(1, count(*) - 1) AS INTEGER) FROM m) AS size,
      CAST(CASE WHEN i >= 0 THEN [i] ELSE [] END AS INTEGER[]) AS indices FROM c LEFT JOIN m USING (t)""")
def z20_sparse(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 11 != 0, F.col("p_type")).alias("t"))
    codes = E.label_mapping(p.where("p_partkey % 2 = 0"), "t")
    v = F.unwrap_udt("t_onehot")
    return E.one_hot_vector(p, "t", codes, drop_first=True).select("p_partkey", v["size"].alias("size"), v["indices"].alias("indices"))


CUST_SEQ = f"""(SELECT *, CASE WHEN row_number() OVER (ORDER BY c_custkey) - 1 < floor(count(*) OVER () * {d(TR)})
    THEN 'train' ELSE 'rest' END AS split FROM customer)"""


@reg.add("z21_ordinal_unknown", f"""WITH c AS {CUST_SEQ},
    m AS (SELECT c_name AS k, CAST(row_number() OVER (ORDER BY c_name) - 1 AS BIGINT) AS code
          FROM (SELECT DISTINCT c_name FROM c WHERE split = 'train'))
    SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN CAST(coalesce(code, -1) AS BIGINT) END AS c_name
    FROM c LEFT JOIN m ON c.c_name = m.k""")
def z21(spark, sf):
    c = with_row_id(load(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"])
    c = S.sequential_split(c, TR, 1 - TR, 0.0)
    mapping = E.label_mapping(c.filter(F.col("split") == "train"), "c_name")
    return E.label_encode(c, "c_name", mapping=mapping, unknown=-1).select("c_custkey", "c_name")


@reg.add("z22_target_encoding", f"""WITH s AS ({SP1_SQL.replace(f"SELECT {LI_COLS},", f"SELECT {LI_COLS}, l_suppkey AS sk, l_extendedprice,")}),
    m AS (SELECT sk, avg(l_extendedprice) AS te FROM s WHERE split = 'train' GROUP BY sk),
    dflt AS (SELECT avg(te) AS dv FROM m)
    SELECT {LI_COLS}, {R('coalesce(te, dv)')} AS supp_mean FROM s LEFT JOIN m USING (sk), dflt""")
def z22(spark, sf):
    li = load(spark, sf, "lineitem").select(*LI_KEY, "l_extendedprice")
    s = S.random_split(li, LI_KEY, TR, VA, TE, seed=42).withColumn("sk", F.col("l_suppkey"))
    te = E.TargetEncoder("sk", "l_extendedprice").fit(s.filter(F.col("split") == "train"))
    out = te.transform(s, out="supp_mean")
    return out.select(*LI_KEY, rnd("supp_mean").alias("supp_mean"))


@reg.add("j2_group_mean_lookup", f"""WITH m AS (SELECT n_regionkey, avg(c_acctbal) AS te FROM customer
    JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey)
    SELECT c_custkey, {R('te')} AS region_mean FROM customer JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN m USING (n_regionkey)""")
def j2(spark, sf):
    c = load(spark, sf, "customer").join(F.broadcast(load(spark, sf, "nation")),  # 25 rows
                                          F.col("c_nationkey") == F.col("n_nationkey"))
    te = E.TargetEncoder("n_regionkey", "c_acctbal").fit(c)
    return te.transform(c, out="region_mean").select("c_custkey", rnd("region_mean").alias("region_mean"))


@reg.add("z23_cyclic_features", f"""SELECT event_id, {R('sin(2 * pi() * hour(ts) / 24.0)', 9)} AS hour_sin,
    {R('cos(2 * pi() * hour(ts) / 24.0)', 9)} AS hour_cos,
    {R('sin(2 * pi() * user_id / (max(user_id) OVER () + 1.0))', 9)} AS user_id_sin FROM events""")
def z23(spark, sf):
    e = load(spark, sf, "events").select("event_id", F.hour("ts").alias("hour"), "user_id")
    p = E.fit_cyclic_period(e, "hour")
    q = E.fit_cyclic_period(e, "user_id", "max")
    out = E.cyclic(E.cyclic(e, "hour", p), "user_id", q)
    return out.select("event_id", rnd("hour_sin", 9).alias("hour_sin"), rnd("hour_cos", 9).alias("hour_cos"),
                      rnd("user_id_sin", 9).alias("user_id_sin"))


ORD_SEQ = f"""(SELECT *, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1
    < floor(count(*) OVER () * {d(TR)}) THEN 'train' ELSE 'rest' END AS split, month(o_orderdate) AS order_month FROM orders)"""


def _z24_sql():
    feats = {"order_month_sin": f"sin({2 * math.pi!r} * order_month / 12.0)",
             "order_month_cos": f"cos({2 * math.pi!r} * order_month / 12.0)"}
    for v in ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]:
        feats[f"o_orderpriority_{v}"] = f"CAST(coalesce(o_orderpriority = '{v}', false) AS BIGINT)"
    feats["o_totalprice"] = "o_totalprice"
    base = ", ".join(f"{e} AS \"{n}\"" for n, e in feats.items())
    stats = ", ".join(f"avg(\"{n}\") AS \"mu_{n}\", stddev_pop(\"{n}\") AS \"sd_{n}\"" for n in feats)
    out = ", ".join(f"{R(f'(\"{n}\" - \"mu_{n}\") / CASE WHEN \"sd_{n}\" = 0 THEN 1 ELSE \"sd_{n}\" END', 6)} AS \"{n}\""
                    for n in feats)
    return f"""WITH b AS (SELECT o_orderkey, split, {base} FROM {ORD_SEQ}),
    s AS (SELECT {stats} FROM b WHERE split = 'train')
    SELECT o_orderkey, {out} FROM b, s"""


@reg.add("z24_z25_preprocessing_pipeline", _z24_sql())
def z24(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    o = with_row_id(o, ["o_orderdate", "o_orderkey"])
    o = S.sequential_split(o, TR, 1 - TR, 0.0).withColumn("order_month", F.month("o_orderdate"))
    feats = ["order_month", "o_orderpriority", "o_totalprice"]
    model = E.fit_preprocessing(o.filter(F.col("split") == "train"), feats, scale="standard",
                                categorical=["o_orderpriority"])
    out = model.transform(o.select("o_orderkey", *feats))
    return out.select("o_orderkey", *[rnd(c).alias(c) for c in model.feature_columns])


@reg.add("z26_label_decode", """SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS code,
    p_brand AS code_label FROM part""")
def z26(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_brand")
    mapping = E.label_mapping(p, "p_brand")
    enc = E.label_encode(p, "p_brand", mapping=mapping, out="code")
    return E.decode_labels(enc.drop("p_brand"), "code", mapping).select("p_partkey", "code", "code_label")


CHAIN = {"l_quantity": [{"method": "MIN_MAX", "conversion": "TO_FLOAT32"},
                        {"method": "Z_SCORE", "keep_original": False}],
         "l_returnflag": "LABEL_ENCODING",
         "l_discount": {"method": "LSTM_TCN", "keep_original": True}}


@reg.add("z15_output_conversions", f"""SELECT {LI_COLS}, CAST({_z_sql('l_quantity', 'MIN_MAX')} AS FLOAT) AS l_quantity_normalized,
    l_quantity FROM lineitem""")
def z15(spark, sf):
    li = load(spark, sf, "lineitem").select(*LI_KEY, "l_quantity")
    res = CH.run_chain(li, {"l_quantity": {"method": "MIN_MAX", "keep_original": True}},
                       output_conversions={"*": {"conversion": "TO_FLOAT32"}})
    return res.frame.select(*LI_KEY, "l_quantity_normalized", "l_quantity")


@reg.add("z16_step_preview", """WITH a AS (SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 1000),
    u AS (SELECT s_suppkey, s_name, trim(lower(s_name)) AS t FROM a)
    SELECT s_suppkey, CAST(1 AS INTEGER) AS step, 'LOWER' AS method, s_name AS before, lower(s_name) AS after FROM u
    UNION ALL SELECT s_suppkey, 2, 'STRIP', lower(s_name), t FROM u""")
def z16_steps(spark, sf):
    s = load(spark, sf, "supplier").select("s_suppkey", "s_name")
    return CH.step_preview(s, {"s_name": ["LOWER", "STRIP"]}, "s_name", ["s_suppkey"], 1000)


@reg.add("z16_step_statistics", f"""WITH a AS (SELECT l_quantity, {_z_sql('l_quantity', 'MIN_MAX')} AS s1 FROM lineitem),
    b AS (SELECT *, {_z_sql('s1', 'LSTM_TCN')} AS s2 FROM a)
    """ + " UNION ALL ".join(f"""SELECT '{n}' AS "column", count({c}) AS count, {R(f'avg({c})')} AS mean, {R(f'stddev_samp({c})')} AS std,
    {R(f'min({c})')} AS min, {R(f'max({c})')} AS max FROM b""" for n, c in (
        ("l_quantity", "l_quantity"), ("l_quantity_step1", "s1"), ("l_quantity_step2", "s2"))))
def z16_stats(spark, sf):
    li = load(spark, sf, "lineitem").select("l_quantity")
    out = CH.step_statistics(li, {"l_quantity": ["MIN_MAX", "LSTM_TCN"]}, "l_quantity")
    return out.withColumns({c: rnd(c) for c in ("mean", "std", "min", "max")})


@reg.add("z25_ordinal_preprocessing", """SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS o_orderpriority,
    o_totalprice FROM orders""")
def z25_ordinal(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    m = E.fit_preprocessing(o, ["o_orderpriority", "o_totalprice"], scale=None, categorical=["o_orderpriority"],
                            encoding_method="ordinal")
    return m.transform(o)


@reg.add("z23_cyclic_names", f"""SELECT event_id, {R('sin(2 * pi() * day(ts) / (SELECT max(day(ts)) + 1.0 FROM events))', 9)} AS day_number_sin,
    {R('cos(2 * pi() * dayofweek(ts) / 7.0)', 9)} AS day_of_week_cos FROM events""")
def z23_names(spark, sf):
    e = load(spark, sf, "events").select("event_id", F.dayofmonth("ts").alias("day_number"),
                                         (F.dayofweek("ts") - 1).alias("day_of_week"))
    for c in ("day_number", "day_of_week"):
        e = E.cyclic(e, c, E.fit_cyclic_period(e, c))
    return e.select("event_id", rnd("day_number_sin", 9).alias("day_number_sin"), rnd("day_of_week_cos", 9).alias("day_of_week_cos"))


@reg.add("z13_z15_normalization_chain", f"""WITH a AS (SELECT *, CAST({_z_sql('l_quantity', 'MIN_MAX')} AS FLOAT) AS s1 FROM lineitem)
    SELECT {LI_COLS}, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS BIGINT) AS l_returnflag,
      {R(_z_sql('CAST(s1 AS DOUBLE)', 'Z_SCORE'))} AS l_quantity_step2, l_discount,
      {R(_z_sql('l_discount', 'LSTM_TCN'))} AS l_discount_normalized FROM a""")
def z13(spark, sf):
    li = load(spark, sf, "lineitem").select(*LI_KEY, "l_quantity", "l_returnflag", "l_discount")
    res = CH.run_chain(li, CHAIN)
    f = res.frame
    return f.select(*LI_KEY, "l_returnflag", rnd("l_quantity_step2").alias("l_quantity_step2"), "l_discount",
                    rnd("l_discount_normalized").alias("l_discount_normalized"))
