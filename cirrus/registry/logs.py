"""Registered run-log / prediction-log / lookup queries (A22–A26, J4–J9,
K4–K7, U2). Run logs are derived from orders + lineitem (one run per
order, its priority as the model, its customer as the owner); the
prediction log is the events table (event_type = model, value = accuracy,
user_id = location)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cirrus.operators import evaluate as EV
from cirrus.operators import lookups as L
from cirrus.registry.base import PYROUND, R, Registry, load, rnd

reg = Registry()

CLS_MODELS = ("1-URGENT", "2-HIGH", "3-MEDIUM")
MODELS = ["click", "error", "purchase", "signup", "view"]

RUNS_SQL = """(SELECT o_orderkey AS run_id, o_orderpriority AS model_name, o_custkey AS owner,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
    o_orderdate AS created_at,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'classification' ELSE 'regression' END AS problem_type,
    CASE WHEN o_orderkey % 4 <> 0 THEN 100 * (1 - d) END AS accuracy, 1 - d - 0.01 AS f1_score, 1 - t AS r2
    FROM orders JOIN (SELECT l_orderkey, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem GROUP BY l_orderkey)
    ON o_orderkey = l_orderkey)"""


def runs(spark, sf):
    li = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.avg("l_discount").alias("d"),
                                                               F.avg("l_tax").alias("t"))
    o = load(spark, sf, "orders")
    j = o.join(li, o.o_orderkey == li.l_orderkey)
    acc = F.when(F.col("o_orderkey") % 4 != 0, 100 * (1 - F.col("d")))
    results = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("accuracy"), acc), F.struct(F.lit("f1_score"), 1 - F.col("d") - 0.01),
        F.struct(F.lit("r2"), 1 - F.col("t"))), lambda e: e.getField("col2").isNotNull()))
    return j.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("model_name"),
        F.col("o_custkey").alias("owner"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running")
         .otherwise("failed").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderpriority").isin(*CLS_MODELS), "classification").otherwise("regression")
         .alias("problem_type"),
        results.alias("test_results"))


@reg.add("a22_success_rate", f"""SELECT model_name, {PYROUND("avg(CASE WHEN status = 'completed' THEN 1.0 ELSE 0.0 END) * 100.0", 1)}
    AS success_rate FROM {RUNS_SQL} GROUP BY model_name""")
def a22(spark, sf):
    return L.success_rate(runs(spark, sf))


@reg.add("a23_best_score", f"""SELECT model_name, {R("max(CASE WHEN problem_type = 'classification' THEN coalesce(accuracy, f1_score) ELSE r2 END)")}
    AS best_score FROM {RUNS_SQL} WHERE status = 'completed' GROUP BY model_name""")
def a23(spark, sf):
    return L.best_score(runs(spark, sf)).withColumn("best_score", rnd("best_score"))


PRED_SQL = """(SELECT event_id, ts AS created_at, event_type AS model_name, value AS accuracy,
    CASE WHEN user_id % 5 <> 0 THEN 'loc' || CAST(user_id AS VARCHAR) END AS location,
    CAST(user_id AS DOUBLE) AS latitude, CAST(user_id % 7 AS DOUBLE) AS longitude FROM events)"""


def preds(spark, sf):
    e = load(spark, sf, "events")
    return e.select("event_id", F.col("ts").alias("created_at"), F.col("event_type").alias("model_name"),
                    F.col("value").alias("accuracy"),
                    F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("loc"), F.col("user_id").cast("string")))
                     .alias("location"),
                    F.col("user_id").cast("double").alias("latitude"),
                    (F.col("user_id") % 7).cast("double").alias("longitude"))


@reg.add("a24_prediction_summary", f"""WITH p AS {PRED_SQL},
    m AS (SELECT model_name, avg(accuracy) AS a FROM p GROUP BY model_name)
    SELECT {R('avg(accuracy)')} AS avg_accuracy, count(*) AS total,
      count(DISTINCT coalesce(location, CAST(latitude AS VARCHAR) || ',' || CAST(longitude AS VARCHAR))) AS locations,
      (SELECT model_name FROM m ORDER BY a DESC, model_name DESC LIMIT 1) AS best_model FROM p""")
def a24(spark, sf):
    s = L.prediction_summary(preds(spark, sf))
    return s.withColumn("avg_accuracy", rnd("avg_accuracy"))


@reg.add("a25_daily_accuracy_last_7_days", f"""WITH p AS {PRED_SQL},
    d AS (SELECT DISTINCT CAST(created_at AS DATE) AS day FROM p ORDER BY day DESC LIMIT 7)
    SELECT day, """ + ", ".join(f"{R(f'avg(CASE WHEN model_name = {chr(39)}{m}{chr(39)} THEN accuracy END)')} AS {m}"
                                for m in MODELS) + """
    FROM p JOIN d ON CAST(created_at AS DATE) = d.day GROUP BY day""")
def a25(spark, sf):
    out = L.daily_accuracy(preds(spark, sf), MODELS)
    return out.select("day", *[rnd(m).alias(m) for m in MODELS])


@reg.add("a26_owner_counts", f"""WITH d AS (SELECT o_custkey AS owner, count(*) AS datasets FROM orders GROUP BY 1),
    m AS (SELECT o_custkey AS owner, count(*) AS models FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) GROUP BY 1),
    r AS (SELECT o_custkey AS owner, count(*) AS runs FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT owner, coalesce(datasets, 0) AS datasets, coalesce(models, 0) AS models, coalesce(runs, 0) AS runs
    FROM d FULL JOIN m USING (owner) FULL JOIN r USING (owner)""")
def a26(spark, sf):
    o = load(spark, sf, "orders").withColumnRenamed("o_custkey", "owner")
    li = load(spark, sf, "lineitem").join(o.select("o_orderkey", "owner"), F.col("l_orderkey") == F.col("o_orderkey"))
    return L.owner_counts("owner", datasets=o, models=o.select("owner", "o_orderpriority").distinct(), runs=li)


@reg.add("k4_latest_5_runs", f"""SELECT run_id, created_at FROM {RUNS_SQL} ORDER BY created_at DESC, run_id DESC LIMIT 5""")
def k4(spark, sf):
    return L.latest(runs(spark, sf), "created_at", 5, key="run_id").select("run_id", "created_at")


@reg.add("k5_latest_run_per_model", f"""SELECT model_name, run_id, created_at FROM {RUNS_SQL}
    QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY created_at DESC, run_id DESC) = 1""")
def k5(spark, sf):
    return L.latest_per_group(runs(spark, sf), "model_name", "created_at", ["run_id", "created_at"])


@reg.add("k7_predictions_by_day_newest_first", f"""SELECT CAST(created_at AS DATE) AS day, count(*) AS predictions
    FROM {PRED_SQL} GROUP BY 1 ORDER BY day DESC""")
def k7(spark, sf):
    d = L.by_day_newest_first(preds(spark, sf), "created_at")
    return d.groupBy("day").agg(F.count(F.lit(1)).alias("predictions")).orderBy(F.desc("day"))


# Orphan runs (customers) linked to definitions (suppliers) on
# (nation, positive balance); equal hyper-parameters break ties.
@reg.add("j4_link_runs_to_definitions", """WITH r AS (SELECT c_custkey, c_nationkey AS nk, c_acctbal > 0 AS pos,
      'h' || CAST(c_custkey % 3 AS VARCHAR) AS hp FROM customer),
    d AS (SELECT s_suppkey, s_nationkey AS nk, s_acctbal > 0 AS pos, 'h' || CAST(s_suppkey % 3 AS VARCHAR) AS hp FROM supplier),
    g AS (SELECT c_custkey, count(s_suppkey) AS n, min(s_suppkey) AS a,
                 min(CASE WHEN r.hp = d.hp THEN s_suppkey END) AS e
          FROM r LEFT JOIN d ON r.nk = d.nk AND r.pos = d.pos GROUP BY c_custkey)
    SELECT c_custkey, CASE WHEN n = 1 THEN a ELSE e END AS linked_definition FROM g""")
def j4(spark, sf):
    c = load(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("nk"), (F.col("c_acctbal") > 0).alias("pos"),
        F.concat(F.lit("h"), (F.col("c_custkey") % 3).cast("string")).alias("hp"))
    s = load(spark, sf, "supplier").select(
        "s_suppkey", F.col("s_nationkey").alias("nk"), (F.col("s_acctbal") > 0).alias("pos"),
        F.concat(F.lit("h"), (F.col("s_suppkey") % 3).cast("string")).alias("hp"))
    return L.link_runs(c, s, ["nk", "pos"], "c_custkey", "s_suppkey", "hp")


# turns in order, conversation after conversation, in chains of 40 conversations
def chain(spark, sf):
    c = load(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    c = c.withColumn("chain", F.floor(F.col("conv_id") / 40))
    last = c.groupBy("chain", "conv_id").agg(F.max("id").alias("end"))
    # the turn before, or the last turn of the conversation before in the chain
    ends = last.select(F.col("chain").alias("_chain"), F.lead("conv_id").over(
        Window.partitionBy("chain").orderBy("conv_id")).alias("_conv"), F.col("end").alias("_end"))
    prev = F.lag("id").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = c.withColumn("_prev", prev).join(ends, (F.col("chain") == F.col("_chain")) & (F.col("conv_id") == F.col("_conv")), "left")
    return c.select("id", F.coalesce("_prev", "_end").alias("parent_id"))


CHAIN_WALK = """n AS (SELECT id, parent_id FROM (SELECT id, conv_id, turn,
      lag(id) OVER (PARTITION BY conv_id // 40 ORDER BY conv_id, turn) AS parent_id FROM
      (SELECT conv_id, turn, conv_id * 1000 + turn AS id FROM conversations))),
    walk AS (SELECT id, id AS cur, parent_id AS par, 0 AS depth, CAST([] AS VARCHAR[]) AS seen FROM n
             UNION ALL SELECT w.id, n.id, n.parent_id, w.depth + 1, list_prepend(CAST(n.id AS VARCHAR), w.seen)
             FROM walk w JOIN n ON w.par = n.id)"""


@reg.add("j5_lineage_root_depth", f"""WITH RECURSIVE {CHAIN_WALK}
    SELECT id, cur AS root, CAST(depth AS INTEGER) AS depth FROM walk WHERE par IS NULL""")
def j5(spark, sf):
    return L.lineage(chain(spark, sf), "id", "parent_id")


@reg.add("j5_ancestors", f"""WITH RECURSIVE {CHAIN_WALK}
    SELECT id, array_to_string(seen, ',') AS ancestors FROM walk WHERE par IS NULL""")
def j5_ancestors(spark, sf):
    return L.ancestors(chain(spark, sf), "id", "parent_id").select("id", F.array_join("ancestors", ",").alias("ancestors"))


@reg.add("j6_weather_code_decode", """SELECT p_partkey, p_size % 12 AS code,
    ['Clear', 'Partly Cloudy', 'Mostly Cloudy', 'Overcast', 'Foggy', 'Light Rain', 'Rain', 'Heavy Rain', 'Light Snow',
     'Snow', 'Heavy Snow', 'Thunderstorm'][p_size % 12 + 1] AS weather FROM part""")
def j6(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", (F.col("p_size") % 12).alias("code"))
    return p.withColumn("weather", EV.label_names(F.col("code")))


DAYS_SQL = "(SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)"
J7_SQL = f"""SELECT day, region, latitude, longitude, country,
    CASE WHEN month(day) IN (12, 1, 2) THEN 'winter' WHEN month(day) IN (3, 4, 5) THEN 'spring'
         WHEN month(day) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season,
    CASE WHEN country = 'FR' THEN CASE WHEN month(day) IN (12, 1, 2) THEN 8.0 WHEN month(day) IN (3, 4, 5) THEN 15.0
                                       WHEN month(day) IN (6, 7, 8) THEN 25.0 ELSE 16.0 END
         ELSE CASE WHEN month(day) IN (12, 1, 2) THEN 12.0 WHEN month(day) IN (3, 4, 5) THEN 18.0
                   WHEN month(day) IN (6, 7, 8) THEN 28.0 ELSE 20.0 END END::DOUBLE AS base_temp
    FROM {DAYS_SQL}, (VALUES {", ".join(f"('{r}', CAST({la!r} AS DOUBLE), CAST({lo!r} AS DOUBLE), '{c}')" for r, la, lo, c in L.CITIES)})
         AS c(region, latitude, longitude, country)"""


def _days(spark, sf):
    return load(spark, sf, "events").select(F.to_date("ts").alias("day"))


@reg.add("j7_fallback_grid", J7_SQL)
def j7(spark, sf):
    return L.fallback_predictions(_days(spark, sf)).select("day", "region", "latitude", "longitude", "country",
                                                            "season", "base_temp")


@reg.add("j8_j9_merge_missing_predictions", f"""WITH fresh AS ({J7_SQL}),
    stored AS (SELECT * FROM fresh WHERE day <= DATE '2024-01-15')
    SELECT day, region, latitude, longitude FROM stored
    UNION ALL SELECT day, region, latitude, longitude FROM fresh
      WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.day = fresh.day AND s.latitude = fresh.latitude
                        AND s.longitude = fresh.longitude)""")
def j8(spark, sf):
    fresh = L.fallback_predictions(_days(spark, sf))
    stored = fresh.filter(F.col("day") <= F.lit("2024-01-15").cast("date"))
    out = L.merge_missing(stored, fresh, ["day", "latitude", "longitude"])
    return out.select("day", "region", "latitude", "longitude")


@reg.add("j9_duplicate_keys", """SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def j9(spark, sf):
    li = load(spark, sf, "lineitem")
    return L.duplicate_keys(li, ["l_orderkey", "l_linenumber"])


@reg.add("u2_label_domain_union", """SELECT DISTINCT label FROM (SELECT o_orderstatus AS label FROM orders
    UNION ALL SELECT l_linestatus FROM lineitem)""")
def u2(spark, sf):
    return L.label_domain((load(spark, sf, "orders"), "o_orderstatus"), (load(spark, sf, "lineitem"), "l_linestatus"))
