"""Registered model queries: evaluation on (y, ŷ) tables derived from the
driver's tables (ML9–ML22, X2, X5, D6, ML6) with SQL twins, and MLlib
training / scoring / PCA / clustering (ML1–ML8, CV8, A18, A19, X4, X8, X12,
X13) as rows-only checks."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cirrus.operators import encode as E
from cirrus.operators import evaluate as EV
from cirrus.operators import split as S
from cirrus.plans import search as SE
from cirrus.plans import train as TR
from cirrus.registry.base import R, Registry, load, rnd
from cirrus.session import ensure_checkpoint_dir

reg = Registry()

# Regression pairs: order total (thousands) vs the total rebuilt from its lines.
REG_PAIRS_SQL = """(SELECT o_orderkey, o_totalprice / 1000.0 AS y, s / 1000.0 AS yhat, q AS y2, n * 25.5 AS yhat2
    FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS s,
                             sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY l_orderkey)
    ON o_orderkey = l_orderkey)"""


def reg_pairs(spark, sf):
    li = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("s"),
        F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    j = o.join(li, o.o_orderkey == li.l_orderkey)
    return j.select("o_orderkey", (F.col("o_totalprice") / 1000.0).alias("y"), (F.col("s") / 1000.0).alias("yhat"),
                    F.col("q").alias("y2"), (F.col("n") * 25.5).alias("yhat2"))


# Class pairs: order status vs the status implied by its line statuses.
CLS_PAIRS_SQL = """(SELECT o_orderkey, o_orderstatus AS y,
    CASE WHEN nf = n THEN 'F' WHEN no = n THEN 'O' ELSE 'P' END AS yhat
    FROM orders JOIN (SELECT l_orderkey, count(*) AS n, count_if(l_linestatus = 'F') AS nf,
                             count_if(l_linestatus = 'O') AS no FROM lineitem GROUP BY l_orderkey)
    ON o_orderkey = l_orderkey)"""


def cls_pairs(spark, sf):
    li = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("nf"),
        F.count_if(F.col("l_linestatus") == "O").alias("no"))
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    j = o.join(li, o.o_orderkey == li.l_orderkey)
    return j.select("o_orderkey", F.col("o_orderstatus").alias("y"),
                    F.when(F.col("nf") == F.col("n"), "F").when(F.col("no") == F.col("n"), "O")
                     .otherwise("P").alias("yhat"))


# Binary pairs: document quality label vs a length rule; score = n_chars.
BIN_PAIRS_SQL = """(SELECT l.doc_id, l.quality AS y, CASE WHEN d.n_chars > 2000 THEN 1 ELSE 0 END AS yhat,
    d.n_chars AS score, 1.0 / (1.0 + exp(-(d.n_chars - 2000) / 1000.0)) AS p1
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def bin_pairs(spark, sf):
    lab = load(spark, sf, "labels")
    d = load(spark, sf, "documents").select("doc_id", "n_chars")
    j = lab.join(d, "doc_id")
    return j.select("doc_id", F.col("quality").alias("y"),
                    F.when(F.col("n_chars") > 2000, 1).otherwise(0).alias("yhat"),
                    F.col("n_chars").alias("score"),
                    (1.0 / (1.0 + F.exp(-(F.col("n_chars") - 2000) / 1000.0))).alias("p1"))


def _metrics_sql(src, by=""):
    g = f"GROUP BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"""SELECT {sel}count(*) AS n, {R('avg(abs(y - yhat))')} AS mae, {R('avg((y - yhat) * (y - yhat))')} AS mse,
        {R('sqrt(avg((y - yhat) * (y - yhat)))')} AS rmse,
        {R('1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*))')} AS r2 FROM {src} {g}"""


def _round_metrics(df, cols):
    return df.withColumns({c: rnd(c) for c in cols})


@reg.add("ml9_regression_metrics", _metrics_sql(REG_PAIRS_SQL))
def ml9(spark, sf):
    return _round_metrics(EV.regression_metrics(reg_pairs(spark, sf), "y", "yhat"), ["mae", "mse", "rmse", "r2"])


@reg.add("ml20_multi_target_metrics", _metrics_sql(f"""(SELECT 'total' AS target, y, yhat FROM {REG_PAIRS_SQL}
    UNION ALL SELECT 'quantity', y2, yhat2 FROM {REG_PAIRS_SQL})""", "target"))
def ml20(spark, sf):
    m = EV.multi_target_metrics(reg_pairs(spark, sf), {"y": "yhat", "y2": "yhat2"})
    m = m.withColumn("target", F.when(F.col("target") == "y", "total").otherwise("quantity"))
    return _round_metrics(m, ["mae", "mse", "rmse", "r2"])


def _cls_sql(src):
    return f"""WITH cc AS (SELECT CAST(y AS VARCHAR) AS t, CAST(yhat AS VARCHAR) AS p, count(*) AS c FROM {src} GROUP BY 1, 2),
    tn AS (SELECT t AS cls, sum(c) AS support FROM cc GROUP BY t),
    pn AS (SELECT p AS cls, sum(c) AS predicted FROM cc GROUP BY p),
    tp AS (SELECT t AS cls, c AS tp FROM cc WHERE t = p),
    per AS (SELECT coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
        coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0) AS pr,
        coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0) AS rc
        FROM tn FULL JOIN pn USING (cls) LEFT JOIN tp USING (cls)),
    per2 AS (SELECT *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0) AS f FROM per)
    SELECT CAST(sum(support) AS BIGINT) AS n, {R('sum(tp) / sum(support)')} AS accuracy,
        {R('sum(pr * support) / sum(support)')} AS precision, {R('sum(rc * support) / sum(support)')} AS recall,
        {R('sum(f * support) / sum(support)')} AS f1 FROM per2"""


@reg.add("ml10_classification_metrics", _cls_sql(CLS_PAIRS_SQL))
def ml10(spark, sf):
    m = EV.classification_metrics(cls_pairs(spark, sf), "y", "yhat")
    return _round_metrics(m, ["accuracy", "precision", "recall", "f1"]).withColumn("n", F.col("n").cast("long"))


@reg.add("ml10_binary_metrics", _cls_sql(BIN_PAIRS_SQL))
def ml10b(spark, sf):
    m = EV.classification_metrics(bin_pairs(spark, sf), "y", "yhat")
    return _round_metrics(m, ["accuracy", "precision", "recall", "f1"]).withColumn("n", F.col("n").cast("long"))


@reg.add("ml10_whole_labels_double_predictions", _cls_sql(BIN_PAIRS_SQL))
def ml10_mixed(spark, sf):
    b = bin_pairs(spark, sf).withColumn("yhat", F.col("yhat").cast("double"))
    m = EV.classification_metrics(b, "y", "yhat")
    return _round_metrics(m, ["accuracy", "precision", "recall", "f1"]).withColumn("n", F.col("n").cast("long"))


@reg.add("ml11_log_loss", f"""SELECT {R('avg(-ln(least(greatest(CASE WHEN y = 1 THEN p1 ELSE 1 - p1 END, 1e-15), 1 - 1e-15)))')}
    AS log_loss FROM {BIN_PAIRS_SQL}""")
def ml11(spark, sf):
    b = bin_pairs(spark, sf).withColumn("pt", F.when(F.col("y") == 1, F.col("p1")).otherwise(1 - F.col("p1")))
    return EV.log_loss(b, "y", "pt").select(rnd("log_loss").alias("log_loss"))


@reg.add("ml13_confusion_matrix", f"""WITH cc AS (SELECT y AS t, yhat AS p, count(*) AS c FROM {CLS_PAIRS_SQL} GROUP BY 1, 2),
    l AS (SELECT t AS l FROM cc UNION SELECT p FROM cc)
    SELECT a.l AS "true", b.l AS pred, CAST(coalesce(c, 0) AS BIGINT) AS count
    FROM l a CROSS JOIN l b LEFT JOIN cc ON cc.t = a.l AND cc.p = b.l""")
def ml13(spark, sf):
    return EV.confusion_matrix(cls_pairs(spark, sf), "y", "yhat")


@reg.add("ml13_confusion_with_names", f"""WITH cc AS (SELECT CAST(y AS VARCHAR) AS t, CAST(yhat AS VARCHAR) AS p,
    count(*) AS c FROM {BIN_PAIRS_SQL} GROUP BY 1, 2),
    l AS (SELECT t AS l FROM cc UNION SELECT p FROM cc)
    SELECT a.l AS "true", b.l AS pred, CAST(coalesce(c, 0) AS BIGINT) AS count,
      CASE a.l WHEN '0' THEN 'Clear' WHEN '1' THEN 'Partly Cloudy' END AS true_label,
      CASE b.l WHEN '0' THEN 'Clear' WHEN '1' THEN 'Partly Cloudy' END AS pred_label
    FROM l a CROSS JOIN l b LEFT JOIN cc ON cc.t = a.l AND cc.p = b.l""")
def ml13n(spark, sf):
    return EV.confusion_matrix(bin_pairs(spark, sf), "y", "yhat", with_names=True)


@reg.add("ml13_confusion_with_names_of_doubles", f"""WITH cc AS (SELECT y AS t, yhat AS p, count(*) AS c FROM {BIN_PAIRS_SQL} GROUP BY 1, 2),
    l AS (SELECT t AS l FROM cc UNION SELECT p FROM cc)
    SELECT CAST(a.l AS VARCHAR) AS "true", CAST(b.l AS VARCHAR) AS pred, CAST(coalesce(c, 0) AS BIGINT) AS count,
      CASE a.l WHEN 0 THEN 'Clear' WHEN 1 THEN 'Partly Cloudy' END AS true_label,
      CASE b.l WHEN 0 THEN 'Clear' WHEN 1 THEN 'Partly Cloudy' END AS pred_label
    FROM l a CROSS JOIN l b LEFT JOIN cc ON cc.t = a.l AND cc.p = b.l""")
def ml13_doubles(spark, sf):
    b = bin_pairs(spark, sf).withColumn("yhat", F.col("yhat").cast("double"))
    return EV.confusion_matrix(b, "y", "yhat", with_names=True)


@reg.add("ml13_confusion_with_text_names", f"""WITH cc AS (SELECT y AS t, yhat AS p, count(*) AS c FROM {CLS_PAIRS_SQL} GROUP BY 1, 2),
    l AS (SELECT t AS l FROM cc UNION SELECT p FROM cc)
    SELECT a.l AS "true", b.l AS pred, CAST(coalesce(c, 0) AS BIGINT) AS count, a.l AS true_label, b.l AS pred_label
    FROM l a CROSS JOIN l b LEFT JOIN cc ON cc.t = a.l AND cc.p = b.l""")
def ml13_text(spark, sf):
    return EV.confusion_matrix(cls_pairs(spark, sf), "y", "yhat", with_names=True)


@reg.add("ml14_regression_confusion", f"""WITH p AS (SELECT y, yhat FROM {REG_PAIRS_SQL}),
    r AS (SELECT min(y) AS lo, max(y) AS hi FROM p),
    c AS (SELECT CAST(least(greatest(floor((y - lo) / ((hi - lo) / 5.0)), 0), 4) AS INTEGER) AS true_bin,
                 CAST(least(greatest(floor((least(greatest(yhat, lo), hi) - lo) / ((hi - lo) / 5.0)), 0), 4) AS INTEGER) AS pred_bin,
                 count(*) AS n FROM p, r GROUP BY 1, 2),
    g AS (SELECT CAST(a.range AS INTEGER) AS true_bin, CAST(b.range AS INTEGER) AS pred_bin FROM range(5) a, range(5) b)
    SELECT g.true_bin, g.pred_bin, CAST(coalesce(n, 0) AS BIGINT) AS count FROM g LEFT JOIN c USING (true_bin, pred_bin)""")
def ml14(spark, sf):
    return EV.regression_confusion(reg_pairs(spark, sf), "y", "yhat", 5)


@reg.add("ml15_ml16_residual_stats", f"""SELECT {R('avg(y - yhat)')} AS residual_mean, {R('stddev_pop(y - yhat)')} AS residual_std,
    {R('avg(abs(y - yhat))')} AS mae, {R('avg(y)')} AS true_mean, {R('stddev_pop(y)')} AS true_std, {R('min(y)')} AS true_min,
    {R('max(y)')} AS true_max, {R('avg(yhat)')} AS pred_mean, {R('stddev_pop(yhat)')} AS pred_std, {R('min(yhat)')} AS pred_min,
    {R('max(yhat)')} AS pred_max FROM {REG_PAIRS_SQL}""")
def ml15(spark, sf):
    s = EV.residual_stats(reg_pairs(spark, sf), "y", "yhat")
    return s.select(*[rnd(c).alias(c) for c in s.columns])


@reg.add("ml15_first_100_residuals", f"""SELECT o_orderkey, {R('y - yhat')} AS residual FROM {REG_PAIRS_SQL}
    ORDER BY o_orderkey LIMIT 100""")
def ml15r(spark, sf):
    r = EV.first_residuals(reg_pairs(spark, sf), "y", "yhat", ["o_orderkey"], 100)
    return r.withColumn("residual", rnd("residual"))


@reg.add("ml17_scatter_sample", f"""SELECT o_orderkey, {R('y')} AS y, {R('yhat')} AS yhat FROM {REG_PAIRS_SQL}
    ORDER BY md5(concat_ws(':', '42', CAST(o_orderkey AS VARCHAR))) LIMIT 500""")
def ml17(spark, sf):
    s = EV.scatter_sample(reg_pairs(spark, sf), ["o_orderkey"], 500, 42)
    return s.select("o_orderkey", rnd("y").alias("y"), rnd("yhat").alias("yhat"))


@reg.add("ml18_d6_task_and_problem_type", f"""SELECT (SELECT count(DISTINCT y) FROM {REG_PAIRS_SQL}) AS distinct_true,
    CASE WHEN (SELECT count(DISTINCT y) FROM {REG_PAIRS_SQL}) <= 20 THEN 'classification' ELSE 'regression' END AS task,
    (SELECT CASE WHEN count(DISTINCT y) <= 2 THEN 'binary' ELSE 'multiclass' END FROM {CLS_PAIRS_SQL}) AS status_problem,
    (SELECT CASE WHEN count(DISTINCT y) <= 2 THEN 'binary' ELSE 'other' END FROM {BIN_PAIRS_SQL}) AS quality_problem""")
def ml18(spark, sf):
    t = EV.task_type(reg_pairs(spark, sf), "y")
    p1 = EV.problem_type(cls_pairs(spark, sf), "y").select(F.col("problem_type").alias("status_problem"))
    p2 = EV.problem_type(bin_pairs(spark, sf), "y").select(
        F.when(F.col("problem_type") == "binary", "binary").otherwise("other").alias("quality_problem"))
    return t.crossJoin(p1).crossJoin(p2)  # three one-row tables


@reg.add("d6_problem_types", """SELECT 'total' AS target, count(DISTINCT o_totalprice) AS k, count(o_totalprice) AS n, 'regression' AS problem_type FROM orders
    UNION ALL SELECT 'month', count(DISTINCT month(o_orderdate)), count(*), CASE WHEN count(DISTINCT month(o_orderdate)) <= 2 THEN 'binary'
      WHEN count(DISTINCT month(o_orderdate)) < 20 AND count(DISTINCT month(o_orderdate)) < count(*) * 0.05 THEN 'multiclass' ELSE 'regression' END FROM orders
    UNION ALL SELECT 'name', count(DISTINCT s_name), count(s_name), 'multiclass' FROM supplier""")
def d6(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_totalprice").alias("total"), F.month("o_orderdate").alias("month"))
    s = load(spark, sf, "supplier").select(F.col("s_name").alias("name"))
    out = None
    for frame, c in ((o, "total"), (o, "month"), (s, "name")):
        x = EV.problem_type(frame, c).select(F.lit(c).alias("target"), "k", "n", "problem_type")
        out = x if out is None else out.unionByName(x)
    return out


@reg.add("ml21_residual_histogram_edges", f"""WITH d AS (SELECT y - yhat AS x FROM {REG_PAIRS_SQL}),
    r AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 30.0 AS w FROM d)
    SELECT CAST(range AS INTEGER) AS bin, {R('lo + range * w')} AS bin_start,
      {R('CASE WHEN range = 29 THEN hi ELSE lo + (range + 1) * w END')} AS bin_end FROM range(30), r""")
def ml21_edges(spark, sf):
    h = EV.residual_histogram(reg_pairs(spark, sf), "y", "yhat", 30)
    return h.select("bin", rnd("bin_start").alias("bin_start"), rnd("bin_end").alias("bin_end"))


@reg.add("ml21_residual_histogram_30", f"""WITH d AS (SELECT y - yhat AS x FROM {REG_PAIRS_SQL}),
    r AS (SELECT min(x) AS lo, max(x) AS hi FROM d),
    c AS (SELECT CAST(least(greatest(floor((x - lo) / ((hi - lo) / 30.0)), 0), 29) AS INTEGER) AS bin, count(*) AS n
          FROM d, r GROUP BY 1),
    f AS (SELECT CAST(range AS INTEGER) AS bin FROM range(30))
    SELECT f.bin, CAST(coalesce(n, 0) AS BIGINT) AS count FROM f LEFT JOIN c USING (bin)""")
def ml21(spark, sf):
    return EV.residual_histogram(reg_pairs(spark, sf), "y", "yhat", 30).select("bin", "count")


@reg.add("ml22_best_epoch", """SELECT conv_id, CAST(list_position(l, list_min(l)) AS INTEGER) AS best_epoch,
    list_min(l) AS best_loss FROM (SELECT conv_id, list(CAST(length(text) AS DOUBLE) ORDER BY turn) AS l
    FROM conversations GROUP BY conv_id)""")
def ml22(spark, sf):
    c = load(spark, sf, "conversations")
    rows = c.select("conv_id", (F.col("turn") + 1).cast("int").alias("epoch"), F.length("text").cast("double").alias("loss"))
    return EV.best_epoch_of_rows(rows, "conv_id", "epoch", "loss")


@reg.add("x2_mape_auc", f"""WITH a AS (SELECT {R('avg(abs((y - yhat) / y)) * 100')} AS mape FROM {REG_PAIRS_SQL} WHERE y <> 0),
    s AS (SELECT score, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM {BIN_PAIRS_SQL} GROUP BY score),
    c AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM s),
    auc AS (SELECT {R('sum(pos * (cum - neg) + pos * neg * 0.5) / (sum(pos) * sum(neg))')} AS auc FROM c)
    SELECT mape, auc FROM a, auc""")
def x2(spark, sf):
    m = EV.mape(reg_pairs(spark, sf), "y", "yhat").select(rnd("mape").alias("mape"))
    a = EV.roc_auc(bin_pairs(spark, sf), "y", "score").select(rnd("auc").alias("auc"))
    return m.crossJoin(a)  # two one-row tables


@reg.add("x5_regression_line", f"""SELECT {R('regr_slope(yhat, y)')} AS slope, {R('regr_intercept(yhat, y)')} AS intercept,
    {R('regr_r2(yhat, y)')} AS r2, CAST(regr_count(yhat, y) AS BIGINT) AS n FROM {REG_PAIRS_SQL}""")
def x5(spark, sf):
    s = EV.simple_regression(reg_pairs(spark, sf), "y", "yhat")
    return s.select(rnd("slope").alias("slope"), rnd("intercept").alias("intercept"), rnd("r2").alias("r2"),
                    F.col("n").cast("long"))


@reg.add("ml6_class_weights", f"""WITH c AS (SELECT quality, count(*) AS nc FROM labels GROUP BY quality),
    t AS (SELECT sum(nc) AS n, count(*) AS k FROM c)
    SELECT doc_id, quality, {R('n / (k * nc)')} AS weight FROM labels JOIN c USING (quality), t""")
def ml6(spark, sf):
    w = TR.class_weights(load(spark, sf, "labels").select("doc_id", "quality"), "quality")
    return w.select("doc_id", "quality", rnd("weight").alias("weight"))


# ------------------------------------------------- MLlib training (rows-only)
def _order_features(spark, sf):
    li = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"), F.count(F.lit(1)).alias("lines"),
        F.sum("l_extendedprice").alias("gross"))
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    # joined once: splits, folds and fits go over these rows many times
    return o.join(li, o.o_orderkey == li.l_orderkey).drop("l_orderkey").checkpoint(eager=True)


FEATS = ["qty", "disc", "lines", "gross"]


@reg.add("ml1_decision_tree_classifier")
def ml1(spark, sf):
    e = load(spark, sf, "embeddings").withColumn("features", array_to_vector("embedding"))
    e = S.random_split(e, ["vec_id"], 0.8, 0.0, 0.2, seed=42).withColumn("label", F.col("label").cast("double"))
    est = TR.estimator("decision_tree", True, {"max_depth": 5, "random_state": 42})
    m = est.fit(e.filter(F.col("split") == "train"))
    return m.transform(e.filter(F.col("split") == "test")).select("vec_id", "label", "prediction")


@reg.add("ml2_ml7_random_forest_regression")
def ml2(spark, sf):
    o = S.random_split(_order_features(spark, sf), ["o_orderkey"], 0.7, 0.15, 0.15, seed=42)
    res = TR.train(o, FEATS, "o_totalprice", "random_forest",
                   {"n_estimators": 20, "max_depth": 6, "random_state": 42}, classification=False)
    return res.metrics


@reg.add("ml3_gbt_binary_classifier")
def ml3(spark, sf):
    lab = load(spark, sf, "labels")
    d = load(spark, sf, "documents").select("doc_id", "n_chars", F.length("text").alias("len"),
                                            F.size(F.split("text", "\n")).alias("n_lines"))
    j = S.random_split(lab.join(d, "doc_id"), ["doc_id"], 0.7, 0.15, 0.15, seed=42)
    res = TR.train(j, ["n_chars", "len", "n_lines"], "quality", "xgboost",
                   {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.1, "random_state": 42},
                   classification=True, balanced=True)
    return res.metrics


@reg.add("ml3_gbt_multiclass_one_vs_rest")
def ml3m(spark, sf):
    o = S.random_split(_order_features(spark, sf), ["o_orderkey"], 0.7, 0.15, 0.15, seed=42)
    o = o.withColumn("status", F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
                     .otherwise(2))
    res = TR.train(o, FEATS, "status", "xgboost", {"n_estimators": 5, "max_depth": 3, "random_state": 42},
                   classification=True)
    return res.metrics


@reg.add("ml8_batch_scoring")
def ml8(spark, sf):
    o = S.random_split(_order_features(spark, sf), ["o_orderkey"], 0.7, 0.15, 0.15, seed=42)
    res = TR.train(o, FEATS, "o_totalprice", "decision_tree", {"max_depth": 5}, classification=False)
    return TR.score(res.model, o, keep=["o_orderkey", "o_totalprice"])


@reg.add("ml19_feature_importance_top20")
def ml19(spark, sf):
    o = S.random_split(_order_features(spark, sf), ["o_orderkey"], 0.7, 0.15, 0.15, seed=42)
    res = TR.train(o, FEATS, "o_totalprice", "random_forest", {"n_estimators": 10, "random_state": 42},
                   classification=False)
    return EV.feature_importance(spark, FEATS, res.model.stages[-1].featureImportances.toArray(), 20)


# ---- closed forms: trees over one 0/1 feature predict the means of the two groups
STUMP_SQL = f"""(SELECT o_orderkey, o_orderstatus, o_totalprice / 1000.0 AS y, CAST(o_orderstatus = 'F' AS INTEGER) AS flag,
    CASE WHEN o_orderkey % 3 = 0 THEN 'test' ELSE 'train' END AS split, CAST(o_orderkey % 4 AS INTEGER) AS fold FROM orders)"""


def stump_rows(spark, sf):
    k = F.col("o_orderkey")
    return load(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", (F.col("o_totalprice") / 1000.0).alias("y"),
        (F.col("o_orderstatus") == "F").cast("int").alias("flag"),
        F.when(k % 3 == 0, "test").otherwise("train").alias("split"), (k % 4).cast("int").alias("fold"))


STUMP_PREDICTED = f"""WITH t AS (SELECT flag, avg(y) AS m FROM {STUMP_SQL} WHERE split = 'train' GROUP BY flag)
    SELECT o_orderkey, {R('m', 3)} AS prediction FROM {STUMP_SQL} JOIN t USING (flag) WHERE split = 'test'"""


def _stump(spark, sf, model, params):
    r = TR.train(stump_rows(spark, sf), ["flag"], "y", model, params, classification=False)
    return r.predictions.select("o_orderkey", rnd("prediction", 3).alias("prediction"))


@reg.add("x12_grid_search_over_given_folds", f"""WITH t AS (SELECT k.fold AS fold, flag, avg(y) AS m FROM {STUMP_SQL} x, (VALUES (0), (1), (2), (3)) k(fold)
      WHERE x.fold <> k.fold GROUP BY 1, 2),
    e AS (SELECT t.fold, sqrt(avg((y - m) * (y - m))) AS rmse FROM {STUMP_SQL} x JOIN t ON x.flag = t.flag AND x.fold = t.fold GROUP BY 1)
    SELECT CAST(g AS INTEGER) AS grid_point, {R('avg(rmse)', 3)} AS avg_rmse FROM e, (VALUES (0), (1)) v(g) GROUP BY g""")
def x12_folds(spark, sf):
    # deeper trees cannot split a 0/1 feature again: both grid points are the stump
    m = TR.grid_search(stump_rows(spark, sf), ["flag"], "y", {"maxDepth": [1, 3]}, folds=4, model_type="decision_tree",
                       fold_col="fold")
    rows = [(i, float(v)) for i, v in enumerate(m.avgMetrics)]
    return spark.createDataFrame(rows, "grid_point int, avg_rmse double").withColumn("avg_rmse", rnd("avg_rmse", 3))


# one feature: the coefficient of the standardised feature is its covariance with the target, moved to 0 by λ
LASSO_FIT = """SELECT f.fold, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) / stddev_pop(x) AS g
    FROM p JOIN f ON p.fold <> f.fold GROUP BY f.fold"""


@reg.add("x4_lasso_path_cross_validated", f"""WITH p AS (SELECT p_retailprice AS y, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 4 AS INTEGER) AS fold FROM part),
    f AS (SELECT DISTINCT fold FROM p), l AS (SELECT unnest(CAST([0.5, 2.0, 10.0, 1000000.0] AS DOUBLE[])) AS reg), fit AS ({LASSO_FIT}),
    b AS (SELECT *, sign(g) * greatest(abs(g) - reg, 0) / sx AS b FROM fit, l),
    e AS (SELECT reg, b.fold, avg((y - my - b * (x - mx)) * (y - my - b * (x - mx))) AS mse FROM p JOIN b ON p.fold = b.fold GROUP BY 1, 2),
    a AS (SELECT covar_pop(x, y) / stddev_pop(x) AS g FROM p)
    SELECT reg, {R('avg(mse)', 3)} AS mse, {R('stddev_pop(mse)', 3)} AS std, CAST(any_value(abs(g)) > reg AS INTEGER) AS features_used FROM e, a GROUP BY reg""")
def x4_path(spark, sf):
    p = load(spark, sf, "part").select("p_retailprice", "p_size", (F.col("p_partkey") % 4).alias("fold"))
    path, _ = SE.lasso_path(p, ["p_size"], "p_retailprice", [0.5, 2.0, 10.0, 1e6])
    return path.withColumns({c: rnd(c, 3) for c in ("mse", "std")})


@reg.add("x12_random_search_classes", f"""WITH c AS (SELECT k.fold, flag, o_orderstatus AS s, count(*) AS n FROM {STUMP_SQL} x, (VALUES (0), (1), (2), (3)) k(fold) WHERE x.fold <> k.fold GROUP BY 1, 2, 3),
    m AS (SELECT fold, flag, arg_max(s, n) AS s FROM c GROUP BY 1, 2),
    a AS (SELECT x.fold, avg(CAST(o_orderstatus = m.s AS INTEGER)) AS acc FROM {STUMP_SQL} x JOIN m ON x.fold = m.fold AND x.flag = m.flag GROUP BY 1)
    SELECT CAST(candidate AS INTEGER) AS candidate, CAST(4 AS INTEGER) AS folds, {R('avg(acc)')} AS score FROM a, (VALUES (0), (1)) v(candidate) GROUP BY candidate""")
def x12_random(spark, sf):
    # any depth is the stump of a 0/1 feature, so all candidates stay level and the last round has every fold
    r = SE.random_search(stump_rows(spark, sf), ["flag"], "o_orderstatus", {"max_depth": (1, 2)}, n=2, model_type="decision_tree",
                         classification=True, eta=1)
    return r.select("candidate", "folds", rnd("score").alias("score"))


@reg.add("ml1_ml7_stump_group_means", STUMP_PREDICTED)
def ml1_stump(spark, sf):
    return _stump(spark, sf, "decision_tree", {"max_depth": 1})


@reg.add("ml2_forest_without_bootstrap", STUMP_PREDICTED)
def ml2_plain(spark, sf):
    return _stump(spark, sf, "random_forest", {"max_depth": 1, "n_estimators": 3, "bootstrap": False, "max_features": 1.0})


@reg.add("ml3_one_boosting_round", STUMP_PREDICTED)
def ml3_once(spark, sf):
    return _stump(spark, sf, "xgboost", {"max_depth": 1, "n_estimators": 1})


# x1 explains 10, x2 explains 4 of the target in training but 1.2 in validation. The first tree takes x1;
# then each round closes a fifth of the gap of x2, so after m rounds it has 4 · (1 − 0.8^m).
@reg.add("ml3_early_stopping_rounds", f"""WITH x AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'test' WHEN o_orderkey % 5 = 1 THEN 'val' ELSE 'train' END AS split FROM orders),
    m AS (SELECT 1 + arg_min(m, abs(4 * (1 - pow(0.8, m)) - 1.2)) AS trees FROM range(1, 40) r(m))
    SELECT split, count(*) AS n, CAST(any_value(trees) AS INTEGER) AS trees FROM x, m GROUP BY split""")
def ml3_stop(spark, sf):
    k = F.col("o_orderkey")
    x1, x2 = (k % 2).cast("int"), (F.floor(k / 2) % 2).cast("int")
    o = load(spark, sf, "orders").select(
        "o_orderkey", x1.alias("x1"), x2.alias("x2"),
        F.when(k % 5 == 0, "test").when(k % 5 == 1, "val").otherwise("train").alias("split"))
    o = o.withColumn("y", 10.0 * F.col("x1") + F.when(F.col("split") == "val", 1.2).otherwise(4.0) * F.col("x2"))
    r = TR.train(o, ["x1", "x2"], "y", "xgboost", {"n_estimators": 30, "max_depth": 1, "learning_rate": 0.1,
                                                    "early_stopping_rounds": 5, "random_state": 1}, classification=False)
    return o.groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumn("trees", F.lit(r.model.stages[-1].getNumTrees))


@reg.add("ml7_text_target", f"""WITH c AS (SELECT flag, o_orderstatus AS s, count(*) AS n FROM {STUMP_SQL} WHERE split = 'train' GROUP BY 1, 2),
    t AS (SELECT flag, arg_max(s, n) AS s FROM c GROUP BY flag)
    SELECT o_orderkey, t.s AS prediction_label FROM {STUMP_SQL} x JOIN t USING (flag) WHERE split = 'test'""")
def ml7_text(spark, sf):
    r = TR.train(stump_rows(spark, sf), ["flag"], "o_orderstatus", "decision_tree", {"max_depth": 1}, scale=True)
    return r.predictions.select("o_orderkey", "prediction_label")


def _saved(spark, model):
    """A pipeline as it comes back from storage."""
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex[:12]}"
    TR.save_model(model, path)
    return TR.load_model(path)


# a tree that is deep enough predicts the mean of each (segment, nation)
@reg.add("s10_saved_pipeline_scores", f"""SELECT c_custkey, {R('avg(c_acctbal) OVER (PARTITION BY c_mktsegment, c_nationkey)', 3)} AS prediction FROM customer""")
def s10_scores(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    prep = E.fit_preprocessing(c, ["c_mktsegment", "c_nationkey"], scale="min_max", categorical=["c_mktsegment"],
                               encoding_method="sparse")
    r = TR.train(c, [], "c_acctbal", "decision_tree", {"max_depth": 30}, classification=False, preparation=prep)
    return _saved(spark, r.pipeline).transform(c).select("c_custkey", rnd("prediction", 3).alias("prediction"))


@reg.add("s10_saved_pipeline_labels", """WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS c FROM customer GROUP BY 1, 2),
    best AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c DESC, c_mktsegment) = 1)
    SELECT c_custkey, best.c_mktsegment AS prediction_label FROM customer JOIN best USING (c_nationkey)""")
def s10_labels(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"))
    prep = E.fit_preprocessing(c, ["nation"], scale=None, categorical=["nation"], cyclic_cols=[])
    r = TR.train(c, [], "c_mktsegment", "decision_tree", {"max_depth": 30}, preparation=prep)
    rows = c.drop("c_mktsegment")  # a loaded model needs no target
    return _saved(spark, r.pipeline).transform(rows).select("c_custkey", "prediction_label")


@reg.add("ml7_ml8_two_targets", f"""WITH b AS (SELECT *, y * 2 + 1 AS y2 FROM {STUMP_SQL}),
    t AS (SELECT flag, avg(y) AS m, avg(y2) AS m2 FROM b WHERE split = 'train' GROUP BY flag)
    SELECT o_orderkey, target, {R("CASE target WHEN 'y' THEN m ELSE m2 END", 3)} AS prediction
    FROM b JOIN t USING (flag), (VALUES ('y'), ('y2')) v(target)""")
def ml7_two(spark, sf):
    rows = stump_rows(spark, sf).withColumn("y2", F.col("y") * 2 + 1)
    fitted = TR.train_targets(rows, ["flag"], ["y", "y2"], model_type="decision_tree", params={"max_depth": 1},
                              classification=False)
    return TR.score_targets(fitted, rows, ["o_orderkey"]).withColumn("prediction", rnd("prediction", 3))


CV_STUMP = f"""t AS (SELECT k.fold AS fold, flag, avg(y) AS m FROM {STUMP_SQL} x, (VALUES (0), (1), (2), (3)) k(fold)
      WHERE x.fold <> k.fold GROUP BY 1, 2),
    e AS (SELECT t.fold, x.fold = t.fold AS out, avg((y - m) * (y - m)) AS mse FROM {STUMP_SQL} x JOIN t USING (flag) GROUP BY 1, 2)"""


@reg.add("cv8_fold_scores", f"""WITH {CV_STUMP}
    SELECT fold, {R('-max(CASE WHEN out THEN mse END)', 3)} AS score, {R('-max(CASE WHEN NOT out THEN mse END)', 3)} AS train_score
    FROM e GROUP BY fold""")
def cv8_folds(spark, sf):
    r = TR.cv_run(stump_rows(spark, sf), ["flag"], "y", "fold", "decision_tree", {"max_depth": 1}, refit=False)
    return r.folds.withColumns({c: rnd(c, 3) for c in ("score", "train_score")})


@reg.add("cv8_refit_on_all_rows", f"""WITH t AS (SELECT flag, avg(y) AS m FROM {STUMP_SQL} GROUP BY flag)
    SELECT o_orderkey, {R('m', 3)} AS prediction FROM {STUMP_SQL} JOIN t USING (flag)""")
def cv8_refit(spark, sf):
    rows = stump_rows(spark, sf)
    r = TR.cv_run(rows, ["flag"], "y", "fold", "decision_tree", {"max_depth": 1})
    return TR.score(r.model, rows, keep=["o_orderkey"]).withColumn("prediction", rnd("prediction", 3))


@reg.add("ml6_weights_of_train_rows", f"""WITH t AS (SELECT o_orderstatus, count(*) AS n FROM {STUMP_SQL} WHERE split = 'train' GROUP BY 1)
    SELECT o_orderkey, {R('(SELECT sum(n) FROM t) / ((SELECT count(*) FROM t) * t.n)')} AS weight
    FROM {STUMP_SQL} x JOIN t USING (o_orderstatus)""")
def ml6_train(spark, sf):
    rows = stump_rows(spark, sf)
    w = TR.class_weights(rows, "o_orderstatus", rows=rows.filter("split = 'train'"))
    return w.select("o_orderkey", rnd("weight").alias("weight"))


@reg.add("ml19_importance_of_the_only_feature", "SELECT 'flag' AS feature, CAST(1.0 AS DOUBLE) AS importance FROM orders LIMIT 1")
def ml19_only(spark, sf):
    r = TR.train(stump_rows(spark, sf), ["flag"], "y", "decision_tree", {"max_depth": 1}, classification=False)
    return EV.feature_importance(spark, ["flag"], r.model.stages[-1].featureImportances.toArray(), 20)


@reg.add("a18_pca_of_two_columns", f"""WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
    SELECT CAST(1 AS INTEGER) AS component, {R('(1 + r) / 2')} AS ratio, {R('(1 + r) / 2')} AS cumulative FROM c
    UNION ALL SELECT 2, {R('(1 - r) / 2')}, {R('1.0')} FROM c""")
def a18_two(spark, sf):
    var, _, _ = TR.pca(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], k=2)
    return var.withColumns({c: rnd(c) for c in ("ratio", "cumulative")})


@reg.add("a19_k3_projection_and_loadings", f"""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq,
      avg(l_extendedprice) AS mp, stddev_samp(l_extendedprice) AS sp, corr(l_quantity, l_extendedprice) AS r FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      {R("abs((l_quantity - mq) / sq + sign(r) * (l_extendedprice - mp) / sp) / sqrt(2.0)")} AS pc1,
      {R("abs((l_quantity - mq) / sq - sign(r) * (l_extendedprice - mp) / sp) / sqrt(2.0)")} AS pc2,
      {R("sqrt((1 + abs(r)) / 2)")} AS loading FROM lineitem, s""")
def a19_two(spark, sf):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    _, loadings, proj = TR.pca(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], k=2, key=key)
    # signs of a component are arbitrary; both features load equally on the first
    first = loadings.filter("component = 1").agg(F.avg(F.abs("loading")).alias("loading"))
    return proj.crossJoin(F.broadcast(first)).select(*key, rnd(F.abs("pc1")).alias("pc1"), rnd(F.abs("pc2")).alias("pc2"),
                                                     rnd("loading").alias("loading"))


@reg.add("cv8_cross_validation_run")
def cv8(spark, sf):
    o = S.kfold(_order_features(spark, sf), ["o_orderkey"], 3, seed=42)
    return TR.cross_validate(o, FEATS, "o_totalprice", "fold", "decision_tree", {"max_depth": 4})


@reg.add("a18_pca_variance")
def a18(spark, sf):
    var, _, _ = TR.pca(load(spark, sf, "embeddings"), vector_col="embedding", k=10, key=["vec_id"])
    return var


@reg.add("a18_pca_top_contributors")
def a18b(spark, sf):
    _, loadings, _ = TR.pca(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], k=4)
    return TR.top_contributors(loadings, 3, 5)


@reg.add("a19_pca_projection")
def a19(spark, sf):
    _, _, proj = TR.pca(load(spark, sf, "embeddings"), vector_col="embedding", k=2, key=["vec_id"])
    return proj


@reg.add("x8_kmeans_clusters")
def x8(spark, sf):
    return TR.kmeans(load(spark, sf, "embeddings"), k=5, vector_col="embedding").select("vec_id", "cluster")


@reg.add("x4_lasso_selection")
def x4(spark, sf):
    return TR.lasso_selection(_order_features(spark, sf), FEATS, "o_totalprice", 0.1)


@reg.add("x13_mlp_classifier")
def x13(spark, sf):
    _, pred = TR.mlp(load(spark, sf, "embeddings"), "embedding", "label", hidden=(16,), max_iter=20)
    return pred.select("vec_id", "label", "prediction")


# ------------------------------------------------- ensemble votes
# Three "models" give class probabilities over (F, O, P) for every order:
# its line-status shares, a priority rule and a discount rule.
ENS_BASE_SQL = """(SELECT o_orderkey, [nf / n, no_ / n, CAST(0.0 AS DOUBLE)] AS m1,
    [p / 15, (6 - p) / 15, CAST(0.6 AS DOUBLE)] AS m2, [d * 5, 0.5 - d * 5, CAST(0.5 AS DOUBLE)] AS m3
    FROM (SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p, nf, no_, n, d FROM orders
          JOIN (SELECT l_orderkey, count(*) AS n, count_if(l_linestatus = 'F') AS nf,
                       count_if(l_linestatus = 'O') AS no_, """ + R("avg(l_discount)") + """ AS d
                FROM lineitem GROUP BY l_orderkey)
          ON o_orderkey = l_orderkey))"""


def _am(x):
    return f"CAST(list_position({x}, list_max({x})) - 1 AS INTEGER)"


def _elem(f):
    return "[" + ", ".join(f(i) for i in (1, 2, 3)) + "]"


ENS_SQL = f"""WITH m AS {ENS_BASE_SQL},
    v AS (SELECT *, list_transform({_elem(lambda i: f'(m1[{i}] + m2[{i}]) + m3[{i}]')}, lambda x: x / 3.0) AS mean,
      {_elem(lambda i: f'(m1[{i}] * 0.5 + m2[{i}] * 0.3) + m3[{i}] * 0.2')} AS wsum,
      {_elem(lambda i: f'(m1[{i}] * list_max(m1) + m2[{i}] * list_max(m2)) + m3[{i}] * list_max(m3)')} AS csum,
      [{_am('m1')}, {_am('m2')}, {_am('m3')}] AS votes FROM m),
    h AS (SELECT *, {_am("[len(list_filter(votes, lambda v: v = 0)), len(list_filter(votes, lambda v: v = 1)), len(list_filter(votes, lambda v: v = 2))]")} AS hard FROM v)
    SELECT o_orderkey, hard, {_am('mean')} AS soft, {_am('wsum')} AS weighted, {_am('csum')} AS confidence,
      CASE WHEN list_max(m1) >= 0.6 THEN {_am('m1')} WHEN list_max(m2) >= 0.6 THEN {_am('m2')}
           WHEN list_max(m3) >= 0.6 THEN {_am('m3')} ELSE {_am('mean')} END AS cascade,
      {R('list_max(mean)')} AS max_probability,
      {R('list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list_filter(mean, lambda q: q > 0)), lambda acc, q: acc - q * ln(q))')} AS entropy,
      {R('((CAST(votes[1] = hard AS INTEGER) + CAST(votes[2] = hard AS INTEGER)) + CAST(votes[3] = hard AS INTEGER)) / 3.0')} AS agreement
    FROM h"""


@reg.add("x6_x7_ensemble_votes", ENS_SQL)
def x6(spark, sf):
    from cirrus.operators import ensemble as EN
    li = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("nf"),
        F.count_if(F.col("l_linestatus") == "O").alias("no_"), rnd(F.avg("l_discount")).alias("d"))
    # the discount average is rounded so both engines start from the same bits
    o = load(spark, sf, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("p"))
    j = o.join(li, o.o_orderkey == li.l_orderkey)
    m = j.select("o_orderkey",
                 F.array(F.col("nf") / F.col("n"), F.col("no_") / F.col("n"), F.lit(0.0)).alias("m1"),
                 F.array(F.col("p") / 15, (6 - F.col("p")) / 15, F.lit(0.6)).alias("m2"),
                 F.array(F.col("d") * 5, 0.5 - F.col("d") * 5, F.lit(0.5)).alias("m3"))
    arrs = [F.col("m1"), F.col("m2"), F.col("m3")]
    meta = EN.meta_features(arrs, 3)
    return m.select("o_orderkey", EN.hard_vote(arrs, 3).alias("hard"), EN.soft_vote(arrs).alias("soft"),
                    EN.weighted_vote(arrs, [0.5, 0.3, 0.2]).alias("weighted"),
                    EN.confidence_vote(arrs).alias("confidence"), EN.cascade_vote(arrs, 0.6).alias("cascade"),
                    rnd(meta["max_probability"]).alias("max_probability"), rnd(meta["entropy"]).alias("entropy"),
                    rnd(meta["agreement"]).alias("agreement"))
