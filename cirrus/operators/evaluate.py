"""Prediction analysis (ML9–ML22, X2, X5): metrics, confusion matrices,
residuals, importances — all on any (y, ŷ) table.

Metrics are plain aggregates (partial + final, one job). Per-class
quantities come from the (y, ŷ) confusion counts, a table with at most
classes² rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from cirrus.functions.numeric import round_even
from cirrus.operators.profile import bin_index, histogram

EPS = 1e-15

# Weather code names (fixed values), code 0–11.
WEATHER_CODES = ["Clear", "Partly Cloudy", "Mostly Cloudy", "Overcast", "Foggy", "Light Rain", "Rain",
                 "Heavy Rain", "Light Snow", "Snow", "Heavy Snow", "Thunderstorm"]


def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """ML9: MAE, MSE, RMSE, R² (sklearn definitions)."""
    t, p = F.col(y).cast("double"), F.col(yhat).cast("double")
    both = df.filter(t.isNotNull() & p.isNotNull())
    g = both.groupBy(*by) if by else both
    a = g.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(t - p)).alias("mae"), F.avg((t - p) * (t - p)).alias("mse"),
              F.sum((t - p) * (t - p)).alias("_ssr"), F.var_pop(t).alias("_vt"))
    return a.select(*by, "n", "mae", "mse", F.sqrt("mse").alias("rmse"),
                    (F.lit(1.0) - F.try_divide(F.col("_ssr"), F.col("_vt") * F.col("n"))).alias("r2"))


def mape(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Mean absolute percentage error (%), rows with y = 0 skipped."""
    t, p = F.col(y).cast("double"), F.col(yhat).cast("double")
    return df.agg((F.avg(F.abs(F.try_divide(t - p, t))) * 100.0).alias("mape"))


def confusion_counts(df: DataFrame, y: str, yhat: str, round_predictions: bool = True) -> DataFrame:
    """(true, pred, count) for the observed pairs; numeric values are rounded
    half-even first (classification from a regressor). When both sides are
    numeric they get one type, so the label 1 and the prediction 1.0 are one
    class; a text label keeps its text."""
    numeric = {c: isinstance(df.schema[c].dataType, NumericType) for c in (y, yhat)}
    whole = {c: isinstance(df.schema[c].dataType, IntegralType) for c in (y, yhat)}

    def label(c: str) -> Column:
        if not numeric[c] or whole[c]:
            return F.col(c).cast("string")
        x = round_even(F.col(c), 0) if round_predictions else F.col(c).cast("double")
        if whole[y] or whole[yhat] or not (numeric[y] and numeric[yhat]):
            # beside whole numbers or texts a whole double is written without its ".0"
            return F.coalesce(F.when(x == F.rint(x), x.try_cast("long").cast("string")), x.cast("string"))
        return x.cast("string")

    return (df.select(label(y).alias("true"), label(yhat).alias("pred"))
              .filter(F.col("true").isNotNull() & F.col("pred").isNotNull())
              .groupBy("true", "pred").agg(F.count(F.lit(1)).alias("count")))


def classification_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """ML10: accuracy and support-weighted precision, recall, F1 (0 where a
    class has no predicted or no true rows)."""
    cc = confusion_counts(df, y, yhat)
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("true") == F.col("pred"), F.col("count")).otherwise(zero)
    # each pair counts once for its true and once for its predicted class
    roles = F.inline(F.array(
        F.struct(F.col("true").alias("cls"), F.col("count").alias("support"), zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("pred").alias("cls"), zero.alias("support"), F.col("count").alias("predicted"), zero.alias("tp"))))
    per = cc.select(roles).groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    per = per.select("support", "tp", prec.alias("p"), rec.alias("r"), f1.alias("f"))
    return per.agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("p") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("r") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f") * F.col("support")) / F.sum("support")).alias("f1"))


def log_loss(df: DataFrame, y: str, prob_of_true: str, eps: float = EPS) -> DataFrame:
    """ML11: mean −ln p(true class), p clipped to [eps, 1−eps]."""
    p = F.least(F.greatest(F.col(prob_of_true).cast("double"), F.lit(eps)), F.lit(1 - eps))
    return df.agg(F.avg(-F.ln(p)).alias("log_loss"))


def label_names(codes: Column, names: Sequence[str] | None = None) -> Column:
    """Label of a class code: the encoder's classes, else the weather names
    when the code is in range, else `Class_<i>`. A text label that is no number
    stays as it is; 1.0 is the code 1."""
    names = list(names) if names is not None else WEATHER_CODES
    arr = F.array(*[F.lit(n) for n in names])
    x = codes.try_cast("double")
    i = F.when(x == F.rint(x), x.try_cast("int"))
    shown = F.coalesce(i.cast("string"), codes.cast("string"))
    return (F.when(x.isNull(), codes.cast("string"))
             .when((i >= 0) & (i < len(names)), F.get(arr, i)).otherwise(F.concat(F.lit("Class_"), shown)))


def confusion_matrix(df: DataFrame, y: str, yhat: str, names: Sequence[str] | None = None,
                     with_names: bool = False, grid: bool = True) -> DataFrame:
    """ML13 (+U2): every (true, pred) cell over the UNION of the label
    domains, zero cells included, long form; `grid=False` gives the observed
    cells only (for a domain whose square is not wanted)."""
    out = confusion_counts(df, y, yhat)
    if grid:
        # the matrix itself is classes² cells: the zero cells join the counts
        labels = out.select(F.explode(F.array("true", "pred")).alias("l")).distinct()
        zeros = labels.select(F.col("l").alias("true"), F.lit(0).cast("long").alias("count")).crossJoin(
            labels.select(F.col("l").alias("pred")))
        out = (out.unionByName(zeros).groupBy("true", "pred").agg(F.sum("count").alias("count")))
    if with_names:
        out = out.withColumns({"true_label": label_names(F.col("true"), names),
                               "pred_label": label_names(F.col("pred"), names)})
    return out


def regression_confusion(df: DataFrame, y: str, yhat: str, bins: int = 5) -> DataFrame:
    """ML14: 5 equal-width bins on the TRUE range; both values clipped into
    it; all bins² cells."""
    t, p = F.col(y).cast("double"), F.col(yhat).cast("double")
    rng = df.agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    j = df.select(t.alias("_t"), p.alias("_p")).crossJoin(F.broadcast(rng))  # one-row table
    clipped = F.least(F.greatest(F.col("_p"), F.col("_lo")), F.col("_hi"))
    cells = j.groupBy(bin_index(F.col("_t"), F.col("_lo"), F.col("_hi"), bins).alias("true_bin"),
                      bin_index(clipped, F.col("_lo"), F.col("_hi"), bins).alias("pred_bin")).count()
    spark = df.sparkSession
    grid = spark.range(bins).select(F.col("id").cast("int").alias("true_bin")).crossJoin(
        spark.range(bins).select(F.col("id").cast("int").alias("pred_bin")))
    return grid.join(cells, ["true_bin", "pred_bin"], "left").select(
        "true_bin", "pred_bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def residual_stats(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """ML15/ML16: residual mean, std (ddof 0), MAE, and mean/std/min/max of
    the true and predicted values."""
    t, p = F.col(y).cast("double"), F.col(yhat).cast("double")
    r = t - p
    return df.agg(F.avg(r).alias("residual_mean"), F.stddev_pop(r).alias("residual_std"),
                  F.avg(F.abs(r)).alias("mae"),
                  F.avg(t).alias("true_mean"), F.stddev_pop(t).alias("true_std"), F.min(t).alias("true_min"),
                  F.max(t).alias("true_max"), F.avg(p).alias("pred_mean"), F.stddev_pop(p).alias("pred_std"),
                  F.min(p).alias("pred_min"), F.max(p).alias("pred_max"))


def first_residuals(df: DataFrame, y: str, yhat: str, order_by: Sequence[str], n: int = 100) -> DataFrame:
    """ML15: the first n residuals in row order."""
    return df.select(*order_by, (F.col(y).cast("double") - F.col(yhat).cast("double")).alias("residual")) \
             .orderBy(*order_by).limit(n)


def scatter_sample(df: DataFrame, key_cols: Sequence[str], n: int = 500, seed: int = 42) -> DataFrame:
    """ML17: n rows without replacement — the n smallest md5(seed:key)
    (a top-n, TakeOrderedAndProject: n rows per task, never the table)."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key_cols]))
    return df.withColumn("_h", h).orderBy("_h").limit(n).drop("_h")


def task_type(df: DataFrame, y: str, max_classes: int = 20) -> DataFrame:
    """ML18: classification when the true values have ≤ 20 distinct values."""
    return df.agg(F.count_distinct(y).alias("distinct_true")).withColumn(
        "task", F.when(F.col("distinct_true") <= max_classes, "classification").otherwise("regression"))


def problem_type(df: DataFrame, y: str) -> DataFrame:
    """≤ 2 distinct → binary; text → multiclass; < 20 distinct and
    < 5 % of rows → multiclass; else regression."""
    is_text = dict(df.dtypes)[y] == "string"
    a = df.agg(F.count_distinct(y).alias("k"), F.count(y).alias("n"))
    kind = (F.when(F.col("k") <= 2, "binary").when(F.lit(is_text), "multiclass")
             .when((F.col("k") < 20) & (F.col("k") < F.col("n") * 0.05), "multiclass").otherwise("regression"))
    return a.withColumn("problem_type", kind)


def multi_target_metrics(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """ML20: regression metrics per target: (target, y, ŷ) unpivoted, one
    grouped aggregate."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y"), F.col(p).cast("double").alias("yhat"))
        for t, p in pairs.items()])))
    return regression_metrics(long, "y", "yhat", by=["target"])


def residual_histogram(df: DataFrame, y: str, yhat: str, bins: int = 30) -> DataFrame:
    """ML21."""
    r = df.select((F.col(y).cast("double") - F.col(yhat).cast("double")).alias("residual"))
    return histogram(r, "residual", bins)


def best_epoch_of_rows(history: DataFrame, key: str, epoch: str, loss: str) -> DataFrame:
    """ML22 on (run, epoch, loss) rows: the epoch of the smallest loss, the first on
    ties. A partial aggregate: no run's history is gathered."""
    return history.groupBy(key).agg(F.min_by(epoch, F.struct(loss, epoch)).alias("best_epoch"),
                                    F.min(loss).alias("best_loss"))


def best_epoch(history: DataFrame, key: str, losses: str = "val_loss") -> DataFrame:
    """ML22: argmin of the validation-loss array of each run (1-based epoch)."""
    e = history.select(key, F.posexplode(losses).alias("pos", "loss"))
    return best_epoch_of_rows(e.withColumn("pos", F.col("pos") + 1), key, "pos", "loss")


def feature_importance(spark, names: Sequence[str], importances, k: int = 20) -> DataFrame:
    """ML19/K3: importances zipped with the assembler's names, top k."""
    vals = [float(x) for x in importances]
    df = spark.createDataFrame(list(zip(names, vals)), "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(k)


def simple_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept, r² and rows of the regression of y on x."""
    return df.agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"),
                  F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"),
                  F.regr_r2(F.col(y).cast("double"), F.col(x).cast("double")).alias("r2"),
                  F.regr_count(F.col(y), F.col(x)).alias("n"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact ROC AUC = P(score⁺ > score⁻) + ½·P(tie), from counts per
    distinct score. The cumulative negative count below each score comes
    from a running total over the distinct scores computed with per-range
    partial sums (no single-partition window over the data)."""
    from cirrus.sources.ingest import running_total
    s = (df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"))
           .filter(F.col("s").isNotNull() & F.col("y").isNotNull())
           .groupBy("s").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")))
    c = running_total(s, ["s"], "neg", "neg_upto")
    a = c.agg(F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg")) + F.col("pos") * F.col("neg") * 0.5).alias("num"),
              F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return a.select(F.try_divide(F.col("num"), F.col("n_pos") * F.col("n_neg")).alias("auc"))
