"""Fits read their source a few times, however many rounds, classes, folds or grid points they have."""

from pyspark.sql import functions as F

from cirrus.plans import train as TR

N = 120


def counted(spark):
    """Rows whose feature counts how often it is computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def feature(k):
        seen.add(1)
        return float(k % 7)

    df = spark.range(N).select("id", feature("id").alias("x"), (F.col("id") % 3).cast("double").alias("y"),
                               (F.col("id") % 2).cast("int").alias("fold"),
                               F.when(F.col("id") % 5 == 0, "val").when(F.col("id") % 5 == 1, "test").otherwise("train").alias("split"))
    return df, seen


def test_one_vs_rest(spark):
    df, seen = counted(spark)
    r = TR.train(df, ["x"], "y", "xgboost", {"n_estimators": 2, "max_depth": 2, "random_state": 1}, classification=True)
    assert seen.value <= 2 * N  # a checkpoint computes them twice; val, test and train rows
    assert r.metrics.first()["n"] == N // 5


def test_grid_search(spark):
    df, seen = counted(spark)
    m = TR.grid_search(df, ["x"], "y", {"maxDepth": [1, 2]}, folds=2, model_type="decision_tree", fold_col="fold")
    assert seen.value <= 2 * N
    assert m.bestModel.transform(df).select("prediction").count() == N
