"""Saved pipelines (S10), sparse one-hot vectors and early stopping (ML3) on small tables."""

import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from cirrus.operators import encode as E
from cirrus.operators import stages as ST
from cirrus.plans import train as TR


def cities(spark, n=400):
    k = F.col("id")
    return spark.range(n).select(
        k, F.concat(F.lit("c"), (k % 7).cast("string")).alias("city"), (k % 12 + 1).alias("month"),
        (k * 37 % 101).cast("double").alias("x"),
        F.when(k % 7 < 3, "low").when(k % 7 < 5, "mid").otherwise("top").alias("level"),
        F.when(k % 4 == 0, "test").when(k % 4 == 1, "val").otherwise("train").alias("split"))


@pytest.mark.parametrize("method", ["onehot", "sparse", "ordinal"])
def test_a_loaded_pipeline_scores_raw_rows_in_another_session(spark, tmp_path, method):
    df = cities(spark)
    prep = E.fit_preprocessing(df, ["city", "month", "x"], scale="standard", categorical=["city"], encoding_method=method)
    r = TR.train(df, [], "level", "decision_tree", {"max_depth": 6}, preparation=prep)
    path, rows, out = (str(tmp_path / n) for n in ("model", "rows", "out"))
    TR.save_model(r.pipeline, path)
    raw = df.drop("level", "split").unionByName(spark.createDataFrame([(1000, "new city", 3, 5.0), (1001, None, 3, 5.0)], "id long, city string, month long, x double"))
    raw.write.parquet(rows)
    want = sorted((x["id"], x["prediction"], x["prediction_label"]) for x in r.pipeline.transform(raw).collect())
    assert {x[2] for x in want} == {"low", "mid", "top"}
    code = f"""
        import sys; sys.path.insert(0, {sys.path[0]!r})
        from cirrus.session import get_spark
        from cirrus.plans.train import load_model
        s = get_spark("local[2]", 2)
        load_model({path!r}).transform(s.read.parquet({rows!r})).select("id", "prediction", "prediction_label").write.parquet({out!r})
        s.stop()"""
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, capture_output=True, timeout=300)
    assert sorted(tuple(x) for x in spark.read.parquet(out).collect()) == want
    assert ST.feature_list(TR.load_model(path).stages) == prep.feature_columns


def test_fitted_stages_keep_their_numbers_bit_for_bit(spark, tmp_path):
    from cirrus.operators import normalize as N
    df = spark.createDataFrame([(0.1, 3.0), (1 / 3, None), (2e-310, 5.0)], "a double, b double")
    model = N.fit(df, ["a", "b"], {"a": "Z_SCORE", "b": "TRANSFORMER"})
    path = str(tmp_path / "scale")
    ST.Scale.of(model).write().overwrite().save(path)
    assert ST.Scale.load(path).model().params == model.params
    encoder = E.TargetEncoder("c", "y").fit(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 9.0)], "c string, y double"))
    ST.Means.of(encoder).write().overwrite().save(path + "2")
    got = ST.Means.load(path + "2").transform(spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")).collect()
    assert [r["c"] for r in got] == [1.5, 9.0, 5.25, 5.25] or sorted(r["c"] for r in got) == [1.5, 5.25, 5.25, 9.0]


def test_sparse_one_hot_of_many_categories(spark):
    """A million categories: the vector is as wide, a row holds one place, and the driver no names."""
    n = 1_000_000
    df = spark.range(n).select("id", F.concat(F.lit("v"), F.format_string("%07d", (F.col("id") * 7919) % n)).alias("c"))
    v = F.unwrap_udt("c_onehot")
    out = E.one_hot_vector(df, "c").select("id", v["size"].alias("size"), v["indices"].alias("i"))
    got = out.agg(F.count("*"), F.min("size"), F.max("size"), F.count_if(F.col("i")[0] == (F.col("id") * 7919) % n)).first()
    assert tuple(got) == (n, n, n, n)
    with pytest.raises(ValueError, match="one_hot_vector"):
        E.one_hot(df, "c")


def test_sparse_one_hot_edge_cases(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "zz")], "id int, c string")
    codes = E.label_mapping(df.where("id < 3"), "c")
    for drop, want in ((False, {1: [1], 2: [0], 3: [], 4: []}), (True, {1: [0], 2: [], 3: [], 4: []})):
        out = E.one_hot_vector(df, "c", codes, drop_first=drop)
        assert {r["id"]: sorted(int(i) for i in r["c_onehot"].indices) for r in out.collect()} == want
    assert E.one_hot_vector(df.where("id = 3"), "c").first()["c_onehot"].toArray().tolist() == [0.0]
    assert E.one_hot_vector(df.limit(0), "c").count() == 0
    numeric = spark.createDataFrame([(1, 5), (2, 3), (3, 5)], "id int, k int")
    assert {r["id"]: int(r["k_onehot"].indices[0]) for r in E.one_hot_vector(numeric, "k").collect()} == {1: 1, 2: 0, 3: 1}


def test_stopping_round_waits_for_its_patience():
    losses = [5.0, 4.0, 4.5, 4.2, 3.0, 3.5, 3.4, 3.3, 1.0]
    assert [TR.stopping_round(losses, r) for r in (1, 2, 3, 4, 5)] == [2, 2, 5, 9, 9]
    assert TR.stopping_round([2.0, 2.0, 2.0], 1) == 1 and TR.stopping_round([1.0], 9) == 1


def test_a_cut_model_is_the_model_of_fewer_rounds(spark):
    df = cities(spark).withColumn("city", (F.col("id") % 7).cast("double"))
    for target, kind in (("x", False), ("flag", True)):
        data = df.withColumn("flag", (F.col("x") + 3 * F.col("city") > 50).cast("double"))
        fit = lambda n: TR.train(data, ["city", "month"], target, "xgboost", {"n_estimators": n, "max_depth": 2, "random_state": 3}, classification=kind, early_stopping=False)
        long, short = fit(8).model.stages[-1], fit(3).model
        cut = TR.first_rounds(long, 3)
        assert cut.getNumTrees == 3 and cut.numFeatures == 2
        rows = short.stages[0].transform(data)
        a, b = ([r["prediction"] for r in m.transform(rows).orderBy("id").collect()] for m in (cut, short.stages[-1]))
        assert a == b


def test_early_stopping_of_several_classes(spark):
    df = cities(spark, 600).withColumn("noise", F.pmod(F.xxhash64("id"), F.lit(3)).cast("double"))
    params = {"n_estimators": 12, "max_depth": 3, "random_state": 3, "early_stopping_rounds": 2}
    df = df.withColumn("y", F.when(F.col("noise") == 0, F.col("noise")).otherwise(F.col("id") % 3))
    r = TR.train(df, ["month", "x"], "y", "xgboost", params, classification=True)
    off = TR.train(df, ["month", "x"], "y", "xgboost", {**params, "early_stopping_enabled": False}, classification=True)
    assert {m.getNumTrees for m in off.model.stages[-1].models} == {12}
    val = off.model.stages[0].transform(df.where("split = 'val'"))
    for i, (m, full) in enumerate(zip(r.model.stages[-1].models, off.model.stages[-1].models)):
        own = val.withColumn(full.getLabelCol(), (F.col("y") == i).cast("double"))
        assert m.getNumTrees == TR.stopping_round(list(full.evaluateEachIteration(own)), 2)
    assert min(m.getNumTrees for m in r.model.stages[-1].models) < 12
    with pytest.raises(ValueError, match="one round"):
        TR.train(df, ["month"], "y", "xgboost", {"early_stopping_rounds": 0}, classification=True)
