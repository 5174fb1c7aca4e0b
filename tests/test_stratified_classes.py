"""Stratified splits look the cuts of their classes up without moving the table by class."""

import hashlib
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cirrus.operators import split as S

SIZES = {"a": 700, "b": 40, "c": 3, "d": 1, None: 90}


def rows():
    return [(i, c) for i, c in enumerate(c for c, n in SIZES.items() for _ in range(n))]


def expected():
    """SP1 sizes in the md5 order inside each class."""
    share, out, classes = 0.15 / (0.7 + 0.15), {}, defaultdict(list)
    for k, c in rows():
        classes[c].append((hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
    for members in classes.values():
        n_test = math.ceil(len(members) * 0.15)
        n_val = math.ceil(share * (len(members) - n_test))
        for r, (_, k) in enumerate(sorted(members)):
            out[k] = "test" if r < n_test else "val" if r < n_test + n_val else "train"
    return out


@pytest.fixture
def no_automatic_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_table_is_not_moved_by_class(spark, no_automatic_broadcast):
    df = spark.createDataFrame(rows(), "k long, c string")
    out = S.stratified_split(df, "c", ["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert {r["k"]: r["split"] for r in out.collect()} == expected()


@pytest.mark.parametrize("most", [1, 2])
def test_classes_past_the_broadcast(spark, no_automatic_broadcast, monkeypatch, most):
    monkeypatch.setattr(S._class_cuts, "__defaults__", (most,))
    monkeypatch.setattr(S, "_CLASSES", most)
    # a column may bear the name of a cut
    df = spark.createDataFrame(rows(), "k long, c string").withColumn("c0", F.col("k") + 1)
    out = S.stratified_split(df, "c", ["k"])
    assert out.columns == ["k", "c", "c0", "split"]
    got = out.collect()
    assert len(got) == len(rows()) and {r["k"]: r["split"] for r in got} == expected()
    assert all(r["c0"] == r["k"] + 1 for r in got)


def test_no_rows(spark):
    assert S.stratified_split(spark.createDataFrame([], "k long, c string"), "c", ["k"]).collect() == []


def test_rows_without_a_class(spark, no_automatic_broadcast):
    """Most rows without a class: they are a class like any other, and no task's own."""
    n = 400
    df = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 4 == 0, "a").alias("c"))
    out = S.stratified_split(df, "c", ["k"])
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    sizes = {(r["c"], r["split"]): r["count"] for r in out.groupBy("c", "split").count().collect()}
    want = {}
    for c, size in (("a", 100), (None, 300)):
        test = math.ceil(size * 0.15)
        val = math.ceil(0.15 / (0.7 + 0.15) * (size - test))
        want |= {(c, "test"): test, (c, "val"): val, (c, "train"): size - test - val}
    assert sizes == want
