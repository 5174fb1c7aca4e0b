"""Sequence windows: the number of runs, each a task's, grows with the rows."""

from pyspark.sql import functions as F

from cirrus.operators import sequences as W


def test_more_runs_for_more_rows(spark, monkeypatch):
    n, past, horizon = 4000, 3, 70
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 7 % 101).cast("double").alias("v"))
    h = W.horizon_windows(df, "v", past, horizon, ["k"], runs=2)
    assert h.rdd.getNumPartitions() <= 2
    monkeypatch.setattr(W, "RUN_ROWS", 500, raising=False)
    h = W.horizon_windows(df, "v", past, horizon, ["k"], runs=2)
    # runs shorter than a frame are joined to the next
    assert 4 <= h.rdd.getNumPartitions() <= n // 500
    v = [float(i * 7 % 101) for i in range(n)]
    got = {r["k"]: (r["past"], r["future"]) for r in h.collect()}
    assert got == {i: (v[i - past:i], v[i:i + horizon]) for i in range(past, n - horizon + 1)}
