"""One bounded probe of all text columns."""

from pyspark.sql import functions as F

from cirrus.operators import detect as D


def test_probe_matches_each_column_alone(spark):
    df = spark.range(3000).select(
        F.col("id").alias("_row_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), (F.col("id") % 70).cast("string"))).alias("a"),
        F.lit(None).cast("string").alias("none"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("b")).repartition(6)
    got = D.probe(df, ["a", "none", "b"], first=100, top=3)
    for c in ("a", "none", "b"):
        rows = df.where(F.col(c).isNotNull()).orderBy("_row_id").select(c).collect()
        assert got[c]["first"] == [r[0] for r in rows[:100]]
        top = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(3).collect()
        assert got[c]["top"] == [r[0] for r in top]
        assert got[c]["distinct"] == df.select(c).distinct().where(F.col(c).isNotNull()).count()
    assert D.probe(df, [], first=5) == {} and D.probe(df.limit(0), ["a"], top=3)["a"] == {"first": [], "top": [], "distinct": 0}


def test_kinds_of_many_columns_take_as_many_jobs_as_of_one(spark):
    base = spark.range(200).withColumnRenamed("id", "_row_id")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("_row_id").cast("int")), "yyyy-MM-dd")
    wide = base.select("_row_id", *[e.alias(f"{n}{i}") for i in range(8) for n, e in (("day", day), ("num", F.col("_row_id").cast("string")), ("cat", (F.col("_row_id") % 4 == 0).cast("string")))])

    def jobs(cols):
        tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
        sc.setJobGroup(f"probe-{len(cols)}", "probe")
        kinds = {r["column"]: r["kind"] for r in D.column_kinds(wide, cols).collect()}
        sc.setLocalProperty("spark.jobGroup.id", None)
        return kinds, len(tracker.getJobIdsForGroup(f"probe-{len(cols)}"))

    one, n = jobs(["day0", "num0"])
    every, m = jobs([c for c in wide.columns if c != "_row_id"])
    assert set(every.values()) == {"datetime", "numeric_string", "categorical"} and one == {"day0": "datetime", "num0": "numeric_string"}
    assert m <= n + 2
