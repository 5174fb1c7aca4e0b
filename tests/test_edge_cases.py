"""Hand-computed edge cases (FIXTURES.md §3) and properties."""

import math

import pytest
from pyspark.sql import functions as F

from cirrus.functions import convert as C
from cirrus.functions import numeric as M
from cirrus.functions import replace as RP
from cirrus.functions import text as T
from cirrus.operators import encode as E
from cirrus.operators import evaluate as EV
from cirrus.operators import lookups as L
from cirrus.operators import normalize as Z
from cirrus.operators import nulls as N
from cirrus.operators import profile as A
from cirrus.operators import sequences as W
from cirrus.operators import split as S
from cirrus.sources import sinks as SK
from cirrus.sources.ingest import clean, running_total, with_row_id


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_fills_edge_rules(spark):
    df = spark.createDataFrame([(0, None), (1, 1.0), (2, None), (3, None), (4, 4.0), (5, None)], "i long, v double")
    out = N.fills(df, "v", ["i"], runs=2).orderBy("i")
    assert rows(out, "ffill") == [(None,), (1.0,), (1.0,), (1.0,), (4.0,), (4.0,)]
    assert rows(out, "bfill") == [(1.0,), (1.0,), (4.0,), (4.0,), (4.0,), (None,)]
    assert rows(out, "interpolated") == [(None,), (1.0,), (2.0,), (3.0,), (4.0,), (4.0,)]


def test_fills_same_for_any_block_size(spark):
    df = spark.range(200).select(F.col("id").alias("i"), (F.col("id") % 5).alias("k"),
                                 F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).alias("v"))
    a = N.fills(df, "v", ["i"], keys=["k"], runs=7).orderBy("i").collect()
    b = N.fills(df, "v", ["i"], keys=["k"], runs=1).orderBy("i").collect()
    assert a == b


def test_constant_column_normalizers(spark):
    df = spark.createDataFrame([(7.0,)] * 5, "x double")
    for method, want in [("MIN_MAX", 0.0), ("Z_SCORE", 0.0), ("LSTM_TCN", -1.0), ("TRANSFORMER", 0.0)]:
        m = Z.fit(df, ["x"], method)
        assert {r[0] for r in m.transform(df).collect()} == {want}
    c = A.correlation_matrix(spark.createDataFrame([(7.0, 1.0), (7.0, 2.0), (7.0, 3.0)], "a double, b double"))
    assert c.filter("var1 = 'a' and var2 = 'b'").first()["r"] is None


def test_all_null_normalizer_unchanged(spark):
    df = spark.createDataFrame([(None,), (None,), (None,)], "x double")
    for method in ["MIN_MAX", "Z_SCORE", "TRANSFORMER"]:
        assert all(r[0] is None for r in Z.fit(df, ["x"], method).transform(df).collect())


def test_inverse_transform_identity(spark):
    df = spark.range(50).select((F.col("id") * 1.7 - 3).alias("x"))
    for method in ["MIN_MAX", "Z_SCORE", "LSTM_TCN", "TRANSFORMER"]:
        m = Z.fit(df, ["x"], method)
        back = df.select("x", m.inverse_expr("x", m.expr("x")).alias("y")).collect()
        assert all(abs(r.x - r.y) < 1e-9 for r in back)


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), ("c",)], "s string")
    assert N.column_mode(df, "s") == "a"


def test_half_even_round_and_int(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-2.5,), (2.675,)], "x double")
    assert rows(df.select(M.round_even("x", 0).alias("r")), "r")[:4] == [(0.0,), (2.0,), (2.0,), (-2.0,)]
    assert df.select(M.round_even("x", 2).alias("r")).collect()[4][0] == round(2.675, 2)
    assert rows(df.select(C.to_int("x", "TO_INT16").alias("r")), "r")[:4] == [(0,), (2,), (2,), (-2,)]


def test_truncate_negative_decimals(spark):
    df = spark.createDataFrame([(-15.0,), (-1.239,)], "x double")
    assert df.select(M.truncate_decimals("x", -1)).first()[0] == -20.0
    assert df.select(M.truncate_decimals("x", 2)).collect()[1][0] == -1.23


def test_overflow_to_null_and_counted(spark):
    df = spark.createDataFrame([(40000.0,), (1.0,)], "x double")
    assert rows(df.select(C.to_int("x", "TO_INT16")), "*") == [(None,), (1,)]
    rep = C.conversion_report(df, {"x": "TO_INT16"}).first()
    assert rep["lost"] == 1


def test_text_ops(spark):
    df = spark.createDataFrame([("\t a \n",), ("",), (None,), ("o'neil foo-bar",), ("abcdef",)], "s string")
    got = df.select(T.title("s").alias("t"), T.trim_ws("s").alias("w"), T.split_part("s", "-", -1).alias("p"),
                    T.pad("s", 3, "0").alias("d")).collect()
    assert got[3]["t"] == "o'neil foo-bar".title()
    assert got[0]["w"] == "a"
    assert got[3]["p"] == "bar"
    assert got[1]["p"] == ""
    assert got[2]["t"] is None and got[2]["w"] is None
    assert got[4]["d"] == "abcdef" and got[1]["d"] == "000"


def test_date_formats(spark):
    df = spark.createDataFrame([("31/12/2020",), ("2020-13-01",), ("2020-01-02 03:04:05",)], "s string")
    got = [r[0] for r in df.select(C.parse_datetime("s")).collect()]
    assert str(got[0]).startswith("2020-12-31") and got[1] is None and str(got[2]) == "2020-01-02 03:04:05"


@pytest.mark.parametrize("n", [10, 19, 99, 100, 105])
def test_split_sizes(spark, n):
    df = with_row_id(spark.range(n).withColumnRenamed("id", "k"), ["k"])
    r = S.random_split(df, ["k"], 0.7, 0.15, 0.15, seed=7)
    c = {x["split"]: x["count"] for x in r.groupBy("split").count().collect()}
    n_test = math.ceil(0.15 * n)
    n_val = math.ceil(0.15 / 0.85 * (n - n_test))
    assert c.get("test", 0) == n_test and c.get("val", 0) == n_val and sum(c.values()) == n
    b = S.temporal_blocked(df, seed=42)
    blocks = n // (n // 10)
    covered = b.filter(F.col("split").isNotNull()).count()
    assert covered == blocks * (n // 10)
    f = S.kfold(df, ["k"], 5, seed=1)
    sizes = sorted(x["count"] for x in f.groupBy("fold").count().collect())
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n


def test_group_split_keeps_groups_whole(spark):
    df = spark.createDataFrame([(i, g) for g, size in enumerate([1, 2, 3, 5, 8, 13, 21]) for i in range(size)],
                               "i long, g long")
    out = S.group_split(df, "g", 0.6, 0.2, 0.2, seed=3)
    per = out.groupBy("g").agg(F.count_distinct("split").alias("k")).collect()
    assert all(r["k"] == 1 for r in per)


def test_row_id_independent_of_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    a = with_row_id(df, ["k"], num_partitions=1).orderBy("_row_id").collect()
    b = with_row_id(df, ["k"], num_partitions=8).orderBy("_row_id").collect()
    assert a == b and [r["_row_id"] for r in a] == list(range(1000))


def test_running_total(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    out = running_total(df, ["k"], "v").orderBy("k").collect()
    assert [r["running_total"] for r in out] == list(range(1, 101))


def test_unseen_categories(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "c string, y double")
    test = spark.createDataFrame([("a", 0.0), ("z", 0.0)], "c string, y double")
    oh = E.one_hot(test, "c", cats=E.categories(train, "c"), drop_first=True).collect()
    assert [r["c_b"] for r in oh] == [0, 0]
    m = E.label_mapping(train, "c")
    assert [r["c"] for r in E.label_encode(test, "c", mapping=m, unknown=-1).collect()] == [0, -1]
    te = E.TargetEncoder("c", "y").fit(train)
    assert sorted(r["c"] for r in te.transform(test).collect()) == [1.0, 2.0]


def test_lineage_with_cycle(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None), (5, 6), (6, 5)], "id long, parent_id long")
    out = {r["id"]: (r["root"], r["depth"]) for r in L.lineage(nodes).collect()}
    assert out[3] == (1, 2) and out[1] == (1, 0) and out[4] == (4, 0)
    assert out[5][0] is None and out[6][0] is None
    lists = {r["id"]: r["ancestors"] for r in L.ancestors(nodes).collect()}
    assert lists == {1: [], 2: ["1"], 3: ["1", "2"], 4: [], 5: None, 6: None}


def test_lineage_of_a_long_chain(spark):
    n = 200
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)] + [(500, 999)], "id long, parent_id long")
    out = {r["id"]: (r["root"], r["depth"]) for r in L.lineage(nodes).collect()}
    assert all(out[i] == (0, i) for i in range(n))
    assert out[500] == (999, 1)  # a parent that is not there is the root


def test_large_numbers_keep_their_value(spark):
    df = spark.createDataFrame([(1e20,), (-1e20,), (4503599627370497.0,), (-2.5,)], "x double")
    rows = df.select(M.floor("x"), M.ceil("x"), M.truncate_decimals("x", 2), M.truncate_decimals("x", -1)).collect()
    assert [tuple(r)[:3] for r in rows[:3]] == [(x,) * 3 for x in (1e20, -1e20, 4503599627370497.0)]
    assert tuple(rows[3]) == (-3.0, -2.0, -2.5, -10.0)
    assert rows[0][3] == 1e20


def test_splits_keep_rows_without_class_or_group(spark):
    from cirrus.operators import split as S
    df = spark.range(100).select("id", F.when(F.col("id") % 4 != 0, F.col("id") % 3).alias("c"))
    assert S.stratified_split(df, "c", ["id"]).filter("split is not null").count() == 100
    assert S.stratified_kfold(df, "c", ["id"], 5).groupBy("fold").count().filter("count = 20").count() == 5
    assert S.group_split(df, "c").filter("split is not null").count() == 100
    empty = df.limit(0)
    for out in (S.random_split(empty, ["id"]), S.kfold(empty, ["id"]), S.stratified_split(empty, "c", ["id"])):
        assert out.count() == 0
    few = S.kfold(df.limit(3), ["id"], 5)
    assert sorted(r["fold"] for r in few.collect()) == [0, 1, 2]


def test_metrics_of_mixed_label_types(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (2, 2.0)], "y int, p double")
    assert EV.classification_metrics(df, "y", "p").first()["accuracy"] == 1.0
    names = {r["true"]: r["true_label"] for r in EV.confusion_matrix(df, "p", "p", with_names=True).collect()}
    assert names == {"0.0": "Clear", "1.0": "Partly Cloudy", "2.0": "Mostly Cloudy"}


def test_error_examples_and_text_fields(spark):
    from cirrus.functions import udf as U
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    def odd(v):
        if v % 2:
            raise ValueError("odd")
        return {"half": v // 2, "name": f"n{v}"}

    df = spark.createDataFrame([(i % 12,) for i in range(60)] + [(None,)], "v int")
    out = U.apply_dict_function(df, "v", odd, StructType([StructField("half", LongType()), StructField("name", StringType())]))
    rows = {r["v"]: r for r in out.collect()}
    assert (rows[3]["half"], rows[3]["name"]) == (None, "") and (rows[4]["half"], rows[4]["name"]) == (2, "n4")
    e = U.error_summary(out, "_error", "v").first()
    assert (e["count"], e["examples"]) == (30, ["1", "11", "3", "5", "7"])


def test_hyper_parameters_are_mapped_or_refused():
    from cirrus.plans import train as TRN
    assert TRN.map_params("random_forest", {"max_depth": None, "min_samples_split": 2}, True) == {"maxDepth": 30}
    for bad in ({"max_depth": 31}, {"min_samples_split": 5}, {"max_leaf_nodes": 7}, {"unheard": 1}):
        with pytest.raises(ValueError):
            TRN.map_params("random_forest", bad, True)
    with pytest.raises(ValueError):
        TRN.map_params("decision_tree", {"max_features": "sqrt"}, True)


def test_cyclic_names():
    names = ["hour", "day_of_week", "day_of_month", "month", "wind_angle", "wind_bearing", "price"]
    assert [E.cyclic_period_by_name(n) for n in names] == [24, 7, 12, 12, None, 360, None]
    assert [E.is_cyclic_name(n) for n in names] == [True] * 6 + [False]


def test_ordinal_preprocessing(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0)], "c string, x double")
    m = E.fit_preprocessing(df, ["c", "x"], scale=None, categorical=["c"], encoding_method="ordinal")
    new = spark.createDataFrame([("b", 1.0), ("z", 1.0)], "c string, x double")
    assert [r["c"] for r in m.transform(new).collect()] == [1, -1]


def test_link_runs(spark):
    runs = spark.createDataFrame([(1, "rf", "h1"), (2, "dt", "h1"), (3, "gb", "h2")], "run long, t string, h string")
    defs = spark.createDataFrame([(10, "rf", "h9"), (20, "dt", "h2"), (21, "dt", "h1")], "d long, t string, h string")
    got = {r["run"]: r["linked_definition"] for r in L.link_runs(runs, defs, ["t"], "run", "d", "h").collect()}
    assert got == {1: 10, 2: 21, 3: None}


def test_nan_inf(spark):
    df = clean(spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double"))
    assert [r[0] for r in df.collect()] == [None, float("inf"), 1.0]
    assert [r[0] for r in SK.json_safe(df).collect()] == [None, None, 1.0]


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    h = A.histogram(df, "x", 10).orderBy("bin").collect()
    assert [r["count"] for r in h] == [1] * 9 + [2]


def test_sequences_halo(spark):
    df = spark.range(30).select(F.col("id").alias("i"), F.col("id").cast("double").alias("v"))
    s = W.training_sequences(df, ["v"], "v", 4, ["i"], runs=5).orderBy("i").collect()
    assert len(s) == 26 and s[0]["sequence"] == [0.0, 1.0, 2.0, 3.0] and s[0]["i"] == 4


def test_replace_modes(spark):
    df = spark.createDataFrame([(0, "abcdef"), (1, "xyz")], "_row_id long, s string")
    a = RP.replace_values(df, "s", [0], "charByChar", "XY", positions=[0, 2, 4]).orderBy("_row_id").collect()
    assert a[0]["s"] == "XbYdf" and a[1]["s"] == "xyz"
    b = RP.replace_values(df, "s", [0], "complete", "NEW", positions=[2, 3]).orderBy("_row_id").collect()
    assert b[0]["s"] == "abNEWef"


def test_classification_metrics_zero_division(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    m = EV.classification_metrics(df, "y", "p").first()
    assert abs(m["accuracy"] - 0.5) < 1e-12
    assert abs(m["precision"] - (2 * 1.0 + 1 * (1 / 3) + 1 * 0.0) / 4) < 1e-12


def test_quantiles_equal_percentile(spark):
    from cirrus.operators.quantiles import quantile_table
    hot = F.when(F.col("id") % 3 == 0, 7.0)  # one value in a third of the rows
    df = spark.range(2000).select((F.col("id") % 7).alias("g"),
                                  hot.otherwise((F.col("id") * 7919) % 1013 / 3.0).alias("x"),
                                  F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id") * 1.5).alias("y"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    p = F.array(*[F.lit(x) for x in probs])
    for by in (["g"], []):
        want = df.groupBy(*by).agg(F.percentile("x", p).alias("x"), F.percentile("y", p).alias("y")).collect()
        want = {(*[r[c] for c in by], c): r[c] for r in want for c in ("x", "y")}
        got = {(*[r[c] for c in by], r["column"]): r["quantiles"] for r in quantile_table(df, ["x", "y"], probs, by).collect()}
        assert got.keys() == want.keys()
        for k in got:
            assert all(abs(u - v) < 1e-9 for u, v in zip(got[k], want[k]))
    one = spark.createDataFrame([(1, 5.0)], "g int, x double")
    assert quantile_table(one, ["x"], [0.25, 0.5]).first()["quantiles"] == [5.0, 5.0]
    assert quantile_table(one.limit(0), ["x"], [0.5]).count() == 0


def test_ensemble_votes(spark):
    from cirrus.operators import ensemble as EN
    df = spark.createDataFrame([([0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.2, 0.5, 0.3])],
                               "m1 array<double>, m2 array<double>, m3 array<double>")
    arrs = [F.col("m1"), F.col("m2"), F.col("m3")]
    meta = EN.meta_features(arrs, 3)
    r = df.select(EN.hard_vote(arrs, 3).alias("h"), EN.soft_vote(arrs).alias("s"),
                  EN.weighted_vote(arrs, [0.8, 0.1, 0.1]).alias("w"), EN.confidence_vote(arrs).alias("c"),
                  EN.cascade_vote(arrs, 0.75).alias("k"), meta["agreement"].alias("a"),
                  meta["entropy"].alias("e")).first()
    assert (r.h, r.s, r.w, r.c, r.k) == (1, 1, 0, 1, 1)
    assert abs(r.a - 2 / 3) < 1e-12
    mean = [1.0 / 3, 0.5, 0.5 / 3]
    assert abs(r.e - -sum(p * math.log(p) for p in mean)) < 1e-12


def test_quantiles_null_group_key(spark):
    from cirrus.operators.quantiles import quantile_table
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", 4.0), ("a", 6.0)], "g string, x double")
    got = {r["g"]: r["quantiles"] for r in quantile_table(df, ["x"], [0.5], ["g"]).collect()}
    assert got == {None: [2.0], "a": [4.0]}


def test_summary_with_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, x double")
    rows = {r["g"]: (r["count"], r["median"]) for r in A.summary(df, ["x"], by=["g"]).collect()}
    assert rows == {None: (2, 2.0), "a": (1, 2.0)}


def test_filter_pushdown_and_pruning(spark):
    from cirrus.operators import filters as FL
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    q = FL.prediction_log_filter(df, "ts", "event_type", "value", "2024-01-05", "2024-01-20", "purchase").select("event_id")
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        q.explain("formatted")
    plan = buf.getvalue()
    pushed = [ln for ln in plan.splitlines() if "PushedFilters" in ln][0]
    schema = [ln for ln in plan.splitlines() if "ReadSchema" in ln][0]
    assert "GreaterThanOrEqual(ts" in pushed and "EqualTo(event_type,purchase)" in pushed
    assert "props" not in schema and "value" not in schema


def test_unique_mapping_multi_step(spark):
    from cirrus.plans import chain as CH
    df = spark.createDataFrame([(float(i),) for i in [1, 2, 2, 3, 10]], "x double")
    m = {r["original"]: r["normalized"] for r in CH.unique_mapping(df, "x", ["MIN_MAX", "Z_SCORE"]).collect()}
    mm = [(v - 1) / 9 for v in [1, 2, 2, 3, 10]]
    mu = sum(mm) / 5
    sd = (sum((v - mu) ** 2 for v in mm) / 5) ** 0.5
    assert abs(m[10.0] - (1.0 - mu) / sd) < 1e-12 and len(m) == 4


def test_fills_with_hot_key(spark):
    # one key holds a third of the rows; small blocks split it over many groups
    df = spark.range(3000).select(F.col("id").alias("i"),
                                  F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"),
                                  F.when(F.col("id") % 4 == 0, F.col("id").cast("double")).alias("v"))
    small = N.fills(df, "v", ["i"], keys=["k"], runs=64).orderBy("i").collect()
    big = N.fills(df, "v", ["i"], keys=["k"], runs=1).orderBy("i").collect()
    assert small == big
    # brute force for the hot key
    hot = [r for r in small if r["k"] == 0]
    last = None
    for r in hot:
        last = r["v"] if r["v"] is not None else last
        assert r["ffill"] == last


def test_rules():
    from cirrus.plans import rules as RU
    assert RU.numeric_method("Standard") == "Z_SCORE" and RU.numeric_method("???") == "MIN_MAX"
    assert RU.text_method("one-hot") == "ONE_HOT" and RU.text_method("x") == "LOWER"
    assert RU.recommended_method("xgboost") == "TREE"
    assert RU.split_method_for("lstm", "random") == "temporal"
    assert RU.metrics_for("classification") == ["accuracy", "precision", "recall", "f1_score"]
    assert RU.problem_type_of(20) == "classification" and RU.problem_type_of(21) == "regression"
    assert RU.rf_preset("preciso")["n_estimators"] == 1000
    assert RU.conversion_warning("float64", "TO_INT16") is not None
    assert RU.chain_warnings([{"method": "ONE_HOT"}, {"method": "MIN_MAX"}], "text")
    assert RU.union_columns(["a", "b"], ["b", "c"]) == ["a", "b", "c"]


def test_rf_preset_maps_to_mllib():
    from cirrus.plans import rules as RU
    from cirrus.plans import train as TRN
    p = TRN.map_params("random_forest", RU.rf_preset("preciso"), classification=True)
    assert p == {"numTrees": 1000, "maxDepth": 20, "featureSubsetStrategy": "sqrt", "minInstancesPerNode": 2,
                 "bootstrap": True, "seed": 42}
