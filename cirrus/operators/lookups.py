"""Lookups, run and prediction logs.

Run logs, definitions and prediction logs are ordinary DataFrames; every
operator is a join, a grouped aggregate or a top-k, never a loop over
collected rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrus.functions.convert import season
from cirrus.sources.held import hold

# City grid and seasonal base temperatures (fixed values).
CITIES = [
    ("Madrid", 40.4168, -3.7038, "ES"), ("Barcelona", 41.3851, 2.1734, "ES"),
    ("Valencia", 39.4699, -0.3763, "ES"), ("Sevilla", 37.3891, -5.9845, "ES"),
    ("Bilbao", 43.2630, -2.9350, "ES"), ("Paris", 48.8566, 2.3522, "FR"),
    ("Lyon", 45.7640, 4.8357, "FR"), ("Marseille", 43.2965, 5.3698, "FR"),
    ("Toulouse", 43.6047, 1.4442, "FR"), ("Bordeaux", 44.8378, -0.5792, "FR"),
]
SEASONAL_BASE = [
    ("ES", "winter", 12.0), ("ES", "spring", 18.0), ("ES", "summer", 28.0), ("ES", "autumn", 20.0),
    ("FR", "winter", 8.0), ("FR", "spring", 15.0), ("FR", "summer", 25.0), ("FR", "autumn", 16.0),
]


def success_rate(runs: DataFrame, model: str = "model_name", status: str = "status") -> DataFrame:
    """% of completed runs per model, 1 decimal."""
    from cirrus.functions.numeric import round_even
    return runs.groupBy(model).agg(
        round_even(F.avg((F.col(status) == "completed").cast("double")) * 100.0, 1).alias("success_rate"))


def best_score(runs: DataFrame, model: str = "model_name", status: str = "status",
               problem: str = "problem_type", results: str = "test_results") -> DataFrame:
    """Best score per model over completed runs: accuracy (else
    f1_score) for classification, r2 otherwise."""
    m = F.col(results)
    s = F.when(F.col(problem) == "classification",
               F.coalesce(F.try_element_at(m, F.lit("accuracy")), F.try_element_at(m, F.lit("f1_score")))) \
         .otherwise(F.try_element_at(m, F.lit("r2")))
    return runs.filter(F.col(status) == "completed").groupBy(model).agg(F.max(s).alias("best_score"))


def prediction_summary(preds: DataFrame, model: str = "model_name", accuracy: str = "accuracy",
                       location: str | None = "location", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Average accuracy, total, best model by average accuracy,
    distinct locations (name, else "lat,lon")."""
    loc = F.coalesce(F.col(location), F.concat_ws(",", F.col(lat).cast("string"), F.col(lon).cast("string"))) \
        if location else F.concat_ws(",", F.col(lat).cast("string"), F.col(lon).cast("string"))
    totals = preds.agg(F.avg(accuracy).alias("avg_accuracy"), F.count(F.lit(1)).alias("total"),
                       F.count_distinct(loc).alias("locations"))
    per_model = preds.groupBy(model).agg(F.avg(accuracy).alias("_a"))
    best = per_model.agg(F.max_by(model, F.struct("_a", F.col(model))).alias("best_model"))
    return totals.crossJoin(best)  # two one-row tables


def daily_accuracy(preds: DataFrame, models: Sequence[str], ts: str = "created_at", model: str = "model_name",
                   accuracy: str = "accuracy", days: int = 7) -> DataFrame:
    """Average accuracy per day × model for the last `days` days
    present (null where a model has no prediction that day). The model list
    is given, so `pivot` needs no extra pass."""
    day = F.to_date(F.col(ts)).alias("day")
    p = preds.groupBy(day).pivot(model, list(models)).agg(F.avg(accuracy))
    last = preds.select(F.to_date(F.col(ts)).alias("day")).distinct().orderBy(F.desc("day")).limit(days)
    return p.join(F.broadcast(last), "day")  # ≤ days rows


def owner_counts(owner: str, **tables: DataFrame) -> DataFrame:
    """Per owner, the row count of each table (full outer join of
    grouped counts; owners missing from a table count 0)."""
    out = None
    for name, t in tables.items():
        c = t.groupBy(owner).agg(F.count(F.lit(1)).alias(name))
        out = c if out is None else out.join(c, owner, "full")
    return out.na.fill(0, list(tables))


def latest(df: DataFrame, ts: str, n: int = 5, key: str | None = None) -> DataFrame:
    """K4: the n newest rows (top-n, TakeOrderedAndProject)."""
    order = [F.desc(ts)] + ([F.desc(key)] if key else [])
    return df.orderBy(*order).limit(n)


def latest_per_group(df: DataFrame, group: str, ts: str, cols: Sequence[str]) -> DataFrame:
    """K5: the newest row of each group (`max_by` on a struct: a hash
    aggregate with map-side partial results, no window over a hot group)."""
    s = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col(ts), *[F.col(c) for c in cols]))
    return df.groupBy(group).agg(s.alias("_l")).select(group, "_l.*")


def by_day_newest_first(df: DataFrame, ts: str) -> DataFrame:
    """K7: rows grouped by calendar day, newest day first."""
    return df.withColumn("day", F.to_date(ts)).orderBy(F.desc("day"), F.desc(ts))


def link_runs(runs: DataFrame, definitions: DataFrame, keys: Sequence[str], run_id: str, def_id: str,
              hyper: str) -> DataFrame:
    """Link runs without a definition to a definition with the same keys:
    a unique match wins; among several, the first (smallest id) with equal
    hyper-parameters; otherwise the run stays unlinked (null).

    Definitions are first reduced to one row per key (count, smallest id)
    and one row per (key, hyper-parameters) (smallest id); runs join those
    summaries, so a key shared by many runs and many definitions never
    produces run × definition pairs."""
    per_key = definitions.groupBy(*keys).agg(F.count(def_id).alias("_n"), F.min(def_id).alias("_any"))
    per_hyper = definitions.groupBy(*keys, hyper).agg(F.min(def_id).alias("_eq"))
    r = runs.select(run_id, *keys, hyper)
    on_k = [r[k].eqNullSafe(per_key[k]) for k in keys]
    j = r.join(per_key, on_k, "left").select(r[run_id], *[r[k] for k in keys], r[hyper], "_n", "_any")
    on_h = [j[k].eqNullSafe(per_hyper[k]) for k in keys] + [j[hyper] == per_hyper[hyper]]
    j = j.join(per_hyper, on_h, "left").select(j[run_id], "_n", "_any", "_eq")
    return j.select(run_id, F.when(F.col("_n") == 1, F.col("_any")).otherwise(F.col("_eq"))
                    .alias("linked_definition"))


def fallback_predictions(days: DataFrame, day: str = "day") -> DataFrame:
    """Every (city, day) with the seasonal base temperature of the city's
    country (unknown country → ES). Cities and seasons are two fixed tables
    of 10 and 8 rows (broadcast); the days come from the data."""
    cities = F.array(*[F.struct(F.lit(r).alias("region"), F.lit(la).alias("latitude"), F.lit(lo).alias("longitude"),
                                F.lit(c).alias("country")) for r, la, lo, c in CITIES])
    base = F.create_map(*[x for c, s, t in SEASONAL_BASE for x in (F.lit(f"{c}:{s}"), F.lit(t))])
    grid = days.select(day).distinct().select(day, F.inline(cities))  # 10 rows per day, no join
    grid = grid.withColumn("season", season(F.col(day)))
    c = F.when(F.col("country").isin("ES", "FR"), F.col("country")).otherwise("ES")
    return grid.withColumn("base_temp", base[F.concat_ws(":", c, F.col("season"))])


def merge_missing(stored: DataFrame, fresh: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keep stored rows; add only the fresh rows whose key is missing
    (left-anti join), then J9: one row per key."""
    missing = fresh.join(stored.select(*key), list(key), "left_anti")
    return stored.unionByName(missing, allowMissingColumns=True).dropDuplicates(list(key))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).count().filter(F.col("count") > 1)


def label_domain(*frames_and_cols: tuple[DataFrame, str]) -> DataFrame:
    """The union of label domains."""
    out = None
    for df, c in frames_and_cols:
        x = df.select(F.col(c).cast("string").alias("label"))
        out = x if out is None else out.union(x)
    return out.distinct()


#: Rows that point at one row before it is looked up by broadcast, and the most rows looked up so.
HOT_ROWS, HOT_KEYS = 10_000, 1000


def _jump(nodes: DataFrame, id_col: str, parent_col: str, with_list: bool) -> tuple[DataFrame, DataFrame]:
    """Pointer jumping over a frontier: (settled, open), both (id, anc, depth, list).

    Every open row points at an ancestor. A step looks that ancestor up: if it is settled
    (or a parent without a row) the row is settled too and set aside, otherwise it takes over
    the ancestor's pointer, so pointers span 2^s parents after s steps and the frontier
    shrinks from step to step. Only the ancestors that the frontier points at are joined, and
    those that many rows point at, HOT_KEYS at most, are looked up by broadcast, so a
    star has no hot task. What is open after log2(rows) steps is on, or leads to, a cycle."""
    parent = F.col(parent_col)
    none = F.expr("array()").cast("array<string>")
    start = hold(nodes.select(F.col(id_col).alias("id"), parent.alias("anc"), parent.isNotNull().cast("int").alias("depth"),
                              F.when(parent.isNull() | F.lit(not with_list), none).otherwise(F.array(parent.cast("string"))).alias("list")), "nodes")
    settled = [start.where("anc is null").withColumn("anc", F.col("id"))]
    front = start.where("anc is not null")
    n = left = front.count()
    while n and left:
        done = settled[0]
        for more in settled[1:]:
            done = done.unionByName(more)
        known = done.withColumn("_done", F.lit(True)).unionByName(front.withColumn("_done", F.lit(False)))
        known = known.select(F.col("id").alias("_id"), F.col("anc").alias("_anc"), F.col("depth").alias("_depth"), F.col("list").alias("_list"), "_done")
        target = known.join(front.select(F.col("anc").alias("_want")).distinct(), F.col("_id") == F.col("_want"), "left_semi")
        if n > HOT_ROWS:
            target = hold(target, "targets")
            hot = front.groupBy("anc").count().where(F.col("count") > max(HOT_ROWS, n // HOT_KEYS)).select(F.col("anc").alias("_hot"))
            hot = hold(hot.join(target, F.col("_hot") == F.col("_id"), "left"), "hot")  # HOT_KEYS rows at most
            marked = front.join(F.broadcast(hot), F.col("anc") == F.col("_hot"), "left")
            looked = marked.where("_hot is not null").drop("_hot").unionByName(
                marked.where("_hot is null").select(*front.columns).join(target, F.col("anc") == F.col("_id"), "left"))
        else:
            looked = front.join(target, F.col("anc") == F.col("_id"), "left")
        moved = F.col("_id").isNotNull()
        step = hold(looked.select(
            "id", F.coalesce("_anc", "anc").alias("anc"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            F.when(moved & F.lit(with_list), F.concat("_list", "list")).otherwise(F.col("list")).alias("list"),
            F.coalesce("_done", F.lit(True)).alias("_done")), "step")
        settled.append(step.where("_done").drop("_done"))
        front = step.where("not _done").drop("_done")
        n, left = front.count(), left // 2
    for more in settled[1:]:
        settled[0] = settled[0].unionByName(more)
    return settled[0], front


def lineage(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """Root and depth of every node of a parent-pointer forest, however deep.
    Nodes on a cycle, or below one, get a null root and depth."""
    done, rest = _jump(nodes, id_col, parent_col, with_list=False)
    rows = done.select("id", F.col("anc").alias("root"), "depth")
    return rows.unionByName(rest.select("id", F.lit(None).cast(rows.schema["root"].dataType).alias("root"), F.lit(None).cast("int").alias("depth")))


def ancestors(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """The ancestors of every node as texts, the oldest first; null on or below a cycle."""
    done, rest = _jump(nodes, id_col, parent_col, with_list=True)
    rows = done.select("id", F.col("list").alias("ancestors"))
    return rows.unionByName(rest.select("id", F.lit(None).cast("array<string>").alias("ancestors")))
