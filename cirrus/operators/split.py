"""Train / validation / test splits (SP1–SP9) and cross-validation folds
(CV2–CV7).

Output is the input plus a `split` column ('train' | 'val' | 'test', null
for gap and remainder rows) — or a `fold` column — never six arrays.

"Random" order is the md5 of `seed:key`, a pure function of the row, so the
same split comes back on every run, on any number of partitions, and in any
engine that has md5. Exact split sizes come from the md5 values at the ranks
where one side ends (`hash_cuts`: counts per md5 bucket, then a sort of only
the buckets that hold a cut), so a row is placed by comparing its own md5 and
the table is not shuffled. Folds dealt round-robin need every rank and use
the distributed row index (H1).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrus.operators.encode import checked_join, rank_values
from cirrus.session import ensure_checkpoint_dir
from cirrus.sources.ingest import ROW_ID, with_row_id

TRAIN, VAL, TEST = "train", "val", "test"


def check_sizes(train: float, val: float, test: float) -> tuple[float, float, float]:
    """Sizes must sum to 1 ± 0.02; they are then normalised."""
    s = train + val + test
    if abs(s - 1.0) > 0.02:
        raise ValueError(f"split sizes must sum to 1 (got {s:.3f})")
    return train / s, val / s, test / s


def hash_key(seed: int, key_cols: Sequence[str]) -> Column:
    """md5 of `seed:k1:k2…` — the shuffle order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key_cols]))


#: Hexadecimal digits of the md5 that number a bucket: 65,536 buckets of even size.
_DIGITS = 4
#: Classes whose cuts are looked up by broadcast.
_CLASSES = 100_000


def hash_cuts(df: DataFrame, seed: int | Column, key_cols: Sequence[str], ranks, by: Sequence[str] = ()) -> DataFrame:
    """The md5 at given ranks of the md5 order: (by…, _n, c0, c1, …), one row per group.

    `ranks` maps the Column of the group's row count to the Columns of the ranks (0-based;
    a rank past the end gives null). Rows are counted per md5 bucket, and only the
    buckets that a rank falls in are sorted; the table itself is neither shuffled nor
    written, since a row then finds its place by comparing its own md5 with the cuts.
    The key must be unique; rows of one key fall on the same side. The counts are kept by a
    checkpoint, so the rows are read twice: to count them, and for the buckets asked for.
    """
    by = list(by)
    ensure_checkpoint_dir(df.sparkSession)
    h = hash_key(seed, key_cols) if isinstance(seed, int) else F.md5(F.concat_ws(
        ":", seed.cast("string"), *[F.col(k).cast("string") for k in key_cols]))
    rows = df.select(*by, h.alias("_h")).withColumn("_b", F.substring("_h", 1, _DIGITS))
    counts = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    # at most 65,536 rows per group
    group = Window.partitionBy(*(by or [F.lit(0)]))
    upto = F.sum("_c").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.select(*by, "_b", "_c", (upto - F.col("_c")).alias("_off"), F.sum("_c").over(group).alias("_n"))
    counts = counts.checkpoint(eager=True)
    wanted = ranks(F.col("_n"))
    need = counts.select(*by, "_b", "_off", "_c", "_n", F.posexplode(F.array(*[
        F.lit(r).cast("long") if isinstance(r, int) else r.cast("long") for r in wanted])).alias("_i", "_r"))
    inside = need.filter((F.col("_r") >= F.col("_off")) & (F.col("_r") < F.col("_off") + F.col("_c")))
    inside = inside.select(*[F.col(c).alias(f"_s_{c}") for c in [*by, "_b"]], "_i", (F.col("_r") - F.col("_off")).alias("_r"))
    on = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in [*by, "_b"]]
    asked = inside.groupBy(*[f"_s_{c}" for c in [*by, "_b"]]).agg(F.collect_list(F.struct("_i", "_r")).alias("_asked"))
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h")) - 1
    # a row for each rank and group at most; a broadcast leaves all other rows where they are
    known = len(wanted) if not by else None
    hit = (checked_join(rows, asked, on, "inner", _CLASSES, known).withColumn("_p", place)
               .select(*by, "_h", F.explode(F.filter("_asked", lambda x: x["_r"] == F.col("_p"))).alias("_a")))
    cuts = hit.groupBy(*by).agg(*[F.max(F.when(F.col("_a._i") == i, F.col("_h"))).alias(f"c{i}") for i in range(len(wanted))])
    sizes = counts.groupBy(*by).agg(F.max("_n").alias("_n"))
    if not by:
        return sizes.crossJoin(cuts)  # two one-row tables
    cuts = cuts.select(*[F.col(c).alias(f"_s_{c}") for c in by], *[f"c{i}" for i in range(len(wanted))])
    return sizes.join(cuts, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in by], "left").drop(*[f"_s_{c}" for c in by])


def _side(h: Column, cuts: Sequence[Column], names: Sequence[str]) -> Column:
    """The first name before the first cut, and so on; a null cut lies past the end."""
    out = F.when(F.coalesce(h < cuts[0], F.lit(True)), names[0])
    for cut, name in zip(cuts[1:], names[1:]):
        out = out.when(F.coalesce(h < cut, F.lit(True)), name)
    return out.otherwise(names[-1])


def _sides(df: DataFrame, seed: int, key_cols: Sequence[str], ranks, names: Sequence[str]) -> DataFrame:
    row = hash_cuts(df, seed, key_cols, ranks).first()
    cuts = [row[f"c{i}"] for i in range(len(names) - 1)] if row else [None] * (len(names) - 1)
    return df.withColumn("split", _side(hash_key(seed, key_cols), [F.lit(c).cast("string") for c in cuts], names))


def _by_thresholds(r: Column, cut1: Column | int, cut2: Column | int, first: str, second: str,
                   third: str) -> Column:
    return F.when(r < cut1, first).when(r < cut2, second).otherwise(third)


def _exact_ranks(train: float, val: float, test: float):
    """SP1 sizes: ceil(test·n) test rows first, then ceil of the val share of the rest."""
    def ranks(n: Column) -> list[Column]:
        n_test = F.ceil(n * F.lit(test))
        n_val = F.ceil(F.lit(val / (train + val)) * (n - n_test)) if val > 0 else F.lit(0)
        return [n_test, n_test + n_val]
    return ranks


def random_split(df: DataFrame, key_cols: Sequence[str], train: float = 0.7, val: float = 0.15,
                 test: float = 0.15, seed: int = 42) -> DataFrame:
    """SP1: n_test = ceil(test·n), n_val = ceil(val/(train+val)·(n−n_test)),
    the rest train (no val rows when val = 0). Test takes the first ranks of
    the md5 order, then val, then train. Null keys hash like any other."""
    train, val, test = check_sizes(train, val, test)
    return _sides(df, seed, key_cols, _exact_ranks(train, val, test), [TEST, VAL, TRAIN])


def random_split_indices(df: DataFrame, key_cols: Sequence[str], train: float = 0.7, val: float = 0.15,
                         test: float = 0.15, seed: int = 42) -> DataFrame:
    """SP2: index form — floors: [0, ⌊n·train⌋) train, then val up to
    ⌊n·(train+val)⌋, the rest test."""
    train, val, test = check_sizes(train, val, test)
    return _sides(df, seed, key_cols, lambda n: [F.floor(n * F.lit(train)), F.floor(n * F.lit(train + val))],
                  [TRAIN, VAL, TEST])


def _class_cuts(df: DataFrame, label: str, cuts: DataFrame, most: int = _CLASSES) -> DataFrame:
    """The rows of `df` with the cuts (_class, _n, _c0, _c1) of their class. The `most` largest
    classes are looked up by broadcast, so that no task sorts or holds a whole one; the
    rows of the others, each less than 1/`most` of the table, meet their cuts in a shuffle."""
    on = F.col(f"`{label}`").eqNullSafe(F.col("_class"))
    if cuts.count() <= most:
        return df.join(F.broadcast(cuts), on, "left")
    # fixed, so that rows of one class all go one way when sizes tie
    large = cuts.orderBy(F.desc("_n")).limit(most).checkpoint(eager=True)
    j = df.join(F.broadcast(large), on, "left")
    rest = j.filter(F.col("_n").isNull()).select(*[F.col(f"`{c}`") for c in df.columns])
    return j.filter(F.col("_n").isNotNull()).unionByName(rest.join(cuts, on, "left"))


def stratified_split(df: DataFrame, label: str, key_cols: Sequence[str], train: float = 0.7,
                     val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """SP3: the SP1 sizes applied inside every class, so each split keeps
    the class proportions (up to the ceilings); rows without a class are a
    class of their own."""
    train, val, test = check_sizes(train, val, test)
    ensure_checkpoint_dir(df.sparkSession)
    cuts = hash_cuts(df, seed, key_cols, _exact_ranks(train, val, test), by=[label])
    cuts = cuts.select(F.col(f"`{label}`").alias("_class"), "_n", F.col("c0").alias("_c0"), F.col("c1").alias("_c1"))
    j = _class_cuts(df, label, cuts.checkpoint(eager=True))
    side = _side(hash_key(seed, key_cols), [F.col("_c0"), F.col("_c1")], [TEST, VAL, TRAIN])
    return j.select(*[F.col(f"`{c}`") for c in df.columns], side.alias("split"))


def group_split(df: DataFrame, group: str, train: float = 0.7, val: float = 0.15, test: float = 0.15,
                seed: int = 42) -> DataFrame:
    """SP4: whole groups go to one side: groups in md5 order, the first
    ⌊G·train⌋ train, the next ⌊G·val⌋ val, the rest test."""
    train, val, test = check_sizes(train, val, test)
    groups = df.select(group).distinct().withColumn("_h", hash_key(seed, [group]))
    ranked = rank_values(groups, ["_h", group], name="_g")
    g = ranked.count()
    n_tr, n_va = int(g * train), int(g * val)
    sides = ranked.select(F.col(group).alias("_group"),
                          _by_thresholds(F.col("_g"), n_tr, n_tr + n_va, TRAIN, VAL, TEST).alias("split"))
    # rows without a group are a group too
    return checked_join(df, sides, F.col(group).eqNullSafe(F.col("_group")), "left", known_rows=g).drop("_group")


def _count(df: DataFrame) -> int:
    return df.count()


def temporal_holdout(df: DataFrame, train: float = 0.7, val: float = 0.15, test: float = 0.15, gap: int = 0,
                     row_id: str = ROW_ID, n: int | None = None) -> DataFrame:
    """SP5: T = ⌊n·train⌋, V = ⌊n·(train+val)⌋: train [0, T−g), val
    [T, V−g), test [V, n); gap rows get a null split."""
    train, val, test = check_sizes(train, val, test)
    n = n if n is not None else _count(df)
    t, v = int(n * train), int(n * (train + val))
    r = F.col(row_id)
    return df.withColumn("split", F.when(r < t - gap, TRAIN).when((r >= t) & (r < v - gap), VAL)
                         .when(r >= v, TEST))


def temporal_blocked(df: DataFrame, train: float = 0.7, val: float = 0.15, test: float = 0.15,
                     seed: int | None = 42, row_id: str = ROW_ID, n: int | None = None) -> DataFrame:
    """SP6: blocks of b = ⌊n/10⌋ rows, ⌊n/b⌋ of them, in md5 order when
    seeded; ⌊blocks·train⌋ train, ⌊blocks·val⌋ val, the rest test; the last
    n mod b rows (remainder) get a null split. n < 10 is refused."""
    train, val, test = check_sizes(train, val, test)
    n = n if n is not None else _count(df)
    if n < 10:
        raise ValueError("blocked split needs at least 10 rows")
    b = n // 10
    nb = n // b
    spark = df.sparkSession
    blocks = spark.range(nb).select(F.col("id").alias("_blk"))
    if seed is not None:
        blocks = blocks.withColumn("_h", hash_key(seed, ["_blk"]))
        blocks = rank_values(blocks, ["_h", "_blk"], name="_bo").drop("_h")
    else:
        blocks = blocks.withColumn("_bo", F.col("_blk"))
    n_tr, n_va = int(nb * train), int(nb * val)
    sides = blocks.select("_blk", _by_thresholds(F.col("_bo"), n_tr, n_tr + n_va, TRAIN, VAL, TEST).alias("split"))
    out = df.withColumn("_blk", F.floor(F.col(row_id) / F.lit(b)).cast("long"))
    # nb ≤ 19 rows: a proven size bound for the broadcast
    return out.join(F.broadcast(sides), "_blk", "left").drop("_blk")


def walk_forward(df: DataFrame, train: float = 0.7, val: float = 0.15, test: float = 0.15, n_splits: int = 5,
                 gap: int = 0, row_id: str = ROW_ID, n: int | None = None) -> DataFrame:
    """SP7: last fold of an expanding-window split: test = last ⌊n/(k+1)⌋
    rows, train+val = the rows before it minus the gap, cut by
    train/(train+val)."""
    train, val, test = check_sizes(train, val, test)
    n = n if n is not None else _count(df)
    ts = n // (n_splits + 1)
    test_start = n - ts
    tv = test_start - gap
    n_train = int(tv * (train / (train + val)))
    r = F.col(row_id)
    return df.withColumn("split", F.when(r < n_train, TRAIN).when(r < tv, VAL).when(r >= test_start, TEST))


def sequential_split(df: DataFrame, train: float = 0.7, val: float = 0.15, test: float = 0.15,
                     row_id: str = ROW_ID, n: int | None = None) -> DataFrame:
    """SP8: row order kept, floors."""
    train, val, test = check_sizes(train, val, test)
    n = n if n is not None else _count(df)
    t, v = int(n * train), int(n * (train + val))
    return df.withColumn("split", _by_thresholds(F.col(row_id), t, v, TRAIN, VAL, TEST))


def split_counts(df: DataFrame, train: float, val: float, test: float) -> DataFrame:
    """SP9: rows per split and the displayed percentages (integers, test
    adjusted so they sum to 100)."""
    tp, vp, sp = int(train * 100), int(val * 100), int(test * 100)
    if tp + vp + sp != 100:
        sp = 100 - tp - vp
    pct = F.create_map(F.lit(TRAIN), F.lit(tp), F.lit(VAL), F.lit(vp), F.lit(TEST), F.lit(sp))
    return (df.filter(F.col("split").isNotNull()).groupBy("split").agg(F.count(F.lit(1)).alias("count"))
              .withColumn("percentage", pct[F.col("split")]))


def stats_by_split(df: DataFrame, value: str) -> DataFrame:
    """Statistics of a target for all splits at once (one grouped
    aggregate)."""
    from cirrus.operators.profile import summary
    return summary(df.filter(F.col("split").isNotNull()), [value], by=["split"])


# ------------------------------------------------------------------ folds

def _kfold_of(rank: Column, n: Column | int, k: int) -> Column:
    """sklearn KFold sizes: the first n mod k folds get one more row."""
    n = F.lit(n) if isinstance(n, int) else n
    q = F.floor(n / F.lit(k))
    rem = n - q * F.lit(k)
    big = rem * (q + 1)
    return F.when(rank < big, F.floor(rank / (q + 1))).otherwise(rem + F.floor((rank - big) / q)).cast("int")


def _fold_starts(k: int):
    """First ranks of the folds 1 to k − 1 (sklearn KFold sizes)."""
    def ranks(n: Column) -> list[Column]:
        q = F.floor(n / F.lit(k))
        rem = n - q * F.lit(k)
        return [F.lit(i) * q + F.least(F.lit(i), rem) for i in range(1, k)]
    return ranks


def _fold_of(h: Column, cuts: Sequence[Column]) -> Column:
    fold = F.lit(0)
    for cut in cuts:
        fold = fold + F.coalesce((h >= cut).cast("int"), F.lit(0))
    return fold.cast("int")


def kfold(df: DataFrame, key_cols: Sequence[str], k: int = 5, seed: int = 42, shuffle: bool = True,
          row_id: str = ROW_ID) -> DataFrame:
    """CV2: `fold` column; shuffled by the md5 order or in row order."""
    if not shuffle:
        return df.withColumn("fold", _kfold_of(F.col(row_id), _count(df), k))
    row = hash_cuts(df, seed, key_cols, _fold_starts(k)).first()
    cuts = [F.lit(row[f"c{i}"]).cast("string") for i in range(k - 1)] if row else []
    return df.withColumn("fold", _fold_of(hash_key(seed, key_cols), cuts))


def stratified_kfold(df: DataFrame, label: str, key_cols: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """CV3: rows of each class (null is one) in md5 order are dealt round-robin
    over the folds, continuing across classes, so every fold gets ⌊n_c/k⌋ or
    ⌈n_c/k⌉ rows of class c and fold sizes differ by at most one."""
    ranked = with_row_id(df.withColumn("_h", hash_key(seed, key_cols)), [label, "_h", *key_cols], name="_rank")
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_h")


def repeated_kfold(df: DataFrame, key_cols: Sequence[str], k: int = 5, repeats: int = 10, seed: int = 42,
                   label: str | None = None) -> DataFrame:
    """CV6 (CV7 with `label`): K-fold repeated with seeds seed+r; one row per
    (row, repeat)."""
    rep = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    of = F.lit(seed) + F.col("repeat")
    h = F.md5(F.concat_ws(":", of.cast("string"), *[F.col(c).cast("string") for c in key_cols]))
    if label is None:
        cuts = hash_cuts(rep, of, key_cols, _fold_starts(k), by=["repeat"]).drop("_n")
        j = rep.join(F.broadcast(cuts), "repeat")  # one row per repeat
        return j.withColumn("fold", _fold_of(h, [F.col(f"c{i}") for i in range(k - 1)])).drop(
            *[f"c{i}" for i in range(k - 1)])
    ranked = with_row_id(rep.withColumn("_h", h), ["repeat", label, "_h", *key_cols], name="_rank")
    starts = ranked.groupBy("repeat").agg(F.min("_rank").alias("_s"))
    j = ranked.join(F.broadcast(starts), "repeat")  # one row per repeat
    return j.withColumn("fold", ((F.col("_rank") - F.col("_s")) % k).cast("int")).drop("_rank", "_s", "_h")


def time_series_folds(df: DataFrame, k: int = 5, gap: int = 0, test_size: int | None = None,
                      max_train_size: int | None = None, row_id: str = ROW_ID,
                      n: int | None = None) -> DataFrame:
    """CV4: expanding-window folds; one row per (row, fold, role). The k
    fold bounds are literals; each row lists its folds with a higher-order
    `filter` over `sequence(0, k-1)` and is exploded — no join."""
    n = n if n is not None else _count(df)
    ts = test_size or n // (k + 1)
    bounds = []
    for i in range(k):
        t0 = n - (k - i) * ts
        tr_end = t0 - gap
        tr_start = max(0, tr_end - max_train_size) if max_train_size else 0
        bounds.append((tr_start, tr_end, t0, t0 + ts))
    arr = [F.array(*[F.lit(b[j]) for b in bounds]) for j in range(4)]
    r = F.col(row_id)

    def inside(i, lo, hi):
        return (r >= F.get(arr[lo], i)) & (r < F.get(arr[hi], i))

    member = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: inside(i, 0, 1) | inside(i, 2, 3))
    out = df.withColumn("fold", F.explode(member))
    return out.withColumn("role", F.when(r < F.get(arr[1], F.col("fold")), TRAIN).otherwise(TEST))


def leave_one_out(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """CV5: every row is its own fold."""
    return df.withColumn("fold", F.col(row_id))


def train_val_union(df: DataFrame) -> DataFrame:
    """The rows used for cross-validation (train ∪ val)."""
    return df.filter(F.col("split").isin(TRAIN, VAL))


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """Every group is one fold; fold number = rank of the group in
    sorted order (the group table is ranked, then joined back)."""
    groups = df.select(group).filter(F.col(group).isNotNull()).distinct()
    ranked = rank_values(groups, [group], name="fold")
    g = ranked.count()
    return checked_join(df, ranked.withColumn("fold", F.col("fold").cast("int")), [group], "left", known_rows=g)
