"""Encoders (Z7, Z8, Z20–Z26) and the text normalisers of the chain (T12,
T13 as methods).

Category tables (value → code, value → mean) are built by Spark from the
data. They are joined back with a broadcast only after their row count has
been checked against a bound; above it the join is a shuffle join.
One-hot encoding as columns has a column for each category, so the schema, in the
driver, grows with them: up to MAX_COLUMNS, beyond which it refuses. `one_hot_vector`
keeps the categories as a table and writes one sparse vector column, whatever their
number; `one_hot_long` gives (key, category) rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cirrus.functions import text as T
from cirrus.sources.held import hold
from cirrus.sources.ingest import with_row_id

BROADCAST_MAX_ROWS = 1_000_000
#: Most columns that one-hot encoding makes of a column.
MAX_COLUMNS = 10_000


def checked_join(big: DataFrame, small: DataFrame, on, how: str = "left",
                 max_rows: int = BROADCAST_MAX_ROWS, known_rows: int | None = None) -> DataFrame:
    """Join with a broadcast of `small` only when its row count is proven
    below `max_rows`; otherwise leave the strategy to the planner (shuffle
    join, AQE may still convert at run time on measured sizes)."""
    n = known_rows if known_rows is not None else small.count()
    return big.join(F.broadcast(small) if n <= max_rows else small, on, how)


def rank_values(values: DataFrame, order_by: Sequence[str], name: str = "code") -> DataFrame:
    """0-based rank of each row of a table of distinct values in `order_by`
    order, by the distributed row index (H1)."""
    return with_row_id(values, order_by, name=name)


def label_mapping(df: DataFrame, c: str, name: str = "code") -> DataFrame:
    """Z7 fit: sorted distinct non-null values with their code."""
    return rank_values(df.select(c).filter(F.col(c).isNotNull()).distinct(), [c], name)


def label_encode(df: DataFrame, c: str, mapping: DataFrame | None = None, unknown: int | None = None,
                 out: str | None = None) -> DataFrame:
    """Replace a text column by its code; null stays null; a value
    absent from the mapping gets `unknown` (Z21: −1)."""
    if not isinstance(df.schema[c].dataType, StringType):
        return df
    mapping = mapping if mapping is not None else label_mapping(df, c)
    m = mapping.select(F.col(c).alias("_k"), F.col("code").alias("_code"))
    j = checked_join(df, m, F.col(c) == F.col("_k"), "left")
    code = F.col("_code")
    if unknown is not None:
        code = F.when(F.col(c).isNotNull(), F.coalesce(code, F.lit(unknown)).cast("long"))
    target = out or c
    cols = [code.alias(target) if x == target else F.col(x) for x in df.columns]
    if target not in df.columns:
        cols.append(code.alias(target))
    return j.select(*cols)


def categories(df: DataFrame, c: str) -> list:
    """Sorted distinct non-null values: the names of the one-hot columns. More than
    MAX_COLUMNS raise, and no more of them come to the driver."""
    got = df.select(c).filter(F.col(c).isNotNull()).distinct().limit(MAX_COLUMNS + 1).collect()
    if len(got) > MAX_COLUMNS:
        raise ValueError(f"{c!r} has more than {MAX_COLUMNS} categories for columns; use one_hot_vector")
    return sorted(r[0] for r in got)


def one_hot_long(df: DataFrame, c: str, key_cols: Sequence[str]) -> DataFrame:
    """Z8 as rows: (key…, category) where the 0/1 column of the category is 1;
    any number of categories, nothing in the driver."""
    return df.filter(F.col(c).isNotNull()).select(*key_cols, F.col(c).alias("category"))


def one_hot(df: DataFrame, c: str, cats: Sequence | None = None, drop_first: bool = False,
            keep_original: bool = False) -> DataFrame:
    """Z8 (and Z20 with `drop_first`): `<col>_<value>` 0/1 long columns,
    null or unknown value → all 0; the new columns are appended next to the
    others (U4, side-by-side concat)."""
    if not isinstance(df.schema[c].dataType, StringType) and cats is None:
        return df
    cats = list(cats) if cats is not None else categories(df, c)
    use = cats[1:] if drop_first else cats
    new = {f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("long"), F.lit(0).cast("long"))
           for v in use}
    out = df.withColumns(new)
    return out if keep_original else out.drop(c)


def sparse_vector(index: Column, size: int) -> Column:
    """A sparse ML vector of `size` with 1 at `index`; all 0 where that is null. Built in
    the JVM: the vector type is read from the JSON of its parts."""
    one = index.isNotNull()
    parts = F.struct(F.struct(
        F.lit(0).alias("type"), F.lit(size).alias("size"),
        F.when(one, F.array(index.cast("int"))).otherwise(F.array().cast("array<int>")).alias("indices"),
        F.when(one, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("values")).alias("v"))
    return F.from_json(F.to_json(parts), StructType([StructField("v", VectorUDT())]))["v"]


def one_hot_vector(df: DataFrame, c: str, codes: DataFrame | None = None, size: int | None = None, out: str | None = None,
                   drop_first: bool = False) -> DataFrame:
    """Z8 (Z20 with `drop_first`) for any number of categories: column `c` becomes the sparse
    vector `<c>_onehot` over the sorted categories, which lie in the table `codes`
    (see `label_mapping`) and are joined. Null or unknown → all 0."""
    codes = codes if codes is not None else label_mapping(df, c)
    size = size if size is not None else codes.count()
    first = int(drop_first)
    out = out or f"{c}_onehot"
    m = codes.select(F.col(codes.columns[0]).alias("_k"), F.col("code").alias("_code"))
    # the table grows with the data; the planner picks the join by its size
    j = df.join(m, F.col(c) == F.col("_k"), "left")
    index = F.when(F.col("_code") >= first, F.col("_code") - first)
    width = max(1, size - first)
    vector = sparse_vector(index, width).alias(out, metadata={"ml_attr": {"num_attrs": width}})
    return j.select(*[F.col(f"`{x}`") for x in df.columns if x not in (c, out)], vector)


@dataclass
class TargetEncoder:
    """Category → mean of the target; unseen → mean of the means."""
    column: str
    target: str
    means: DataFrame | None = None
    default: float | None = None
    n_categories: int = 0

    def fit(self, df: DataFrame) -> "TargetEncoder":
        self.means = (df.filter(F.col(self.column).isNotNull())
                        .groupBy(self.column).agg(F.avg(F.col(self.target).cast("double")).alias("_te")))
        row = self.means.agg(F.avg("_te").alias("d"), F.count(F.lit(1)).alias("n")).first()
        self.default, self.n_categories = row["d"], row["n"]
        return self

    def transform(self, df: DataFrame, out: str | None = None) -> DataFrame:
        m = self.means.select(F.col(self.column).alias("_k"), "_te")
        j = checked_join(df, m, F.col(self.column) == F.col("_k"), "left",
                         known_rows=self.n_categories)
        enc = F.coalesce(F.col("_te"), F.lit(self.default))
        target = out or self.column
        cols = [enc.alias(target) if x == target else F.col(x) for x in df.columns]
        if target not in df.columns:
            cols.append(enc.alias(target))
        return j.select(*cols)


# Name parts of cyclic columns, and the periods that all parts of a row give (fixed values).
CYCLIC_NAMES = ["hour", "day", "month", "bearing", "degree", "angle"]
CYCLIC_PERIODS = [(["hour"], 24), (["day", "week"], 7), (["month"], 12), (["bearing"], 360), (["degree"], 360)]


def is_cyclic_name(name: str) -> bool:
    """Whether a column is cyclic by its name."""
    return any(part in name.lower() for part in CYCLIC_NAMES)


def cyclic_period_by_name(name: str) -> int | None:
    """Period from the column name; None where the data give it."""
    n = name.lower()
    return next((p for parts, p in CYCLIC_PERIODS if all(x in n for x in parts)), None)


def cyclic(df: DataFrame, c: str, period: float, drop: bool = True) -> DataFrame:
    """`<col>_sin`, `<col>_cos` = sin/cos(2π·x/period). The period is
    a fitted value, frozen for later data."""
    x = F.col(c).cast("double")
    out = df.withColumns({f"{c}_sin": F.sin(F.lit(2 * math.pi) * x / F.lit(float(period))),
                          f"{c}_cos": F.cos(F.lit(2 * math.pi) * x / F.lit(float(period)))})
    return out.drop(c) if drop else out


def fit_cyclic_period(df: DataFrame, c: str, mode: str = "max") -> float:
    """Z23 period when the name gives none: `max+1` (pipelines) or
    `max-min+1` (the feature helper)."""
    p = cyclic_period_by_name(c)
    if p:
        return float(p)
    r = df.agg(F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi")).first()
    return float(r["hi"] + 1) if mode == "max" else float(r["hi"] - r["lo"] + 1)


@dataclass
class PreprocessingModel:
    """Cyclic → one-hot → column alignment → scaling, fitted once."""
    cyclic_periods: dict[str, float] = field(default_factory=dict)
    one_hot_cats: dict[str, list] = field(default_factory=dict)
    vectors: dict[str, tuple[DataFrame, int, str]] = field(default_factory=dict)  # codes, their number, output
    ordinal: dict[str, DataFrame] = field(default_factory=dict)
    feature_columns: list[str] = field(default_factory=list)
    scaler: object | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        from cirrus.operators.stages import preparation_stages
        for stage in preparation_stages(self):
            df = stage.transform(df)
        return df


def fit_preprocessing(df: DataFrame, features: Sequence[str], scale: str | None = "standard",
                      categorical: Sequence[str] | None = None, encoding_method: str = "onehot",
                      cyclic_cols: Sequence[str] | None = None) -> PreprocessingModel:
    """Categorical columns are text columns or numeric columns with
    fewer than 10 distinct values (D8); cyclic ones are found by name (D7).
    `encoding_method` is the caller's: "onehot" (first level dropped, unknown
    → all 0), "sparse" (the same as one sparse vector column for each, for any number
    of categories) or "ordinal" (unknown → −1). Vectors are not scaled."""
    if encoding_method not in ("onehot", "sparse", "ordinal"):
        raise ValueError(f"unknown encoding method: {encoding_method}")
    from cirrus.operators import normalize as N
    features = list(features)
    if cyclic_cols is None:
        cyclic_cols = [c for c in features if is_cyclic_name(c)]
    if categorical is None:
        texts = [c for c in features if isinstance(df.schema[c].dataType, StringType)]
        others = [c for c in features if c not in texts and c not in cyclic_cols]
        if others:
            d = df.agg(*[F.count_distinct(c).alias(c) for c in others]).first()
            categorical = texts + [c for c in others if d[c] < 10]
        else:
            categorical = texts
    model = PreprocessingModel()
    for c in cyclic_cols:
        model.cyclic_periods[c] = fit_cyclic_period(df, c, "max")
    for c in categorical:
        if c in cyclic_cols:
            continue
        if encoding_method == "onehot":
            model.one_hot_cats[c] = categories(df, c)
        elif encoding_method == "sparse":
            codes = hold(label_mapping(df, c), "codes")
            model.vectors[c] = (codes, codes.count(), f"{c}_onehot")
        else:
            model.ordinal[c] = label_mapping(df, c)
    feats = []
    for c in features:
        if c in model.cyclic_periods:
            feats += [f"{c}_sin", f"{c}_cos"]
        elif c in model.one_hot_cats:
            feats += [f"{c}_{v}" for v in model.one_hot_cats[c][1:]]
        elif c in model.vectors:
            feats.append(model.vectors[c][2])
        else:
            feats.append(c)
    model.feature_columns = feats
    if scale and scale != "none":
        staged = model.transform(df)
        model.scaler = N.fit(staged, [c for c in feats if not isinstance(staged.schema[c].dataType, VectorUDT)], scale)
    return model


def apply_text_method(df: DataFrame, cols: Sequence[str], method: str) -> DataFrame:
    """Text normalisers: LOWER (T12), STRIP (T13), LABEL_ENCODING (Z7),
    ONE_HOT (Z8)."""
    m = method.upper()
    out = df
    for c in cols:
        if m == "LOWER":
            out = out.withColumn(c, F.lower(c))
        elif m == "STRIP":
            out = out.withColumn(c, T.trim_ws(c))
        elif m == "LABEL_ENCODING":
            out = label_encode(out, c)
        elif m == "ONE_HOT":
            out = one_hot(out, c)
        else:
            raise ValueError(f"unknown text normalisation method: {method}")
    return out


def decode_labels(df: DataFrame, c: str, mapping: DataFrame, out: str | None = None) -> DataFrame:
    """Code → original label by a join on the fitted mapping."""
    m = mapping.select(F.col("code").alias("_code"), F.col(mapping.columns[0]).alias("_label"))
    j = checked_join(df, m, F.col(c).cast("long") == F.col("_code"), "left")
    return j.withColumn(out or f"{c}_label", F.col("_label")).drop("_code", "_label")
