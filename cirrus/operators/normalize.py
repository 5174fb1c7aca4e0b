"""Numeric normalisers (Z1–Z6, Z9, Z17–Z19): fit → transform → inverse.

Z1 MIN_MAX [0, 1], Z2 Z_SCORE (population std), Z3 LSTM_TCN [−1, 1],
Z4 CNN (= Z_SCORE), Z5 TRANSFORMER (median / IQR), Z6 TREE (identity).

`fit` runs ONE aggregate over all columns and keeps a few floats per column
(the only action); `transform` and `inverse` are plain column expressions
with those floats as literals, so they fuse into whole-stage codegen and can
be applied to any DataFrame (fit on the train split, apply to all splits).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrus.functions.common import col, numeric_columns

# Method names of the reference (fixed values).
MIN_MAX = "MIN_MAX"
Z_SCORE = "Z_SCORE"
LSTM_TCN = "LSTM_TCN"
CNN = "CNN"
TRANSFORMER = "TRANSFORMER"
TREE = "TREE"
NUMERIC_METHODS = (MIN_MAX, Z_SCORE, LSTM_TCN, CNN, TRANSFORMER, TREE)

# Training scalers (Z17) map onto the same statistics.
SCALER_ALIASES = {"min_max": MIN_MAX, "minmax": MIN_MAX, "standard": Z_SCORE,
                  "robust": TRANSFORMER, "none": TREE}


def canonical(method: str) -> str:
    m = method.strip()
    if m.lower() in SCALER_ALIASES:
        return SCALER_ALIASES[m.lower()]
    m = m.upper()
    if m not in NUMERIC_METHODS:
        raise ValueError(f"unknown numeric normalisation method: {method}")
    return m


def _stat_aggs(c: str, method: str, i: int, exact: bool) -> list[Column]:
    x = F.col(c).cast("double")
    if method in (MIN_MAX, LSTM_TCN):
        return [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    if method in (Z_SCORE, CNN):
        return [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"b{i}")]
    return []  # TRANSFORMER quartiles come from quantiles.quantile_table


@dataclass
class ScalerModel:
    """Fitted statistics: column → (method, offset, scale). The transform is
    (x − offset) / scale, then mapped to [−1, 1] for LSTM_TCN."""
    params: dict[str, tuple[str, float | None, float | None]] = field(default_factory=dict)

    def expr(self, c: str, source: Column | None = None) -> Column:
        method, off, scale = self.params[c]
        x = (source if source is not None else F.col(c)).cast("double")
        if method == TREE or off is None:
            return x
        y = (x - F.lit(off)) / F.lit(scale)
        if method == LSTM_TCN:
            y = y * F.lit(2.0) - F.lit(1.0)
        return y

    def inverse_expr(self, c: str, source: Column | None = None) -> Column:
        """Undo the transform of column c."""
        method, off, scale = self.params[c]
        y = (source if source is not None else F.col(c)).cast("double")
        if method == TREE or off is None:
            return y
        if method == LSTM_TCN:
            y = (y + F.lit(1.0)) / F.lit(2.0)
        return y * F.lit(scale) + F.lit(off)

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """In place (suffix '') or as new `<col><suffix>` columns."""
        if not suffix:
            return df.withColumns({c: self.expr(c) for c in self.params if c in df.columns})
        return df.withColumns({f"{c}{suffix}": self.expr(c) for c in self.params if c in df.columns})

    def inverse(self, df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
        return df.withColumns({c: self.inverse_expr(c) for c in (cols or self.params) if c in df.columns})

    def stats_frame(self, spark) -> DataFrame:
        """The fitted statistics as a small DataFrame (to save with a model)."""
        rows = [(c, m, o, s) for c, (m, o, s) in self.params.items()]
        return spark.createDataFrame(rows, "column string, method string, offset double, scale double")


def fit(df: DataFrame, cols: Sequence[str] | None = None, method: str | dict = MIN_MAX,
        exact: bool = True) -> ScalerModel:
    """Fit one method (or a column → method dict) on `df` in a single pass."""
    cols = list(cols) if cols else numeric_columns(df)
    methods = {c: canonical(method[c] if isinstance(method, dict) else method) for c in cols}
    aggs = [a for i, c in enumerate(cols) for a in _stat_aggs(c, methods[c], i, exact)]
    row = df.agg(*aggs).first() if aggs else None
    robust = [c for c in cols if methods[c] == TRANSFORMER]
    quart = {}
    if robust:
        from cirrus.operators.quantiles import quantile_table
        qt = quantile_table(df, robust, [0.25, 0.5, 0.75], method="exact" if exact else "approx")
        quart = {r["column"]: r["quantiles"] for r in qt.collect()}  # one row per column
    params = {}
    for i, c in enumerate(cols):
        m = methods[c]
        if m in (MIN_MAX, LSTM_TCN):
            lo, hi = row[f"a{i}"], row[f"b{i}"]
            params[c] = (m, lo, (hi - lo) if lo is not None and hi != lo else 1.0)
        elif m in (Z_SCORE, CNN):
            mu, sd = row[f"a{i}"], row[f"b{i}"]
            params[c] = (m, mu, sd if sd not in (None, 0.0) else 1.0)
        elif m == TRANSFORMER:
            q = quart.get(c)
            if q is None:
                params[c] = (m, None, None)
            else:
                iqr = q[2] - q[0]
                params[c] = (m, q[1], iqr if iqr != 0 else 1.0)
        else:
            params[c] = (m, None, None)
    return ScalerModel(params)


def normalize(df: DataFrame, cols: Sequence[str] | None = None, method: str = MIN_MAX,
              fit_on: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """Fit on `fit_on` (default: df) and transform df."""
    cols = list(cols) if cols else numeric_columns(df)
    return fit(fit_on if fit_on is not None else df, cols, method).transform(df, suffix)


def fit_on_split(df: DataFrame, cols: Sequence[str], method: str, split_col: str = "split",
                 fit_split: str | None = "train") -> ScalerModel:
    """Fit on the train rows only; Z18: `fit_split=None` fits on all rows."""
    src = df if fit_split is None else df.filter(F.col(split_col) == fit_split)
    return fit(src, cols, method)


def normalize_table(df: DataFrame, numeric_method: str = MIN_MAX, text_method: str = "LOWER") -> DataFrame:
    """One numeric and one text method applied to every column of a
    table — one aggregate for all numeric statistics and one `select`."""
    from cirrus.operators import encode
    num = numeric_columns(df)
    out = fit(df, num, numeric_method).transform(df) if num else df
    return encode.apply_text_method(out, [f.name for f in df.schema.fields if f.name not in num
                                           and f.dataType.simpleString() == "string"], text_method)


def stats_frame(df: DataFrame, cols: Sequence[str], method: str, exact: bool = True) -> DataFrame:
    """Lazy fit: the statistics of `method` for `cols` as a ONE-row
    DataFrame (no action), to be applied with `apply_stats` inside the same
    plan — a single job instead of fit-then-transform."""
    m = canonical(method)
    if m == TRANSFORMER:
        from cirrus.operators.quantiles import quantile_table
        qt = quantile_table(df, cols, [0.25, 0.5, 0.75], method="exact" if exact else "approx")
        return qt.agg(*[F.max(F.when(F.col("column") == c, F.col("quantiles"))).alias(f"q{i}")
                        for i, c in enumerate(cols)])  # one row per column → one row
    aggs = [a for i, c in enumerate(cols) for a in _stat_aggs(c, m, i, exact)]
    return df.agg(*aggs)


def apply_stats(df: DataFrame, stats: DataFrame, cols: Sequence[str], method: str, suffix: str = "") -> DataFrame:
    """Transform with a one-row statistics frame (broadcast: one row)."""
    m = canonical(method)
    j = df.crossJoin(F.broadcast(stats))
    out = {}
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        if m in (MIN_MAX, LSTM_TCN):
            rng = F.col(f"b{i}") - F.col(f"a{i}")
            y = (x - F.col(f"a{i}")) / F.when(rng != 0, rng).otherwise(F.lit(1.0))
            y = y * 2.0 - 1.0 if m == LSTM_TCN else y
        elif m in (Z_SCORE, CNN):
            sd = F.col(f"b{i}")
            y = (x - F.col(f"a{i}")) / F.when(sd != 0, sd).otherwise(F.lit(1.0))
        elif m == TRANSFORMER:
            q = F.col(f"q{i}")
            iqr = q[2] - q[0]
            y = (x - q[1]) / F.when(iqr != 0, iqr).otherwise(F.lit(1.0))
        else:
            y = x
        out[f"{c}{suffix}"] = y
    return j.withColumns(out).drop(*stats.columns)
