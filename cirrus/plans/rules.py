"""Plain-Python rules that steer the operators. They read no
rows: they check specs and schemas, name methods, pick defaults.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

# Numeric and text method names with their accepted aliases (fixed values).
NUMERIC_ALIASES = {
    "min_max": "MIN_MAX", "minmax": "MIN_MAX",
    "z_score": "Z_SCORE", "standard": "Z_SCORE", "standardization": "Z_SCORE",
    "lstm_tcn": "LSTM_TCN", "cnn": "CNN",
    "transformer": "TRANSFORMER", "robust": "TRANSFORMER", "robust_scaler": "TRANSFORMER",
    "tree": "TREE", "none": "TREE", "no_normalization": "TREE",
}
TEXT_ALIASES = {
    "lower": "LOWER", "lowercase": "LOWER", "strip": "STRIP",
    "label_encoding": "LABEL_ENCODING", "label": "LABEL_ENCODING", "labelencoding": "LABEL_ENCODING",
    "one_hot": "ONE_HOT", "onehot": "ONE_HOT", "one-hot": "ONE_HOT",
}
# Recommended numeric method per model type (fixed values).
RECOMMENDED_METHOD = {
    "linear_regression": "Z_SCORE", "logistic_regression": "Z_SCORE", "svm": "Z_SCORE",
    "neural_network": "MIN_MAX", "random_forest": "TREE", "gradient_boosting": "TREE",
    "xgboost": "TREE", "decision_tree": "TREE", "lstm": "LSTM_TCN", "tcn": "LSTM_TCN",
    "cnn": "CNN", "transformer": "TRANSFORMER",
}
# Random-forest presets (fixed values): fast, balanced, precise.
RF_PRESETS = {
    "rapido": {"n_estimators": 100, "max_depth": None, "max_features": "sqrt", "min_samples_leaf": 1,
               "bootstrap": True, "random_state": 42},
    "balanceado": {"n_estimators": 300, "max_depth": None, "max_features": "auto", "min_samples_leaf": 1,
                   "bootstrap": True, "random_state": 42},
    "preciso": {"n_estimators": 1000, "max_depth": 20, "max_features": "auto", "min_samples_leaf": 2,
                "bootstrap": True, "random_state": 42},
}
CLASSIFICATION_METRICS = ["accuracy", "precision", "recall", "f1_score"]
REGRESSION_METRICS = ["mae", "mse", "rmse", "r2"]
SEQUENCE_MODELS = ("lstm", "gru", "cnn", "transformer", "tcn", "nbeats", "nhits")


def numeric_method(name: str) -> str:
    """Numeric method by name, case-insensitive; unknown → MIN_MAX."""
    return NUMERIC_ALIASES.get(name.strip().lower(), "MIN_MAX")


def text_method(name: str) -> str:
    """Text method by name, case-insensitive; unknown → LOWER."""
    return TEXT_ALIASES.get(name.strip().lower(), "LOWER")


def recommended_method(model_type: str) -> str:
    """The numeric method suggested for a model type (else MIN_MAX)."""
    return RECOMMENDED_METHOD.get(model_type.strip().lower(), "MIN_MAX")


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    """Every listed column exists."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def check_training_columns(df: DataFrame, predictors: Sequence[str], targets: Sequence[str]) -> None:
    """P10: at least one predictor and one target, no overlap, all present."""
    if not predictors:
        raise ValueError("at least one predictor column is needed")
    if not targets:
        raise ValueError("at least one target column is needed")
    both = set(predictors) & set(targets)
    if both:
        raise ValueError(f"columns both predictor and target: {sorted(both)}")
    require_columns(df, list(predictors) + list(targets))


def union_columns(a: Sequence[str], b: Sequence[str]) -> list[str]:
    """Union keeping first-seen order."""
    return list(dict.fromkeys(list(a) + list(b)))


def difference_columns(a: Sequence[str], b: Sequence[str]) -> list[str]:
    """U3."""
    drop = set(b)
    return [c for c in a if c not in drop]


def intersection_columns(a: Sequence[str], b: Sequence[str]) -> list[str]:
    """U3."""
    keep = set(b)
    return [c for c in a if c in keep]


def coarse_kind(detailed: str) -> str:
    """Detailed kind → numeric | text (booleans count as numeric, dates
    as text)."""
    d = detailed.lower()
    if d in ("numeric", "numeric_string", "bool", "boolean", "integer", "float"):
        return "numeric"
    return "text"


def conversion_warning(from_dtype: str, to: str) -> str | None:
    """The loss a conversion may cause, or None when it is safe."""
    f, t = from_dtype.lower(), to.upper()
    if ("float" in f or "double" in f) and t.startswith("TO_INT"):
        return "decimals are lost when converting to an integer"
    if f in ("int64", "bigint", "long") and t == "TO_INT32":
        return "values outside -2,147,483,648 … 2,147,483,647 become null"
    if f in ("int64", "bigint", "long", "int32", "int") and t == "TO_INT16":
        return "values outside -32,768 … 32,767 become null"
    if f in ("float64", "double") and t == "TO_FLOAT32":
        return "precision may be lost for very large or very small numbers"
    if f in ("object", "string", "text") and t == "TO_NUMERIC":
        return "values that are not numbers become null"
    return None


def chain_warnings(steps: Sequence[dict], input_kind: str) -> list[str]:
    """Warnings only — a numeric method on text (or the reverse), and a
    step after one that produces several columns."""
    out, kind = [], input_kind
    for i, st in enumerate(steps):
        m = st["method"].upper()
        is_text_method = m in TEXT_ALIASES.values()
        if is_text_method and kind == "numeric" and m in ("LOWER", "STRIP"):
            out.append(f"step {i + 1}: text method {m} on a numeric column")
        if not is_text_method and kind == "text":
            out.append(f"step {i + 1}: numeric method {m} on a text column")
        if i > 0 and steps[i - 1]["method"].upper() == "ONE_HOT" and not st.get("input_column"):
            out.append(f"step {i + 1}: follows a step that creates several columns")
        kind = "numeric" if m in ("LABEL_ENCODING", "ONE_HOT") or not is_text_method else kind
    return out


def split_method_for(model_type: str, requested: str) -> str:
    """SP10: sequence models never use a random split (temporal instead)."""
    if requested == "random" and model_type.lower() in SEQUENCE_MODELS:
        return "temporal"
    return requested


def metrics_for(problem_type: str, selected: Sequence[str] | None = None) -> list[str]:
    """ML12: the metrics asked for, else the defaults of the problem type."""
    if selected:
        return list(selected)
    return CLASSIFICATION_METRICS if problem_type == "classification" else REGRESSION_METRICS


def problem_type_of(n_distinct_true: int, declared: str = "auto") -> str:
    """ML12: declared type, or auto → classification when ≤ 20 distinct
    true values."""
    if declared != "auto":
        return declared
    return "classification" if n_distinct_true <= 20 else "regression"


def rf_preset(name: str) -> dict:
    """ML5: a random-forest preset as hyper-parameters for `train.map_params`."""
    return dict(RF_PRESETS[name])


def split_strategies() -> dict:
    """CV9 (and the split factory): strategy name → function. CV1
    "standard" means no folds."""
    from cirrus.operators import split as S
    return {
        "random": S.random_split, "stratified": S.stratified_split, "group": S.group_split,
        "temporal": S.temporal_holdout, "blocked": S.temporal_blocked, "walk_forward": S.walk_forward,
        "sequential": S.sequential_split, "standard": None, "kfold": S.kfold,
        "stratified_kfold": S.stratified_kfold, "time_series_split": S.time_series_folds,
        "leave_one_out": S.leave_one_out, "repeated_kfold": S.repeated_kfold,
        "repeated_stratified_kfold": S.repeated_kfold, "leave_one_group_out": S.leave_one_group_out,
    }
