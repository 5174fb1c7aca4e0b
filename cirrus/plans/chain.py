"""Per-column normalisation chains.

A spec maps a column to one method, or to an ordered list of steps:

    {"l_quantity": [{"method": "MIN_MAX"},
                    {"method": "Z_SCORE", "keep_original": True,
                     "conversion": "TO_FLOAT32"}],
     "p_brand": "LABEL_ENCODING"}

Naming: a single step writes in place (`keep_original` → `<col>_normalized`
added instead); a chain of n steps writes `<col>_step1 … <col>_stepN`.
A step reads the previous step's output unless it names an `input_column`.
A step's `conversion` is applied to the input of the next step (Z14);
`output_conversions` convert the final columns (Z15).

Retention (P11): the last output is kept; inputs of steps marked
`keep_original` are kept; the original column and intermediates consumed by
a later step are dropped; outputs nobody consumed are kept.

All columns' n-th steps are fitted by one aggregate; everything else is a lazy
projection, so a spec costs one small job per level of its longest chain.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cirrus.functions import convert as C
from cirrus.functions.common import is_numeric_type
from cirrus.operators import encode as E
from cirrus.operators import normalize as Z

TEXT_METHODS = ("LOWER", "STRIP", "LABEL_ENCODING", "ONE_HOT")


@dataclass
class StepInfo:
    index: int
    input: str
    outputs: list[str]
    keep_original: bool


@dataclass
class ChainResult:
    frame: DataFrame
    steps: dict[str, list[StepInfo]] = field(default_factory=dict)


def _steps(spec) -> list[dict]:
    """A method name, one step dict, {"layers": [...]} or a list of either."""
    if isinstance(spec, str):
        return [{"method": spec}]
    if isinstance(spec, dict):
        if "layers" in spec:
            return _steps(list(spec["layers"]))
        return [spec]
    return [{"method": st} if isinstance(st, str) else st for st in spec]


def _apply_method(df: DataFrame, src: str, out: str, method: str,
                  model: Z.ScalerModel | None = None) -> tuple[DataFrame, list[str]]:
    m = method.upper()
    is_text = isinstance(df.schema[src].dataType, StringType)
    if m in TEXT_METHODS:
        if m == "ONE_HOT":
            tmp = df.withColumn(out, F.col(src)) if out != src else df
            cats = E.categories(tmp, out)
            res = E.one_hot(tmp, out, cats=cats, keep_original=(out == src))
            return res, [f"{out}_{v}" for v in cats]
        if m == "LABEL_ENCODING":
            if not is_text:
                return df.withColumn(out, F.col(src)), [out]
            return E.label_encode(df, src, out=out), [out]
        return E.apply_text_method(df.withColumn(out, F.col(src)), [out], m), [out]
    if is_text:
        raise ValueError(f"numeric method {method} on text column {src}")
    return df.withColumn(out, model.expr(src)), [out]


def _converted(df: DataFrame, c: str, step: dict) -> DataFrame:
    if not step.get("conversion"):
        return df
    is_num = is_numeric_type(df.schema[c].dataType)
    return df.withColumn(c, C.convert(c, step["conversion"], is_num, **(step.get("conversion_params") or {})))


def run_chain(df: DataFrame, config: dict, output_conversions: dict | None = None) -> ChainResult:
    """Execute the spec; returns the frame and, per column, what each step
    read and wrote. Columns advance together: the statistics of all columns'
    n-th steps are one aggregate. Where a step reads a named column, that may
    be another chain's output, so the columns then go one after another."""
    names = list(config)
    alone = any(st.get("input_column") for c in names for st in _steps(config[c]))
    out = df
    info: dict[str, list[StepInfo]] = {}
    for batch in ([[c] for c in names] if alone else [names]):
        out = _run_columns(out, {c: _steps(config[c]) for c in batch}, info)
    if output_conversions:
        out = apply_output_conversions(out, output_conversions)
    return ChainResult(out, info)


def _run_columns(df: DataFrame, specs: dict[str, list[dict]], info: dict[str, list[StepInfo]]) -> DataFrame:
    out, current = df, {c: c for c in specs}
    for c in specs:
        info[c] = []
    for i in range(max(map(len, specs.values()))):
        level = {c: steps[i] for c, steps in specs.items() if i < len(steps)}
        for c, step in level.items():
            if step.get("input_column"):
                if step["input_column"] not in out.columns:
                    raise ValueError(f"input column {step['input_column']!r} not found for step {i + 1}")
                current[c] = step["input_column"]
            if i:
                out = _converted(out, current[c], specs[c][i - 1])
        numeric = {current[c]: step["method"] for c, step in level.items()
                   if step["method"].upper() not in TEXT_METHODS
                   and not isinstance(out.schema[current[c]].dataType, StringType)}
        model = Z.fit(out, list(numeric), numeric) if numeric else None
        for c, step in level.items():
            keep = bool(step.get("keep_original", False))
            target = f"{c}_step{i + 1}" if len(specs[c]) > 1 else f"{c}_normalized" if keep else c
            out, outputs = _apply_method(out, current[c], target, step["method"], model)
            info[c].append(StepInfo(i, current[c], outputs, keep))
            current[c] = outputs[0]
    for c, steps in specs.items():
        out = _retain(_converted(out, current[c], steps[-1]), c, info[c])
    return out


def _retain(df: DataFrame, column: str, infos: list[StepInfo]) -> DataFrame:
    """Of the column and the chain's outputs, what a later step consumed
    goes, unless it is the last output or the input of a `keep_original` step."""
    if len(infos) == 1 and column in infos[0].outputs:
        return df
    made = {column, *(o for s in infos for o in s.outputs)}
    consumed = {s.input for s in infos} & made
    kept = set(infos[-1].outputs[:1]) | {s.input for s in infos if s.keep_original}
    return df.drop(*(consumed - kept))


def apply_output_conversions(df: DataFrame, conversions: dict) -> DataFrame:
    """{column: [{conversion, params}, …]} or {"*": {...}} for every
    `_step`/`_normalized` output."""
    out = df
    for target, conv in conversions.items():
        convs = conv if isinstance(conv, list) else [conv]
        cols = [c for c in out.columns if ("_step" in c or c.endswith("_normalized"))] if target == "*" else [target]
        for c in cols:
            for cv in convs:
                is_num = is_numeric_type(out.schema[c].dataType)
                out = out.withColumn(c, C.convert(c, cv["conversion"], is_num, **(cv.get("params") or {})))
    return out


def preview(df: DataFrame, config: dict, n: int = 1000, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """The chain on the first n rows. Statistics are fitted on the full
    table (the reference fits on the sample, so its preview differs from the
    result); only the display is limited."""
    res = run_chain(df, config).frame
    return (res.orderBy(order_by) if order_by else res).limit(n)


def step_preview(df: DataFrame, config: dict, column: str, key: Sequence[str], n: int = 1000) -> DataFrame:
    """Before and after of every step of one column's chain, as text, for
    the first n rows in `key` order: (key…, step, method, before, after)."""
    steps = [{**s, "keep_original": True} for s in _steps(config[column])]
    frame = df.withColumn("_original", F.col(column))
    res = run_chain(frame, {column: steps})
    rows = []
    for s, step in zip(res.steps[column], steps):
        src = "_original" if s.input == column else s.input
        rows.append(F.struct(F.lit(s.index + 1).alias("step"), F.lit(step["method"].upper()).alias("method"),
                             F.col(src).cast("string").alias("before"), F.col(s.outputs[0]).cast("string").alias("after")))
    return res.frame.orderBy(*key).limit(n).select(*key, F.inline(F.array(*rows)))


def step_statistics(df: DataFrame, config: dict, column: str) -> DataFrame:
    """Statistics of the original column and of each numeric step's output
    over the whole table: (column, count, mean, std, min, max), one aggregate."""
    steps = [{**s, "keep_original": True} for s in _steps(config[column])]
    res = run_chain(df.withColumn("_original", F.col(column)), {column: steps})
    shown = ["_original", *(s.outputs[0] for s in res.steps[column])]
    shown = [c for c in shown if is_numeric_type(res.frame.schema[c].dataType)]
    x = {c: F.col(c).cast("double") for c in shown}
    a = res.frame.agg(*[f(x[c]).alias(f"{n}{i}") for i, c in enumerate(shown) for n, f in (
        ("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    return a.select(F.inline(F.array(*[F.struct(
        F.lit(column if c == "_original" else c).alias("column"),
        *[F.col(f"{n}{i}").alias(n) for n in ("count", "mean", "std", "min", "max")]) for i, c in enumerate(shown)])))


def unique_mapping(df: DataFrame, column: str, spec, max_values: int = 100) -> DataFrame:
    """Up to `max_values` distinct values of `column`, evenly spaced in
    sorted order, next to what the chain makes of them. Statistics are
    fitted on the full table; the distinct values are ranked with the
    distributed rank helper and the chain runs on that small table."""
    from cirrus.operators.encode import rank_values
    steps = _steps(spec)
    distinct = df.select(column).filter(F.col(column).isNotNull()).distinct()
    ranked = rank_values(distinct, [column], name="_k")
    k = ranked.count()
    step = max(1, -(-k // max_values))  # ceil(k / max_values)
    sample = ranked.filter(F.col("_k") % step == 0).drop("_k")
    # each step is fitted on the full column as transformed by the earlier
    # steps, then applied to the sample
    out = sample.withColumn("original", F.col(column))
    full = df.select(column)
    current = column
    for st in steps:
        m = st["method"].upper()
        if m in TEXT_METHODS:
            if m == "LABEL_ENCODING":
                mapping = E.label_mapping(full, current)
                out = E.label_encode(out, current, mapping=mapping)
                full = E.label_encode(full, current, mapping=mapping)
            elif m != "ONE_HOT":
                out = E.apply_text_method(out, [current], m)
                full = E.apply_text_method(full, [current], m)
        else:
            model = Z.fit(full, [current], m)
            out = out.withColumn(current, model.expr(current))
            full = full.withColumn(current, model.expr(current))
    return out.select("original", F.col(current).alias("normalized"))
