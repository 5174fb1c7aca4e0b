"""Fitted preparation as Spark ML stages (S10, Z24/Z25): one `PipelineModel` holds the
preparation of the columns, the assembler, the model and the names of the classes, and
is saved and loaded as a whole.

A stage keeps what was fitted in one JSON parameter (numbers come back bit for bit) and
tables that grow with the data (category → code, category → mean, label names) as Parquet
files next to it; a loaded stage reads them when it transforms. Nothing of such a table
is ever in the driver.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrus.operators import encode as E
from cirrus.operators import normalize as N


class _Writer(MLWriter):
    def __init__(self, stage: "FittedStage"):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        for name, table in self.stage.tables.items():
            table.write.parquet(f"{path}/tables/{name}")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> "FittedStage":
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.cls()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage.tables = {n: self.sparkSession.read.parquet(f"{path}/tables/{n}") for n in stage.fitted.get("tables", [])}
        return stage


class FittedStage(Transformer, MLReadable, MLWritable):
    """A transformer whose fitted state is `fitted` (JSON) and `tables` (DataFrames)."""

    spec = Param(Params._dummy(), "spec", "what was fitted, as JSON", typeConverter=TypeConverters.toString)

    def __init__(self, fitted: dict | None = None, tables: dict[str, DataFrame] | None = None):
        super().__init__()
        self.tables = dict(tables or {})
        self._set(spec=json.dumps({**(fitted or {}), "tables": sorted(self.tables)}))

    @property
    def fitted(self) -> dict:
        return json.loads(self.getOrDefault(self.spec))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def copy(self, extra=None):
        out = super().copy(extra)
        out.tables = dict(self.tables)
        return out


class Cyclic(FittedStage):
    """Columns → sine and cosine over their fitted periods."""

    def _transform(self, df: DataFrame) -> DataFrame:
        for c, period in self.fitted["periods"].items():
            df = E.cyclic(df, c, period, drop=True)
        return df


class Scale(FittedStage):
    """The fitted scaler of each column, in place."""

    @classmethod
    def of(cls, model: N.ScalerModel) -> "Scale":
        return cls({"params": {c: list(p) for c, p in model.params.items()}})

    def model(self) -> N.ScalerModel:
        return N.ScalerModel({c: tuple(p) for c, p in self.fitted["params"].items()})

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.model().transform(df)


class OneHotColumns(FittedStage):
    """One column for each fitted category but the first; unknown and null are all 0."""

    def _transform(self, df: DataFrame) -> DataFrame:
        for c, cats in self.fitted["categories"].items():
            df = E.one_hot(df, c, cats=cats, drop_first=True)
        return df


class OneHotVector(FittedStage):
    """Z8/Z20 for any number of categories: one sparse vector column, by the table `codes`."""

    @classmethod
    def of(cls, c: str, codes: DataFrame, size: int, out: str, drop_first: bool) -> "OneHotVector":
        return cls({"column": c, "size": size, "out": out, "drop_first": drop_first}, {"codes": codes})

    def _transform(self, df: DataFrame) -> DataFrame:
        f = self.fitted
        return E.one_hot_vector(df, f["column"], self.tables["codes"], f["size"], f["out"], f["drop_first"])


class Codes(FittedStage):
    """Category → code by the table `codes`; unknown → −1."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return E.label_encode(df, self.fitted["column"], mapping=self.tables["codes"], unknown=-1)


class Means(FittedStage):
    """Category → mean of the target by the table `means`; unseen → mean of the means."""

    @classmethod
    def of(cls, encoder: E.TargetEncoder, out: str | None = None) -> "Means":
        return cls({"column": encoder.column, "target": encoder.target, "default": encoder.default,
                    "n": encoder.n_categories, "out": out}, {"means": encoder.means})

    def _transform(self, df: DataFrame) -> DataFrame:
        f = self.fitted
        return E.TargetEncoder(f["column"], f["target"], self.tables["means"], f["default"], f["n"]).transform(df, f["out"])


class Align(FittedStage):
    """The fitted feature columns in order; missing ones are 0, what they were made of is gone."""

    def _transform(self, df: DataFrame) -> DataFrame:
        features, consumed = self.fitted["features"], set(self.fitted["consumed"])
        df = df.withColumns({c: F.lit(0.0) for c in features if c not in df.columns})
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in features and c not in consumed],
                         *[F.col(f"`{c}`") for c in features])


class Names(FittedStage):
    """The text of a predicted class, by the table `labels`."""

    def _transform(self, df: DataFrame) -> DataFrame:
        f = self.fitted
        return E.decode_labels(df, f["column"], self.tables["labels"], out=f["out"])


def preparation_stages(model: E.PreprocessingModel) -> list[Transformer]:
    """The stages of a fitted `PreprocessingModel`, in the order in which it applies them."""
    out: list[Transformer] = []
    if model.cyclic_periods:
        out.append(Cyclic({"periods": model.cyclic_periods}))
    if model.one_hot_cats:
        out.append(OneHotColumns({"categories": model.one_hot_cats}))
    for c, (codes, size, name) in model.vectors.items():
        out.append(OneHotVector.of(c, codes, size, name, drop_first=True))
    for c, codes in model.ordinal.items():
        out.append(Codes({"column": c}, {"codes": codes}))
    consumed = [*model.cyclic_periods, *model.one_hot_cats, *model.vectors]
    out.append(Align({"features": model.feature_columns, "consumed": consumed}))
    if model.scaler is not None:
        out.append(Scale.of(model.scaler))
    return out


def names_stage(labels: DataFrame, column: str = "prediction", out: str = "prediction_label") -> Names:
    return Names({"column": column, "out": out}, {"labels": labels})


def feature_list(stages: Sequence[Transformer]) -> list[str]:
    """The feature columns that a pipeline was fitted on."""
    return next((s.fitted["features"] for s in stages if isinstance(s, Align)), [])
