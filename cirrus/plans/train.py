"""Model training and scoring on MLlib (ML1–ML8, CV8, A18/A19, X4, X8, X12,
X13).

Tree models are MLlib estimators in a `Pipeline` (VectorAssembler → model);
they train on partitions in parallel. Hyper-parameters use the reference's
names and are mapped to MLlib (ML4); what MLlib has no equivalent for is
rejected with a message. Multiclass gradient boosting uses OneVsRest.
Boosted trees stop early by the losses of their rounds on validation rows. A fitted
preparation, the model and the names of its classes are one `PipelineModel`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassificationModel, GBTClassifier,
                                       MultilayerPerceptronClassifier, OneVsRest, OneVsRestModel,
                                       RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressionModel, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cirrus.session import ensure_checkpoint_dir
from cirrus.sources.held import hold

UNSUPPORTED_CRITERIA = ("absolute_error", "poisson", "log_loss")
#: MLlib grows trees to this depth at most; it stands for the unlimited depth of `max_depth=None`.
DEEPEST = 30
#: Rounds without a better validation loss after which boosting stops (fixed value).
STOPPING_ROUNDS = 50
#: Values that say what MLlib does anyway.
IMPLIED = {"min_samples_split": (2,), "oob_score": (False,), "ccp_alpha": (0, 0.0), "splitter": ("best",),
           "gamma": (0, 0.0), "reg_alpha": (0, 0.0), "colsample_bytree": (1, 1.0), "colsample_bylevel": (1, 1.0),
           "colsample_bynode": (1, 1.0), "scale_pos_weight": (1, 1.0), "n_jobs": (-1,), "verbose": (0,)}


def map_params(model_type: str, params: dict, classification: bool) -> dict:
    """ML4: reference hyper-parameter names → MLlib parameters. A name or value
    that MLlib has no equivalent for is refused, never dropped; `max_depth`
    None (unlimited) is DEEPEST, and None elsewhere is MLlib's default."""
    out: dict = {}
    trees = model_type in ("random_forest", "xgboost", "gbt", "gradient_boosting")
    for k, v in params.items():
        if k == "max_depth":
            if v is not None and int(v) > DEEPEST:
                raise ValueError(f"max_depth {v}: MLlib grows trees to a depth of {DEEPEST} at most")
            out["maxDepth"] = DEEPEST if v is None else int(v)
        elif v is None or v in IMPLIED.get(k, ()):
            continue
        elif k == "n_estimators" and trees:
            out["numTrees" if model_type == "random_forest" else "maxIter"] = int(v)
        elif k == "min_samples_leaf":
            out["minInstancesPerNode"] = int(v)
        elif k == "min_weight_fraction_leaf":
            out["minWeightFractionPerNode"] = float(v)
        elif k == "min_impurity_decrease":
            out["minInfoGain"] = float(v)
        elif k == "max_features" and trees:
            out["featureSubsetStrategy"] = _max_features(v, classification)
        elif k == "criterion" and v not in UNSUPPORTED_CRITERIA:
            out["impurity"] = {"gini": "gini", "entropy": "entropy", "squared_error": "variance"}[v]
        elif k in ("max_samples", "subsample") and trees:
            out["subsamplingRate"] = float(v)
        elif k == "bootstrap" and model_type == "random_forest":
            out["bootstrap"] = bool(v)
        elif k == "learning_rate" and trees:
            out["stepSize"] = float(v)
        elif k == "max_bin":
            out["maxBins"] = int(v)
        elif k == "random_state":
            out["seed"] = int(v)
        else:
            raise ValueError(f"{model_type}: hyper-parameter {k}={v!r} has no MLlib equivalent")
    return out


def _max_features(v, classification: bool) -> str:
    if v in (None, "auto"):
        return "sqrt" if classification else "all"
    if v in ("sqrt", "log2"):
        return v
    if isinstance(v, float) and 0 < v <= 1:
        return str(v)
    if isinstance(v, int):
        return str(v)
    return "all"


def class_weights(df: DataFrame, label: str, name: str = "weight", rows: DataFrame | None = None) -> DataFrame:
    """ML6: balanced weight n / (k · n_class) per row, counted on `rows` (the
    training rows; `df` if not given). A class that they lack weighs 1. The
    class table is joined as the planner sees fit: its size is not known."""
    counts = (rows if rows is not None else df).groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.crossJoin(F.broadcast(tot)).select("_class", (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias("_w"))
    j = df.join(w, F.col(label).eqNullSafe(F.col("_class")), "left")
    return j.withColumn(name, F.coalesce("_w", F.lit(1.0))).drop("_class", "_w")


def estimator(model_type: str, classification: bool, params: dict | None = None, n_classes: int = 2,
              features: str = "features", label: str = "label", weight: str | None = None):
    """Estimator for a model type: ML1 decision tree, ML2 random forest,
    ML3 gradient-boosted trees (OneVsRest for more than two classes)."""
    p = map_params(model_type, params or {}, classification)
    common = {"featuresCol": features, "labelCol": label}
    if weight:
        common["weightCol"] = weight
    if model_type == "decision_tree":
        cls = DecisionTreeClassifier if classification else DecisionTreeRegressor
        return cls(**common, **p)
    if model_type == "random_forest":
        cls = RandomForestClassifier if classification else RandomForestRegressor
        return cls(**common, **p)
    if model_type in ("xgboost", "gbt", "gradient_boosting"):
        if not classification:
            return GBTRegressor(**common, **p)
        if n_classes <= 2:
            return GBTClassifier(**common, **p)
        w = common.pop("weightCol", None)
        inner = GBTClassifier(**{k: v for k, v in common.items()}, **p)
        if w:
            inner = inner.setWeightCol(w)
        return OneVsRest(classifier=inner, featuresCol=features, labelCol=label)
    if model_type == "mlp":
        return MultilayerPerceptronClassifier(**common, **p)
    raise ValueError(f"unknown model type {model_type!r}")


def assemble(features: Sequence[str], vector_col: str | None = None) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features) if not vector_col else [vector_col],
                           outputCol="features", handleInvalid="keep")


@dataclass
class TrainResult:
    model: PipelineModel
    predictions: DataFrame
    metrics: DataFrame
    feature_names: list[str] = field(default_factory=list)
    labels: DataFrame | None = None  # (text, code) of a text target
    preparation: object | None = None  # fitted PreprocessingModel

    @property
    def pipeline(self) -> PipelineModel:
        """Preparation, assembler, model and the names of the classes as one model: it
        scores rows as they were before the preparation, and is saved as a whole."""
        from cirrus.operators.stages import names_stage, preparation_stages
        before = preparation_stages(self.preparation) if self.preparation is not None else []
        after = [names_stage(self.labels)] if self.labels is not None else []
        return PipelineModel(stages=[*before, *self.model.stages, *after])


def stopping_round(losses: Sequence[float], rounds: int) -> int:
    """ML3: the number of rounds to keep: up to the least loss, seen before `rounds` rounds
    in a row were no better than it."""
    best = 0
    for i, x in enumerate(losses):
        if x < losses[best]:
            best = i
        elif i - best >= rounds:
            break
    return best + 1


def first_rounds(model, k: int):
    """The boosted model of the first `k` rounds of a fitted one."""
    if k >= model.getNumTrees:
        return model
    gate, jvm, java = model._java_obj, SparkContext._active_spark_context._jvm, SparkContext._active_spark_context._gateway
    old, weights = gate.trees(), gate.treeWeights()
    trees, kept = java.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, k), java.new_array(jvm.double, k)
    for i in range(k):
        trees[i], kept[i] = old[i], weights[i]
    if isinstance(model, GBTRegressionModel):
        out = GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(model.uid, trees, kept, model.numFeatures))
    else:
        out = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(
            model.uid, trees, kept, model.numFeatures, model.numClasses))
    out._resetUid(model.uid)
    return model._copyValues(out)


def stopped_early(model, rows: DataFrame, rounds: int = STOPPING_ROUNDS):
    """ML3: a fitted boosted model, or one-vs-rest of them, cut at the round that the losses
    on `rows` (assembled validation rows) name: one pass over them for all rounds. In
    one-vs-rest, each class has its own."""
    if isinstance(model, OneVsRestModel):
        label, models = model.getLabelCol(), []
        for i, m in enumerate(model.models):
            own = rows.withColumn(m.getLabelCol(), (F.col(label) == i).cast("double"))
            models.append(stopped_early(m, own, rounds))
        return model._copyValues(OneVsRestModel(models=models))
    losses = model.evaluateEachIteration(rows, "squared") if isinstance(model, GBTRegressionModel) else model.evaluateEachIteration(rows)
    return first_rounds(model, stopping_round(list(losses), rounds))


def _encoded(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame | None]:
    """`df` with a double `label`; a text target is coded in sorted order."""
    if not isinstance(df.schema[target].dataType, StringType):
        return df.withColumn("label", F.col(target).cast("double")), None
    from cirrus.operators.encode import label_encode, label_mapping
    labels = label_mapping(df, target).checkpoint(eager=True)
    return label_encode(df, target, mapping=labels, out="label").withColumn("label", F.col("label").cast("double")), labels


def train(df: DataFrame, features: Sequence[str], target: str, model_type: str = "random_forest",
          params: dict | None = None, classification: bool | None = None, split_col: str = "split",
          balanced: bool = False, scale: bool = False, early_stopping: bool = True, preparation=None) -> TrainResult:
    """ML7: spec + DataFrame with a `split` column → fitted pipeline,
    predictions on the test rows, metrics rows (test split only — the
    stored split, not the last positional block).

    A text target is label-encoded and the predictions get `prediction_label`.
    `scale` standardises the features inside the pipeline; `preparation` is a fitted
    `PreprocessingModel` whose feature columns are used (`features` may be empty then).
    Boosted trees stop early on the rows of the split `val` where there are any (ML3),
    after `early_stopping_rounds` rounds (50) without a better loss; with the parameter
    `early_stopping_enabled` false, or without such rows, they do not. Class
    weights (`balanced`) are counted on the training rows."""
    from cirrus.operators import evaluate as EV
    from cirrus.operators.encode import decode_labels
    ensure_checkpoint_dir(df.sparkSession)
    params = dict(params or {})
    rounds = params.pop("early_stopping_rounds", None)
    stop = bool(params.pop("early_stopping_enabled", early_stopping))
    rounds = STOPPING_ROUNDS if rounds is None else int(rounds)
    if rounds < 1:
        raise ValueError(f"early_stopping_rounds {rounds}: one round at least")
    data, labels = _encoded(df, target)
    if preparation is not None:
        kept = {c: f"_raw_{i}" for i, c in enumerate([target, split_col]) if c in data.columns}
        data = preparation.transform(data.withColumns({b: F.col(a) for a, b in kept.items()}))
        data = data.withColumns({a: F.col(b) for a, b in kept.items() if a not in preparation.feature_columns}).drop(*kept.values())
        features = preparation.feature_columns
    if classification is None:
        classification = labels is not None or data.agg(F.count_distinct("label")).first()[0] <= 20
    has_split = split_col in data.columns
    train_rows = data.filter(F.col(split_col) == "train") if has_split else data
    weight = None
    if balanced and classification:
        data, weight = class_weights(data, "label", rows=train_rows), "weight"
    n_classes = int(data.agg(F.max("label")).first()[0] or 1) + 1 if classification else 0
    est = estimator(model_type, classification, params, n_classes, weight=weight)
    stages = [assemble(features)]
    if scale:
        stages = [stages[0].setOutputCol("raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    # assembled once: every class, round and level of a fit reads these rows, not the source (a
    # checkpoint keeps their places, on which MLlib's sample of split points depends)
    fitting = data.filter(F.col("label").isNotNull())
    if has_split:
        fitting = fitting.filter(F.col(split_col).isin("train", "val"))
    own = [c for c in (weight, split_col if has_split else None) if c]
    fitting = stages[0].transform(fitting).select(stages[0].getOutputCol(), "label", *own).checkpoint(eager=True)
    train_rows = fitting.filter(F.col(split_col) == "train") if has_split else fitting
    fitted = Pipeline(stages=[*stages[1:], est]).fit(train_rows)
    model = PipelineModel(stages=[stages[0], *fitted.stages])
    if stop and has_split and isinstance(model.stages[-1], (GBTClassificationModel, GBTRegressionModel, OneVsRestModel)):
        val = fitting.filter(F.col(split_col) == "val")
        if not val.isEmpty():
            val = PipelineModel(stages=fitted.stages[:-1]).transform(val)
            model = PipelineModel(stages=[*model.stages[:-1], stopped_early(model.stages[-1], val, rounds)])
    test_rows = data.filter(F.col(split_col) == "test") if has_split else data
    pred = model.transform(test_rows)
    if labels is not None:
        pred = decode_labels(pred, "prediction", labels, out="prediction_label")
    metrics = (EV.classification_metrics(pred, "label", "prediction") if classification
               else EV.regression_metrics(pred, "label", "prediction"))
    return TrainResult(model, pred, metrics, list(features), labels, preparation)


def train_targets(df: DataFrame, features: Sequence[str], targets: Sequence[str], **spec) -> dict[str, TrainResult]:
    """ML7 with several targets: one fitted pipeline for each."""
    return {t: train(df, features, t, **spec) for t in targets}


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str] = (), labels: DataFrame | None = None) -> DataFrame:
    """ML8: batch scoring; the input columns asked for plus the prediction, and
    with the `labels` of a text target its text."""
    from cirrus.operators.encode import decode_labels
    out = model.transform(df).select(*keep, "prediction")
    return out if labels is None else decode_labels(out, "prediction", labels, out="prediction_label")


def score_targets(results: dict[str, TrainResult], df: DataFrame, key: Sequence[str]) -> DataFrame:
    """ML8 for several targets: (key…, target, prediction) rows."""
    out = None
    for t, r in results.items():
        x = score(r.model, df, keep=key).withColumn("target", F.lit(t))
        out = x if out is None else out.unionByName(x)
    return out.select(*key, "target", "prediction")


def save_model(model: PipelineModel, path: str) -> None:
    """A fitted pipeline in MLlib's format: `TrainResult.pipeline` holds the preparation, the
    assembler, the model and the names of the classes. A model that was loaded from `path`
    reads its tables there, so save it elsewhere."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


@dataclass
class CVResult:
    folds: DataFrame  # fold, score, train_score
    summary: DataFrame  # mean, std, best, worst, train_mean, folds
    model: PipelineModel | None  # refitted on all rows


def cv_run(df: DataFrame, features: Sequence[str], target: str, fold_col: str = "fold",
           model_type: str = "random_forest", params: dict | None = None, classification: bool = False,
           parallelism: int = 2, refit: bool = True) -> CVResult:
    """CV8: fit on every fold's complement, score accuracy (classification) or
    −MSE (regression) on the fold and on the rows fitted on; the list of fold
    scores, their summary (std ddof 0) and the model refitted on all rows."""
    from concurrent.futures import ThreadPoolExecutor
    from cirrus.operators import evaluate as EV
    ensure_checkpoint_dir(df.sparkSession)
    data, _ = _encoded(df, target)
    data = data.filter(F.col("label").isNotNull())
    folds = sorted(r[0] for r in data.select(fold_col).distinct().collect())  # k values
    n_classes = int(data.agg(F.max("label")).first()[0] or 1) + 1 if classification else 0
    # assembled once: every fold reads these rows, not the source
    data = hold(assemble(features).transform(data).select("features", "label", fold_col), "assembled")

    def fitted(rows: DataFrame) -> PipelineModel:
        return PipelineModel(stages=[estimator(model_type, classification, params, n_classes).fit(rows)])

    def scored(model: PipelineModel, rows: DataFrame) -> float:
        p = model.transform(rows)
        if classification:
            return float(EV.classification_metrics(p, "label", "prediction").first()["accuracy"])
        return -float(EV.regression_metrics(p, "label", "prediction").first()["mse"])

    def one(k):
        rest = data.filter(F.col(fold_col) != k)
        m = fitted(rest)
        return int(k), scored(m, data.filter(F.col(fold_col) == k)), scored(m, rest)

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        rows = list(pool.map(one, folds))
    scores = df.sparkSession.createDataFrame(rows, "fold int, score double, train_score double")
    total = scores.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"),
                       F.max("score").alias("best"), F.min("score").alias("worst"),
                       F.avg("train_score").alias("train_mean"), F.count(F.lit(1)).alias("folds"))
    return CVResult(scores, total, PipelineModel(stages=[assemble(features), *fitted(data).stages]) if refit else None)


def cross_validate(df: DataFrame, features: Sequence[str], target: str, fold_col: str = "fold",
                   model_type: str = "random_forest", params: dict | None = None, classification: bool = False,
                   parallelism: int = 2) -> DataFrame:
    """CV8: the summary row of `cv_run`."""
    r = cv_run(df, features, target, fold_col, model_type, params, classification, parallelism, refit=False)
    return r.summary.drop("train_mean")


def grid_search(df: DataFrame, features: Sequence[str], target: str, grid: dict, folds: int = 3,
                model_type: str = "random_forest", fold_col: str | None = None):
    """Parameter grid + CrossValidator (regression, RMSE)."""
    from pyspark.ml.evaluation import RegressionEvaluator
    ensure_checkpoint_dir(df.sparkSession)
    first = assemble(features)
    # assembled once: every fold and grid point reads these rows, not the source
    data = first.transform(df.withColumn("label", F.col(target).cast("double")))
    data = data.select("features", "label", *([fold_col] if fold_col else [])).checkpoint(eager=True)
    est = estimator(model_type, False)
    b = ParamGridBuilder()
    for k, vals in grid.items():
        b = b.addGrid(getattr(est, k), vals)
    cv = CrossValidator(estimator=Pipeline(stages=[est]),
                        estimatorParamMaps=b.build(), evaluator=RegressionEvaluator(metricName="rmse"),
                        numFolds=folds, seed=42, parallelism=2)
    if fold_col:
        cv = cv.setFoldCol(fold_col)
    model = cv.fit(data)
    model.bestModel = PipelineModel(stages=[first, *model.bestModel.stages])  # scores rows like `df`
    return model


def lasso_selection(df: DataFrame, features: Sequence[str], target: str, reg: float = 0.1) -> DataFrame:
    """L1-regularised linear regression; features with non-zero weight."""
    data = df.withColumn("label", F.col(target).cast("double"))
    pipe = Pipeline(stages=[assemble(features),
                            StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
                            LinearRegression(featuresCol="scaled", labelCol="label", elasticNetParam=1.0,
                                             regParam=reg)])
    m = pipe.fit(data)
    coefs = m.stages[-1].coefficients.toArray().tolist()
    spark = df.sparkSession
    return spark.createDataFrame([(f, float(c)) for f, c in zip(features, coefs)], "feature string, coefficient double")


def kmeans(df: DataFrame, features: Sequence[str] | None = None, k: int = 5, vector_col: str | None = None,
           seed: int = 42) -> DataFrame:
    """K-means clusters."""
    data = df.withColumn("_v", array_to_vector(vector_col)) if vector_col else df
    asm = VectorAssembler(inputCols=["_v"] if vector_col else list(features), outputCol="features")
    m = Pipeline(stages=[asm, KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster")]).fit(data)
    return m.transform(data).drop("features", "_v")


def mlp(df: DataFrame, vector_col: str, label: str, hidden: Sequence[int] = (32,), seed: int = 42,
        max_iter: int = 50) -> tuple[PipelineModel, DataFrame]:
    """Multilayer perceptron classifier on an array column."""
    data = df.withColumn("features", array_to_vector(vector_col)).withColumn("label", F.col(label).cast("double"))
    n_in = len(data.select(vector_col).first()[0])
    n_out = int(data.agg(F.max("label")).first()[0]) + 1
    clf = MultilayerPerceptronClassifier(layers=[n_in, *hidden, n_out], seed=seed, maxIter=max_iter)
    m = Pipeline(stages=[clf]).fit(data)
    return m, m.transform(data)


def pca(df: DataFrame, features: Sequence[str] | None = None, vector_col: str | None = None, k: int = 10,
        key: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """PCA on standardised columns (rows with a null dropped).
    Returns (variance table: component, ratio, cumulative; loadings table:
    component, feature, loading = component × sqrt(variance); 2-D
    projection with the key columns)."""
    spark = df.sparkSession
    if vector_col:
        data = df.select(*key, array_to_vector(vector_col).alias("_raw")).na.drop()
        names = [f"{vector_col}[{i}]" for i in range(len(df.select(vector_col).first()[0]))]
        asm_in = data
    else:
        data = df.select(*key, *features).na.drop()
        names = list(features)
        asm_in = VectorAssembler(inputCols=list(features), outputCol="_raw").transform(data)
    k = min(k, len(names))
    scaled = StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True).fit(asm_in).transform(asm_in)
    model = PCA(k=k, inputCol="_std", outputCol="_pc").fit(scaled)
    ratios = model.explainedVariance.toArray().tolist()
    cum, rows = 0.0, []
    for i, r in enumerate(ratios):
        cum += r
        rows.append((i + 1, float(r), float(cum)))
    var = spark.createDataFrame(rows, "component int, ratio double, cumulative double")
    pcs = model.pc.toArray()
    load_rows = []
    for j in range(k):
        # eigenvalue of the correlation matrix = ratio × p (standardised data)
        ev = ratios[j] * len(names)
        for i, name in enumerate(names):
            load_rows.append((j + 1, name, float(pcs[i, j] * math.sqrt(ev))))
    loadings = spark.createDataFrame(load_rows, "component int, feature string, loading double")
    proj = model.transform(scaled).select(*key, vector_to_array("_pc").alias("_a")).select(
        *key, F.col("_a")[0].alias("pc1"), F.col("_a")[1].alias("pc2"))
    return var, loadings, proj


def components_for(var: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Number of components reaching `threshold` of the variance."""
    return var.filter(F.col("cumulative") >= threshold).agg(F.min("component").alias("components_for_95"))


def top_contributors(loadings: DataFrame, components: int = 3, k: int = 5) -> DataFrame:
    """The k features with the largest |loading| of each of the
    first components (a few hundred rows at most)."""
    from pyspark.sql import Window
    w = Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), "feature")
    return (loadings.filter(F.col("component") <= components).withColumn("_r", F.row_number().over(w))
                    .filter(F.col("_r") <= k).drop("_r"))
