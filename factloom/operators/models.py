"""Models of pyspark.ml behind one call: leaderboard, cross-validation, tuning, importance, prediction and stored artefacts."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..limits import Refusal
from .features import stratified_split

#: Trees of a forest, iterations of a linear model, hidden layers of the network, folds.
TREES, ITERATIONS, HIDDEN, FOLDS = 200, 1000, (64, 32), 5


def candidates(task: str, n_features: int = 1, classes: int = 2) -> dict:
    if task == "regression":
        return {"linear": LinearRegression(maxIter=ITERATIONS), "forest": RandomForestRegressor(numTrees=TREES, seed=42), "boosted": GBTRegressor(seed=42, maxIter=20)}
    found = {"logistic": LogisticRegression(maxIter=ITERATIONS), "forest": RandomForestClassifier(numTrees=TREES, seed=42), "mlp": MultilayerPerceptronClassifier(layers=[n_features, *HIDDEN, classes], seed=42, maxIter=100)}
    return found | ({"boosted": GBTClassifier(seed=42, maxIter=20)} if task == "binary" else {})


def judge(task: str, label: str):
    return RegressionEvaluator(labelCol=label, metricName="rmse") if task == "regression" else MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")


def stages(target: str, features: list[str], task: str) -> tuple[list, str]:
    """Feature and label stages, and the label's column. The network sees scaled features; trees and linear models do not mind them."""
    made = [VectorAssembler(inputCols=features, outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)]
    if task == "regression":
        return made, target
    return [*made, StringIndexer(inputCol=target, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep")], "label_index"


def split(df: DataFrame, target: str, features: list[str], task: str, id_col: str, test: float = 0.2) -> tuple[DataFrame, DataFrame]:
    whole = df.dropna(subset=[target, *features])
    parted = _hash_split(whole, id_col) if task == "regression" else stratified_split(whole, target, id_col, test)
    return parted.filter("split = 'train'"), parted.filter("split = 'test'")


def train(df: DataFrame, target: str, features: list[str], task: str, id_col: str, names: list[str] | None = None) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Models by name, and the leaderboard on the held-out fifth: model, metric, value."""
    fit, held = split(df, target, features, task, id_col)
    first, label = stages(target, features, task)
    judged = judge(task, label)
    classes = fit.select(target).distinct().count() + 1 if task != "regression" else 1  # one more for labels unseen in training
    models, board = {}, []
    for name, model in candidates(task, len(features), classes).items():
        if names and name not in names:
            continue
        models[name] = Pipeline(stages=[*first, model.setLabelCol(label)]).fit(fit)
        board.append((name, judged.getMetricName(), float(judged.evaluate(models[name].transform(held)))))
    board.sort(key=lambda x: x[2], reverse=task != "regression")
    return models, df.sparkSession.createDataFrame(board, "model string, metric string, value double")


def cross_validate(df: DataFrame, target: str, features: list[str], task: str, name: str, folds: int = FOLDS, grid: dict[str, list] | None = None) -> tuple[PipelineModel, DataFrame]:
    """The best model over ``grid`` (of the candidate's parameters; none: the candidate as it is) by ``folds``-fold validation, and a row per setting: params, mean, deviation."""
    whole = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([target, *features])]).dropna()  # folds are cached, so only with the columns they need
    first, label = stages(target, features, task)
    model = candidates(task, len(features), whole.select(target).distinct().count() + 1 if task != "regression" else 1)[name].setLabelCol(label)
    builder = ParamGridBuilder()
    for k, values in (grid or {}).items():
        builder = builder.addGrid(model.getParam(k), values)
    maps = builder.build()
    fitted = CrossValidator(estimator=Pipeline(stages=[*first, model]), estimatorParamMaps=maps, evaluator=judge(task, label), numFolds=folds, seed=42, parallelism=2).fit(whole)
    rows = [(json.dumps({p.name: v for p, v in m.items()}, sort_keys=True), float(a), float(s)) for m, a, s in zip(maps, fitted.avgMetrics, fitted.stdMetrics, strict=True)]
    return fitted.bestModel, df.sparkSession.createDataFrame(rows, "params string, mean double, deviation double")


#: Settings that ``tune`` tries, by candidate.
GRIDS = {
    "linear": {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 1.0]},
    "logistic": {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 1.0]},
    "forest": {"maxDepth": [4, 8, 12]},
    "boosted": {"maxDepth": [3, 5], "stepSize": [0.05, 0.1]},
    "mlp": {"maxIter": [50, 200]},
}


def tune(df: DataFrame, target: str, features: list[str], task: str, name: str, folds: int = 3) -> tuple[PipelineModel, DataFrame]:
    return cross_validate(df, target, features, task, name, folds, GRIDS[name])


def feature_importance(model: PipelineModel) -> DataFrame | Refusal:
    """rank, feature, importance: of trees their own, of linear models the mean size of a (scaled) coefficient over classes."""
    names, last = model.stages[0].getInputCols(), model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix"):
        values = abs(last.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(last, "coefficients"):
        values = abs(last.coefficients.toArray())
    else:
        return Refusal("this kind of model tells no importance")
    order = sorted(zip(names, values, strict=True), key=lambda x: (-x[1], x[0]))
    return SparkSession.active().createDataFrame([(k, n, float(v)) for k, (n, v) in enumerate(order, 1)], "rank int, feature string, importance double")


def predict(model: PipelineModel, df: DataFrame) -> DataFrame | Refusal:
    """``df`` with ``predicted``, labels in their own words; rows that lack a feature are refused before any work."""
    names = model.stages[0].getInputCols()
    if missing := [c for c in names if c not in df.columns]:
        return Refusal(f"missing feature columns: {', '.join(missing)}")
    indexer = next((s for s in model.stages if hasattr(s, "labels")), None)
    run = PipelineModel([s for s in model.stages if s is not indexer])
    out = run.transform(df.dropna(subset=names))
    predicted = F.col("prediction")
    if indexer is not None:
        labels = F.array(*[F.lit(x) for x in indexer.labels])
        predicted = F.get(labels, predicted.cast("int"))
    return out.withColumn("predicted", predicted).select(*df.columns, "predicted")


def compare(boards: dict[str, DataFrame]) -> DataFrame:
    """Leaderboards under one: artefact, model, metric, value."""
    out = None
    for name, board in boards.items():
        part = board.select(F.lit(name).alias("artefact"), *board.columns)
        out = part if out is None else out.union(part)
    return out


class ModelStore:
    """Stored models under one folder, a sub-folder each with what it was trained on beside it; any path that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._at = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, name: str, model: PipelineModel, **facts) -> None:
        model.write().overwrite().save(f"{self.path}/{name}/model")
        self.spark.createDataFrame([(name, json.dumps(facts, sort_keys=True))], "name string, facts string").coalesce(1).write.mode("overwrite").json(f"{self.path}/{name}/facts")

    def load(self, name: str) -> PipelineModel | Refusal:
        if not self._fs.exists(self._at(f"{self.path}/{name}/model")):
            return Refusal(f"no model {name}")
        return PipelineModel.load(f"{self.path}/{name}/model")

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._at(f"{self.path}/{name}"), True)

    def listing(self) -> DataFrame:
        """name and facts of the stored models."""
        at = self._at(self.path)
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []
        if not names:
            return self.spark.createDataFrame([], "name string, facts string")
        return self.spark.read.schema("name string, facts string").json([f"{self.path}/{n}/facts" for n in names])


def _hash_split(df: DataFrame, id_col: str) -> DataFrame:
    return df.withColumn("split", F.when(F.pmod(F.xxhash64(id_col), F.lit(5)) == 0, "test").otherwise("train"))
