"""Tree regressors on feature tables: training, evaluation, ensembles."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.operators.metrics import fold_summary, regression_metrics
from siftlode.operators.order import kept, quantiles


@dataclass(frozen=True)
class Features:
    """The columns that a model reads, in its own order."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()


def feature_columns(df: DataFrame, targets: tuple[str, ...] = ("sigma", "y", "censored")) -> list[str]:
    return [c for c in df.columns if c not in targets]


def align_features(df: DataFrame, features: Features, keep: tuple[str, ...] = ()) -> DataFrame:
    """The model's columns in its order: absent ones null, numbers by ``try_cast``, NaN as null, a missing category ``unknown``; and ``<x>_missing`` for each number."""

    def number(c: str):
        value = F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")
        return F.when(~F.isnan(value), value)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) if c in df.columns else F.lit("unknown")
    numbers = [number(c).alias(c) for c in features.numeric]
    flags = [number(c).isNull().cast("double").alias(f"{c}_missing") for c in features.numeric]
    return df.select(*keep, *numbers, *flags, *[text(c).alias(c) for c in features.categorical])


class Medians(Estimator):
    """Fills gaps with exact medians, found for all columns together by ranges; a column without any value gets 0.

    Fitting gives a plain SQL stage, ``<x>_filled`` for each column, which is saved like any other.
    """

    def __init__(self, columns: tuple[str, ...]):
        super().__init__()
        self.columns = columns

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in self.columns])
        long = dataset.select(F.explode(pairs).alias("x")).select("x.column", "x.value")
        medians = {r["column"]: r["quantiles"][0] for r in quantiles(long, "value", [0.5], ("column",)).collect()}
        filled = [f"coalesce(nanvl(`{c}`, NULL), {medians.get(c) or 0.0!r}D) AS `{c}_filled`" for c in self.columns]
        return SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__")


def players(prepared: DataFrame, features: Features, column: str = "features") -> list[str]:
    """The feature that each place of the assembled vector belongs to, by the names that the pipeline gave them."""
    attributes = [a for kind in prepared.schema[column].metadata["ml_attr"]["attrs"].values() for a in kind]
    own = [(f"{c}_{end}", c) for c in features.numeric for end in ("filled", "missing")] + [(f"{c}_{end}", c) for c in features.categorical for end in ("index", "hot")]
    return [max(((made, c) for made, c in own if a["name"] == made or a["name"].startswith(f"{made}_")), key=lambda x: len(x[0]))[1] for a in sorted(attributes, key=lambda a: a["idx"])]


def _prepared(features: Features, one_hot: bool) -> tuple[list, list[str]]:
    filled = [f"{c}_filled" for c in features.numeric]
    stages: list = [Medians(features.numeric)] if features.numeric else []
    used = filled + [f"{c}_missing" for c in features.numeric]
    if features.categorical:
        index = [f"{c}_index" for c in features.categorical]
        stages.append(StringIndexer(inputCols=list(features.categorical), outputCols=index, handleInvalid="keep"))
        if one_hot:
            stages.append(OneHotEncoder(inputCols=index, outputCols=[f"{c}_hot" for c in features.categorical], handleInvalid="keep"))
            index = [f"{c}_hot" for c in features.categorical]
        used += index
    return stages + [VectorAssembler(inputCols=used, outputCol="features")], used


def forest(features: Features, label: str = "y", trees: int = 500, depth: int = 8, seed: int = 42) -> Pipeline:
    """The baseline: medians for gaps, one column for each category, a random forest."""
    return Pipeline(stages=[*_prepared(features, True)[0], RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=1.0)])


def boosted(features: Features, label: str = "y", trees: int = 600, depth: int = 6, rate: float = 0.05, seed: int = 42, share: float = 1.0, max_bins: int = 64) -> Pipeline:
    """Boosted trees. ``share`` below 1 lets the seed matter, as an ensemble needs."""
    model = GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, subsamplingRate=share, maxBins=max_bins, checkpointInterval=20)
    return Pipeline(stages=[*_prepared(features, False)[0], model])


def holdout_metrics(model: PipelineModel, test: DataFrame, label: str = "y") -> DataFrame:
    """Metrics of one scoring of the held-out rows."""
    return regression_metrics(model.transform(test), label, "prediction")


def cross_validate(df: DataFrame, build: Callable[[], Estimator], k: int = 5, fold: str = "fold", label: str = "y", parallel: int = 2) -> tuple[DataFrame, DataFrame]:
    """Metrics of each fold and their summary; folds are trained beside each other."""

    def one(i: int) -> DataFrame:
        model = build().fit(df.where(F.col(fold) != i))
        return regression_metrics(model.transform(df.where(F.col(fold) == i)), label, "prediction").withColumn("fold", F.lit(i))

    with ThreadPoolExecutor(parallel) as pool:
        per_fold = reduce(DataFrame.unionByName, list(pool.map(one, range(k))))
    return per_fold, fold_summary(per_fold)


def grid_search(df: DataFrame, build: Callable[[], Estimator], grid: dict[str, list], k: int = 5, fold: str = "fold", label: str = "y", parallel: int = 2) -> tuple[PipelineModel, DataFrame]:
    """The best of all settings of the last stage, refitted on all rows, and ``setting, fold`` with each one's metrics.

    Folds are those of the column ``fold`` (0 to ``k - 1``), so every setting is
    judged on the same rows as :func:`cross_validate` judges its one. The best
    has the least mean RMSE.
    """
    estimator = build()
    stage = estimator.getStages()[-1]
    settings = ParamGridBuilder()
    for name, values in grid.items():
        settings = settings.addGrid(stage.getParam(name), values)
    settings = settings.build()
    rows = df.withColumn(fold, F.col(fold).cast("int"))
    judge = RegressionEvaluator(labelCol=label, metricName="rmse")
    fitted = CrossValidator(estimator=estimator, estimatorParamMaps=settings, evaluator=judge, numFolds=k, foldCol=fold, parallelism=parallel, collectSubModels=True).fit(rows)
    tables = []
    for i, models in enumerate(fitted.subModels):
        held = rows.where(F.col(fold) == i)
        for setting, fitted_one in zip(settings, models, strict=True):
            named = F.create_map(*[F.lit(x) for p, v in setting.items() for x in (p.name, str(v))]) if setting else F.lit(None).cast("map<string,string>")
            tables.append(regression_metrics(fitted_one.transform(held), label, "prediction").select(named.alias("setting"), F.lit(i).alias("fold"), "n", "mae", "rmse", "r2"))
    return fitted.bestModel, reduce(DataFrame.unionByName, tables)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with ``pred`` (log10) and ``pred_sigma``, its power of ten."""
    out = model.transform(df).withColumnRenamed("prediction", "pred")
    return out.select(*df.columns, "pred").withColumn("pred_sigma", F.pow(F.lit(10.0), F.col("pred")))


def fit_ensemble(df: DataFrame, build: Callable[[int], Estimator], seeds: tuple[int, ...] = tuple(range(10)), parallel: int = 5) -> list[PipelineModel]:
    """One model for each seed, trained from a few driver threads on one stored copy of ``df``."""
    df = kept(df)
    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(lambda s: build(s).fit(df), seeds))


def score_ensemble(models: list[PipelineModel], df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` with ``members`` (each model's prediction), ``ens_mean`` and ``ens_std`` (population), in one pass over the rows."""
    out = df
    for k, model in enumerate(models):
        made = model.transform(out).withColumnRenamed("prediction", f"_p{k}")
        out = made.select(*out.columns, f"_p{k}")
    members = F.array(*[F.col(f"_p{k}") for k in range(len(models))])
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / len(models)
    rows = out.select(*keep, members.alias("members")).withColumn("ens_mean", mean(F.col("members")))
    return rows.withColumn("ens_std", F.sqrt(mean(F.transform("members", lambda x: (x - F.col("ens_mean")) * (x - F.col("ens_mean"))))))

