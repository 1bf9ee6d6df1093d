"""MLlib forecasters for the three horizons."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.functions import aqi
from hazeline.operators.evaluate import clipped, metrics, with_baseline
from hazeline.schema import FEATURES, HORIZONS, KEYS, require_columns

SEED = 42


@dataclass(frozen=True)
class TreeSize:
    """The published sizes. Smaller ones are for quick runs."""

    forest_trees: int = 100
    forest_depth: int = 16
    boosted_trees: int = 150
    boosted_depth: int = 5


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")


def ridge(label: str, rows: int, label_spread: float, alpha: float = 1.0, features: list[str] = FEATURES) -> Pipeline:
    """M2: standardised ridge regression with penalty ``alpha``.

    The penalty is stated for population-scaled columns. The scaler here divides by the sample spread, which shrinks
    each column by sqrt((n-1)/n), and the solver divides the penalty by n and by the label's spread.
    """
    penalty = alpha * (rows - 1) / rows / rows * label_spread
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    model = LinearRegression(
        featuresCol="scaled", labelCol=label, predictionCol="prediction", regParam=penalty, elasticNetParam=0.0,
        standardization=False, solver="normal",
    )
    return Pipeline(stages=[_assembler(features), scaler, model])


def random_forest(label: str, size: TreeSize = TreeSize(), features: list[str] = FEATURES) -> Pipeline:
    """M3."""
    model = RandomForestRegressor(
        featuresCol="features", labelCol=label, predictionCol="prediction", numTrees=size.forest_trees,
        maxDepth=size.forest_depth, featureSubsetStrategy="sqrt", minInstancesPerNode=2, seed=SEED,
    )
    return Pipeline(stages=[_assembler(features), model])


def boosted_trees(label: str, size: TreeSize = TreeSize(), features: list[str] = FEATURES) -> Pipeline:
    """M4: leaf penalties have no counterpart, and columns are drawn per node instead of per tree."""
    model = GBTRegressor(
        featuresCol="features", labelCol=label, predictionCol="prediction", maxIter=size.boosted_trees,
        maxDepth=size.boosted_depth, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8",
        minInstancesPerNode=3, seed=SEED,
    )
    return Pipeline(stages=[_assembler(features), model])


def model_rows(df: DataFrame, features: list[str] = FEATURES, extra: list[str] = ()) -> DataFrame:
    """Complete rows as DOUBLE, with targets as label columns."""
    require_columns(df, [*features, "aqi_current"], "model table")
    labels = [F.col(f"target_aqi_{h}h").cast("double").alias(f"target_aqi_{h}h") for h in HORIZONS]
    return df.select(
        *KEYS, *extra, F.col("aqi_current").cast("double").alias("aqi_current"), *labels,
        *[F.col(c).cast("double").alias(c) for c in features],
    )


def create(name: str, train: DataFrame, label: str, size: TreeSize = TreeSize(), features: list[str] = FEATURES):
    if name == "ridge":
        s = train.agg(F.count("*").alias("n"), F.stddev_pop(label).alias("s")).first()
        return ridge(label, s["n"], s["s"] or 1.0, features=features)
    if name == "random_forest":
        return random_forest(label, size, features)
    if name == "boosted_trees":
        return boosted_trees(label, size, features)
    raise ValueError(f"Unknown trainable model: {name}")


def predictions(scored: DataFrame, horizon: int, model: str, extra: list[str] = ()) -> DataFrame:
    return scored.select(
        *KEYS, *extra, F.lit(horizon).alias("horizon_hours"), F.lit(model).alias("model"),
        F.col(f"target_aqi_{horizon}h").alias("y_true"), F.col("prediction"),
    )


def train_and_evaluate(
    name: str, horizon: int, train: DataFrame, evaluation: dict[str, DataFrame], size: TreeSize = TreeSize(),
    features: list[str] = FEATURES,
) -> tuple[object, DataFrame]:
    """M5: fit one (model, horizon) and score it on each named split; unclipped, as the benchmark does."""
    label = f"target_aqi_{horizon}h"
    started = time.perf_counter()
    if name == "persistence":
        fitted = None
    else:
        fitted = create(name, train, label, size, features).fit(train)
    seconds = time.perf_counter() - started if fitted is not None else 0.0
    out = None
    for split, rows in evaluation.items():
        scored = rows.withColumn("prediction", F.col("aqi_current")) if fitted is None else fitted.transform(rows)
        part = metrics(predictions(scored, horizon, name), ["horizon_hours", "model"]).withColumns(
            {"split": F.lit(split), "fit_seconds": F.lit(seconds)}
        )
        out = part if out is None else out.unionByName(part)
    return fitted, out


def walk_forward_benchmark(
    labelled: DataFrame, models: list[str], folds: list[str], horizons=HORIZONS, size: TreeSize = TreeSize(),
    features: list[str] = FEATURES,
) -> DataFrame:
    """M6: metrics per (fold, horizon, model). The fold-labelled table is persisted once and read by every fit."""
    table = model_rows(labelled, features, ["fold", "role"]).persist()
    try:
        out = None
        for fold in folds:
            mine = table.where(F.col("fold") == fold)
            train, evaluation = mine.where(F.col("role") == "train"), mine.where(F.col("role") != "train")
            for h in horizons:
                for name in models:
                    _, scores = train_and_evaluate(name, h, train, {"validation": evaluation}, size, features)
                    # A metrics row is a few numbers; holding them keeps the loop's plans short.
                    rows = [{**r.asDict(), "fold": fold} for r in scores.collect()]
                    out = rows if out is None else out + rows
    finally:
        table.unpersist()
    return labelled.sparkSession.createDataFrame(
        out or [],
        "fold string, horizon_hours int, model string, split string, rows long, mae double, rmse double, r2 double, "
        "fit_seconds double",
    )


def save_models(models: dict[int, PipelineModel], path: str) -> None:
    """M9: one folder per horizon."""
    for horizon, model in models.items():
        model.write().overwrite().save(f"{path}/{horizon}h")


def load_models(path: str, horizons=HORIZONS) -> dict[int, PipelineModel]:
    return {h: PipelineModel.load(f"{path}/{h}h") for h in horizons}


def score_all(rows: DataFrame, models: dict[int, PipelineModel], name: str = "boosted_trees", features=FEATURES):
    """M8: every row at every horizon in one pass, clipped and categorised, one row per (key, horizon)."""
    scored = rows
    for h, model in models.items():
        # Each pipeline adds its own working columns, which go before the next one is applied.
        keep = list(scored.columns)
        scored = model.transform(scored).select(*keep, F.col("prediction").alias(f"_p{h}"))
    cells = F.explode(
        F.array(*[F.struct(F.lit(h).alias("horizon_hours"), F.col(f"_p{h}").alias("raw_prediction")) for h in models])
    )
    long = scored.select(*rows.columns, cells.alias("_c")).select(*rows.columns, "_c.*")
    long = long.withColumns(
        {
            "predicted_aqi": aqi.clip_prediction(F.col("raw_prediction")),
            "predicted_category": aqi.category_of_prediction(F.col("raw_prediction")),
            "horizon": F.concat(F.col("horizon_hours").cast("string"), F.lit("h")),
            "model_name": F.lit(name),
            "model_alias": F.concat(F.lit("production-"), F.col("horizon_hours").cast("string"), F.lit("h")),
        }
    )
    return long


def model_parity(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Largest difference between two sets of predictions."""
    joined = a.select(*keys, F.col("prediction").alias("_a")).join(b.select(*keys, F.col("prediction").alias("_b")), keys)
    out = joined.agg(F.count("*").alias("rows"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_difference"))
    return out.withColumn("matches", F.coalesce(F.col("max_difference") <= tolerance, F.lit(False)))


def linear_terms(model: PipelineModel, features: list[str] = FEATURES) -> tuple[dict, dict, float]:
    """Coefficients on the raw scale, column means, and the prediction at the means."""
    scaler, linear = model.stages[-2], model.stages[-1]
    std, mean = scaler.std.toArray(), scaler.mean.toArray()
    betas = {f: float(b / s) if s else 0.0 for f, b, s in zip(features, linear.coefficients.toArray(), std)}
    return betas, dict(zip(features, map(float, mean))), float(linear.intercept)


def holdout_predictions(
    train: DataFrame, test: DataFrame, name: str, horizons=HORIZONS, size: TreeSize = TreeSize(), features=FEATURES
) -> DataFrame:
    """Fit on the training rows, predict the held-out rows: model clipped, persistence as it is."""
    out = None
    for h in horizons:
        fitted = create(name, train, f"target_aqi_{h}h", size, features).fit(train)
        scored = fitted.transform(test).withColumn("persistence_prediction", F.col("aqi_current"))
        part = clipped(predictions(scored, h, name, ["persistence_prediction"]))
        out = part if out is None else out.unionByName(part)
    return out


def holdout_report(predicted: DataFrame) -> DataFrame:
    """Per horizon, model against persistence."""
    return with_baseline(predicted, ["horizon_hours"])
