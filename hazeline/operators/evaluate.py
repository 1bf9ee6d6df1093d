"""Forecast accuracy and model selection, over long prediction tables.

A prediction table has ``horizon_hours``, ``model``, ``city``, ``timestamp``, ``y_true``, ``prediction``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.functions import aqi
from hazeline.operators.quantiles import exact_quantiles
from hazeline.schema import CATEGORY_ORDER, HORIZONS, KEYS, TARGETS, all_present

TOLERANCES = (5, 10, 20, 30)


def persistence(df: DataFrame) -> DataFrame:
    """M1: the forecast is the current index."""
    return df.withColumn("prediction", F.col("aqi_current").cast("double"))


def long_predictions(df: DataFrame, models: dict[str, Column]) -> DataFrame:
    """Long table from a target panel: one row per horizon and model, rows without target or prediction dropped."""
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(h).alias("horizon_hours"), F.lit(name).alias("model"),
                    F.col(t).cast("double").alias("y_true"), value.cast("double").alias("prediction"),
                )
                for h, t in zip(HORIZONS, TARGETS)
                for name, value in models.items()
            ]
        )
    )
    out = df.select(*KEYS, cells.alias("_c")).select(*KEYS, "_c.*")
    return out.where(F.col("y_true").isNotNull() & F.col("prediction").isNotNull())


def clipped(df: DataFrame) -> DataFrame:
    return df.withColumn("prediction", aqi.clip_prediction(F.col("prediction")))


def _error() -> Column:
    return F.col("y_true") - F.col("prediction")


def regression_metrics() -> list[Column]:
    """E1. R² of a constant target is 1 for a perfect forecast and 0 otherwise."""
    e = _error()
    sse = F.sum(e * e)
    total = F.var_pop("y_true") * F.count("y_true")
    flat = F.min("y_true") == F.max("y_true")
    r2 = F.when(flat, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1.0 - F.try_divide(sse, total))
    return [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), r2.alias("r2")]


def metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """E1 per group."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *regression_metrics())


def enrich(df: DataFrame) -> DataFrame:
    """E5: absolute error, tolerance flags, both categories, whether they agree."""
    out = df.withColumns(
        {
            "absolute_error": F.abs(_error()),
            "actual_category": aqi.category_of_prediction(F.col("y_true")),
            "predicted_category": aqi.category_of_prediction(F.col("prediction")),
        }
    )
    flags = {f"within_{k}": F.col("absolute_error") <= k for k in TOLERANCES}
    return out.withColumns({**flags, "category_correct": F.col("actual_category") == F.col("predicted_category")})


def accuracy(df: DataFrame, by: list[str]) -> DataFrame:
    """E2 (and E3 with ``city`` in ``by``): the full accuracy set in one aggregate plus an exact median."""
    rows = enrich(df)
    wide = rows.groupBy(*by).agg(
        F.count("*").alias("rows"),
        *regression_metrics(),
        F.avg("y_true").alias("mean_actual_aqi"),
        F.avg("prediction").alias("mean_predicted_aqi"),
        *[(F.count_if(F.col(f"within_{k}")) / F.count("*") * 100).alias(f"within_{k}_aqi_pct") for k in TOLERANCES],
        (F.count_if("category_correct") / F.count("*") * 100).alias("category_accuracy_pct"),
    )
    q = exact_quantiles(rows, by, "absolute_error", [0.5])
    return wide.join(q, by).withColumn("median_absolute_error", F.col("quantiles")[0]).drop("quantiles")


def confusion(df: DataFrame, by: list[str] = ("horizon_hours",)) -> DataFrame:
    """Actual by predicted category, every category as a column."""
    rows = enrich(df)
    return rows.groupBy(*by, "actual_category").agg(
        *[
            F.count_if(F.col("predicted_category") == c).alias("predicted_" + c.lower().replace(" ", "_"))
            for c in CATEGORY_ORDER
        ]
    )


def improvement(df: DataFrame, baseline: str = "persistence", by: list[str] = ("horizon_hours",)) -> DataFrame:
    """MAE gain over the baseline in percent, from a metrics table."""
    base = df.where(F.col("model") == baseline).select(*by, F.col("mae").alias("baseline_mae"))
    gain = F.try_divide(F.col("baseline_mae") - F.col("mae"), F.col("baseline_mae")) * 100
    return df.where(F.col("model") != baseline).join(base, list(by)).withColumn("improvement_pct", gain)


def fold_aggregate(df: DataFrame) -> DataFrame:
    """Stability of each model over folds, rounded as reported; input is one metrics row per fold."""
    r4 = {
        "mean_mae": F.avg("mae"), "std_mae": F.stddev_samp("mae"), "worst_mae": F.max("mae"), "best_mae": F.min("mae"),
        "mean_rmse": F.avg("rmse"), "std_rmse": F.stddev_samp("rmse"), "mean_r2": F.avg("r2"), "worst_r2": F.min("r2"),
    }
    return df.groupBy("horizon_hours", "model").agg(
        F.count_distinct("fold").alias("folds"),
        *[F.round(c, 4).alias(n) for n, c in r4.items()],
        F.round(F.sum("fit_seconds"), 2).alias("total_fit_seconds"),
    )


def rank_models(aggregate: DataFrame, column: str = "mean_mae", out: str = "rank_by_mean_mae") -> DataFrame:
    """Dense rank per horizon over the few aggregated rows."""
    return aggregate.withColumn(out, F.dense_rank().over(Window.partitionBy("horizon_hours").orderBy(column)))


def _first_by(df: DataFrame, by: str, *order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("_r", rank).where(F.col("_r") == 1).drop("_r")


def champions(aggregate: DataFrame) -> DataFrame:
    """Lowest mean MAE, then worst MAE, then spread; the model name settles what is still equal."""
    return _first_by(aggregate, "horizon_hours", "mean_mae", "worst_mae", "std_mae", "model")


def single_split_champions(results: DataFrame) -> DataFrame:
    """Lowest validation MAE, then RMSE, then highest R²."""
    return _first_by(results, "horizon_hours", "val_mae", "val_rmse", F.col("val_r2").desc(), "model")


def common_rows(df: DataFrame, models: list[str]) -> DataFrame:
    """(key, horizon) rows that every listed model predicted, one column per model."""
    key = [*KEYS, "horizon_hours"]
    picked = df.where(F.col("model").isin(*models))
    wide = picked.groupBy(*key).agg(
        F.max("y_true").alias("y_true"),
        (F.max("y_true") - F.min("y_true")).alias("target_spread"),
        *[F.max(F.when(F.col("model") == m, F.col("prediction"))).alias(f"{m}_prediction") for m in models],
    )
    return wide.where(all_present([f"{m}_prediction" for m in models]))


def paired_comparison(df: DataFrame, models: list[str], by: list[str] = ("horizon_hours",)) -> DataFrame:
    """E1 of each model over the common rows only."""
    wide = common_rows(df, models)
    long = wide.unpivot(
        [*KEYS, "horizon_hours", "y_true"], [f"{m}_prediction" for m in models], "model", "prediction"
    ).withColumn("model", F.regexp_replace("model", "_prediction$", ""))
    return metrics(long, [*by, "model"])


def with_baseline(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Model and baseline metrics side by side; the model is clipped, the baseline is not."""
    base = predictions.select(*by, "y_true", F.col("persistence_prediction").alias("prediction"))
    model = clipped(predictions.select(*by, "y_true", "prediction"))
    both = model.withColumn("model", F.lit("model")).unionByName(base.withColumn("model", F.lit("persistence")))
    return improvement(metrics(both, [*by, "model"]), "persistence", by)
