"""Contributions of features to a forecast.

A scored row carries its contributions as one array, so ranking them and adding them up stay inside the row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.schema import KEYS


def linear_contributions(
    df: DataFrame, coefficients: dict[str, float], means: dict[str, float], keys: list[str] = KEYS
) -> DataFrame:
    """Exact contributions of a linear model, ``b_j * (x_j - mean_j)``, for every row."""
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(c).cast("double").alias("feature_value"),
            (F.lit(float(b)) * (F.col(c).cast("double") - F.lit(float(means[c])))).alias("contribution"),
        )
        for c, b in coefficients.items()
    ]
    return df.select(*keys, F.array(*cells).alias("contributions"))


def long_contributions(scored: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return scored.select(*keys, F.explode("contributions").alias("_c")).select(*keys, "_c.*")


def global_importance(scored: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean absolute contribution per feature, ranked (the ranking orders one row per feature)."""
    mean = long_contributions(scored, keys).groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("mean_abs_contribution")
    )
    order = F.array_sort(F.collect_list(F.struct((-F.col("mean_abs_contribution")).alias("neg"), "feature")))
    return mean.agg(order.alias("_all")).select(F.posexplode("_all").alias("pos", "_f")).select(
        (F.col("pos") + 1).alias("rank"), F.col("_f.feature").alias("feature"),
        (-F.col("_f.neg")).alias("mean_abs_contribution"),
    )


def top_contributions(scored: DataFrame, n: int = 5, keys: list[str] = KEYS) -> DataFrame:
    """The ``n`` largest contributions per scored row, with rank and direction."""
    if n < 1:
        raise ValueError("top_n must be at least 1.")
    ordered = F.array_sort(
        F.transform(
            "contributions",
            lambda c: F.struct(
                (-F.abs(c["contribution"])).alias("neg"), c["feature"].alias("feature"),
                c["feature_value"].alias("feature_value"), c["contribution"].alias("contribution"),
            ),
        )
    )
    rows = scored.select(*keys, F.posexplode(F.slice(ordered, 1, n)).alias("pos", "_c"))
    c = F.col("_c.contribution")
    direction = F.when(c > 0, "increase").when(c < 0, "decrease").otherwise("neutral")
    return rows.select(
        *keys, (F.col("pos") + 1).alias("rank"), "_c.feature", "_c.feature_value", "_c.contribution",
        direction.alias("direction"),
    )


def additivity(scored: DataFrame, base_value: float, keys: list[str] = KEYS) -> DataFrame:
    """Base value plus all contributions per row, which must equal the prediction."""
    total = F.aggregate("contributions", F.lit(float(base_value)), lambda acc, c: acc + c["contribution"])
    return scored.select(
        *keys, F.size("contributions").alias("features"), F.lit(float(base_value)).alias("base_value"),
        total.alias("total"),
    )
