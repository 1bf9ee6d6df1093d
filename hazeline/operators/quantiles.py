"""Exact quantiles that do not gather a group in one task.

The built-in exact percentile keeps every distinct value of a group in one aggregation buffer. Two replacements:

* ``bounded_quantiles`` for values from a small fixed domain (the index is an integer from 0 to 500): counting first
  leaves at most one row per value, so the buffer is bounded.
* ``exact_quantiles`` for free values: a mergeable sketch locates a narrow value interval around each wanted rank, one
  further aggregate counts what lies below it. The interval is cut into cells of equal width; counts per cell, summed up,
  tell which cell holds the rank, and only the values of that cell are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SKETCH_ACCURACY = 100_000
#: Half widths of the intervals around a rank, as shares of a group: the narrowest that spans ``LEAST_RANKS`` rows is used, so that
#: the neighbouring ranks of an interpolation are inside however few rows there are.
RANK_MARGINS = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)
LEAST_RANKS = 3
#: Cells of an interval. A task orders the values of one cell, about ``2 * RANK_MARGINS[0] / CELLS`` of a large group.
CELLS = 4096


def bounded_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], out: str = "quantiles"):
    """Linear quantiles of a small-domain column, as one array per group."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counted.groupBy(*keys).agg(F.percentile(F.col(value), F.array(*map(F.lit, probs)), F.col("_n")).alias(out))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], out: str = "quantiles"):
    """Linear quantiles of any numeric column, as one array per group in the order of ``probs``."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    edges = [[max(p - m, 0.0) for p in probs] + [min(p + m, 1.0) for p in probs] for m in RANK_MARGINS]
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), *[F.percentile_approx("_v", e, SKETCH_ACCURACY).alias(f"_s{j}") for j, e in enumerate(edges)]
    )
    near_enough = F.col(f"_s{len(edges) - 1}")
    for j in range(len(edges) - 2, -1, -1):
        near_enough = F.when(F.col("_n") * RANK_MARGINS[j] >= LEAST_RANKS, F.col(f"_s{j}")).otherwise(near_enough)
    sketch = sketch.withColumn("_s", near_enough)
    wanted = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("_n") - 1)
        wanted.append(
            F.struct(
                F.lit(i).alias("i"),
                F.col("_s")[i].alias("low"),
                F.col("_s")[i + len(probs)].alias("high"),
                F.floor(position).alias("k0"),
                F.ceil(position).alias("k1"),
                (position - F.floor(position)).alias("part"),
            )
        )
    plan = sketch.select(*keys, F.array(*wanted).alias("_w"))
    counted = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    # Rows below an interval fall together into one NULL-valued row per group and rank.
    near = counted.join(plan, keys) if keys else _attach(counted, plan)
    near = near.select(
        *keys, "_v", "_c", F.explode(F.filter("_w", lambda w: F.col("_v") <= w["high"])).alias("w")
    ).withColumn("_v", F.when(F.col("_v") >= F.col("w.low"), F.col("_v")))
    near = near.groupBy(*keys, "w", "_v").agg(F.sum("_c").alias("_c"))
    width = F.col("w.high") - F.col("w.low")
    cell = F.least(F.lit(CELLS - 1), F.floor((F.col("_v") - F.col("w.low")) / width * CELLS).cast("int"))
    near = near.select(
        *keys, "w.i", "w.k0", "w.k1", "w.part", "_v", "_c",
        F.when(F.col("_v").isNull(), -1).when(width > 0, cell).otherwise(0).alias("_cell"),
    )

    def holds(k, before, count):
        return (before <= F.col(k)) & (F.col(k) < before + count)

    cells = near.groupBy(*keys, "i", "k0", "k1", "_cell").agg(F.sum("_c").alias("_n"))
    below = F.sum("_n").over(Window.partitionBy(*keys, "i").orderBy("_cell")) - F.col("_n")
    cells = cells.withColumn("_below", below)
    cells = cells.where(holds("k0", F.col("_below"), F.col("_n")) | holds("k1", F.col("_below"), F.col("_n")))
    inside = near.join(cells.select(*keys, "i", "_cell", "_below"), [*keys, "i", "_cell"])
    upto = F.sum("_c").over(
        Window.partitionBy(*keys, "i", "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = inside.withColumn("_before", F.col("_below") + upto - F.col("_c"))

    def at(k):
        return F.max(F.when(holds(k, F.col("_before"), F.col("_c")), F.col("_v")))

    picked = ranked.groupBy(*keys, "i").agg(at("k0").alias("v0"), at("k1").alias("v1"), F.max("part").alias("part"))
    # The sketch errs by a tenth of the narrowest margin at most, so every rank is inside its interval.
    missed = F.col("v0").isNull() | F.col("v1").isNull()
    q = F.when(missed, F.raise_error(F.lit("quantile rank outside its located interval")).cast("double")).otherwise(
        F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("part")
    )
    return picked.withColumn("q", q).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias(out)
    )


def _attach(rows: DataFrame, single: DataFrame) -> DataFrame:
    """Key-less case: one literal key on both sides of an ordinary broadcast join with a one-row table."""
    left = rows.withColumn("_k", F.lit(1))
    return left.join(F.broadcast(single.withColumn("_k", F.lit(1))), "_k").drop("_k")
