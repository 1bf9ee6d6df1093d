"""Q1-Q3: scaled sliding sequences for sequence models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.operators.grid import BLOCK_HOURS, block_window, drop_halo, with_halo
from hazeline.operators.quality import duplicate_keys, healthy
from hazeline.schema import BASE_FEATURES, KEYS, epoch_seconds, one_row, require_columns

SEQUENCE_LENGTH = 72


def fit_scaler(train: DataFrame, features: list[str] = BASE_FEATURES, validate: bool = True) -> DataFrame:
    """Q1: (feature, mean, scale) from training rows only; population spread, and a constant column scales by 1."""
    require_columns(train, features, "training rows")
    if validate and train.where(~healthy(features)).limit(1).count():
        raise ValueError("Training features contain NaN or infinite values.")
    wide = train.agg(
        *[
            F.struct(
                F.avg(F.col(c).cast("double")).alias("mean"), F.stddev_pop(F.col(c).cast("double")).alias("spread"),
                F.min(F.col(c).cast("double")).alias("low"), F.max(F.col(c).cast("double")).alias("high"),
            ).alias(c)
            for c in features
        ]
    )
    long = wide.unpivot([], features, "feature", "_s")
    constant = F.col("_s.low") == F.col("_s.high")
    return long.select(
        "feature", F.when(constant, F.col("_s.low")).otherwise(F.col("_s.mean")).alias("mean"),
        F.when(constant, F.lit(1.0)).otherwise(F.col("_s.spread")).alias("scale"),
    )


def scaler_map(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    """The fitted numbers (two per feature) as literals for expressions."""
    return {r["feature"]: (r["mean"], r["scale"]) for r in scaler.collect()}


def build_sequences(
    df: DataFrame,
    target: str,
    scaler: dict[str, tuple[float, float]],
    length: int = SEQUENCE_LENGTH,
    features: list[str] = BASE_FEATURES,
    block_hours: int = BLOCK_HOURS,
) -> DataFrame:
    """Q2: ``seq`` holds the last ``length`` scaled rows, ``y`` the target at the window end.

    A window is skipped when it has a gap, a non-finite value or no target. Rows travel as one array of scaled values,
    and windows are cut inside time blocks.
    """
    require_columns(df, [*KEYS, *features, target], "sequence input")
    scaled = F.array(*[((F.col(c).cast("double") - scaler[c][0]) / scaler[c][1]).cast("float") for c in features])
    y = F.col(target).cast("double")
    rows = df.select(*KEYS, scaled.alias("_x"), healthy(features).alias("_ok"), y.alias("y"))
    w = block_window()
    frame = w.rowsBetween(-(length - 1), 0)
    whole = (
        (F.count("*").over(frame) == length)
        & (F.min(F.col("_ok").cast("int")).over(frame) == 1)
        & (epoch_seconds(F.col("timestamp")) - epoch_seconds(F.lag("timestamp", length - 1).over(w)) == (length - 1) * 3600)
        & (F.count_if(F.col("_step") == 3600).over(w.rowsBetween(-(length - 2), 0)) == length - 1)
        if length > 1
        else F.col("_ok")
    )
    step = epoch_seconds(F.col("timestamp")) - epoch_seconds(F.lag("timestamp", 1).over(w))
    blocked = with_halo(rows, length, 0, block_hours).withColumn("_step", step)
    # The test columns are computed first so that arrays are gathered in the same window pass and dropped if unusable.
    out = blocked.withColumns({"_whole": whole, "seq": F.collect_list("_x").over(frame)})
    usable = F.col("_whole") & F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") != float("inf"))
    return drop_halo(out.where(usable)).select(*KEYS, "seq", F.col("y"))


def sequence_counts(sequences: DataFrame, source: DataFrame, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """Q3: sequences found against ``rows - (length-1) * cities``, and repeated sequence keys."""
    per_source = source.agg(F.count("*").alias("source_rows"), F.count_distinct("city").alias("cities"))
    out = one_row(per_source, sequences.agg(F.count("*").alias("sequences")), duplicate_keys(sequences, KEYS))
    expected = F.col("source_rows") - (length - 1) * F.col("cities")
    return out.withColumn("expected", expected).withColumn(
        "passed", (F.col("sequences") == F.col("expected")) & (F.col("duplicates") == 0)
    )
