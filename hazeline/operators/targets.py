"""Trailing means, current AQI, future targets and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.functions import aqi
from hazeline.functions.exact import exact
from hazeline.operators.grid import (
    BLOCK_HOURS,
    at_hour,
    block_window,
    drop_halo,
    full_window,
    quarantine_gaps,
    require_continuous,
    with_halo,
)
from hazeline.schema import HORIZONS, KEYS, TARGETS, all_present, epoch_hours, epoch_seconds, hours, require_columns

MEAN_HOURS = 24
AQI_COLUMNS = ["pm2_5_24h_mean", "pm10_24h_mean", "pm2_5_aqi", "pm10_aqi", "aqi_current", "aqi_category",
               "dominant_pollutant"]


def trailing_means(df: DataFrame, window=None) -> DataFrame:
    """24-hour means of both particulates, full windows only, from exact sums."""
    if window is None:
        return drop_halo(trailing_means(with_halo(df, MEAN_HOURS - 1), block_window()))
    cols = {}
    for p in ("pm2_5", "pm10"):
        value = exact(F.col(p))
        cols[f"{p}_24h_mean"] = full_window(
            value, MEAN_HOURS, window, lambda frame, v=value: F.sum(v).over(frame).cast("double") / F.lit(24.0)
        )
    return df.withColumns(cols)


#: Readings up to here surely give an index; larger ones only make ``recent_rows`` keep more.
SURE_READING = 10_000


def recent_rows(df: DataFrame, keep: int = 1, lookback: int = MEAN_HOURS - 1) -> DataFrame:
    """The rows of a panel from which each city's ``keep`` newest hours with an AQI follow, and all rows behind them.

    Each (city, day) is one number with a bit per usable hour, so what is shuffled and ordered are days. An hour has an AQI where it ends 24
    set bits; the days of the newest ``keep`` such hours give the city's start, and ``lookback`` hours before it are what the windows need.
    At most 23 hours more than needed are kept. A city with fewer such hours, with a repeated hour or with times off the hour keeps all its rows.
    """
    t, one = epoch_hours(F.col("timestamp")), F.lit(1).cast("long")
    bit = F.call_function("shiftleft", one, F.pmod(t, F.lit(24)).cast("int"))
    usable = F.coalesce(F.col("pm2_5").between(0, SURE_READING) & F.col("pm10").between(0, SURE_READING), F.lit(False))
    days = df.groupBy("city", F.floor(t / 24).alias("_day")).agg(
        F.bit_or(F.when(usable, bit).otherwise(F.lit(0).cast("long"))).alias("_bits"),
        ((F.count("*") == F.bit_count(F.bit_or(bit))) & (F.count_if(F.pmod(epoch_seconds(F.col("timestamp")), F.lit(3600)) != 0) == 0)).alias("_regular"))
    in_time = Window.partitionBy("city").orderBy("_day")
    before = F.coalesce(F.when(F.lag("_day").over(in_time) == F.col("_day") - 1, F.lag("_bits").over(in_time)), F.lit(0).cast("long"))
    run = before.bitwiseOR(F.shiftleft("_bits", 24))
    days = days.withColumn("_run1", run)
    for n in (1, 2, 4, 8):  # bit j of the 2n-th: hours j to j + 2n - 1 are all usable
        days = days.withColumn(f"_run{2 * n}", F.col(f"_run{n}").bitwiseAND(F.shiftright(f"_run{n}", n)))
    whole = F.col("_run16").bitwiseAND(F.shiftright("_run8", 16))
    days = days.select("city", "_day", "_regular", F.bit_count(F.shiftright(whole, 1)).alias("_n"))
    backwards = Window.partitionBy("city").orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, 0)
    starts = days.withColumn("_behind", F.sum("_n").over(backwards)).groupBy("city").agg(
        F.max(F.when(F.col("_behind") >= keep, F.col("_day") * 24)).alias("_day_start"), F.bool_and("_regular").alias("_regular"))
    starts = starts.select("city", F.when(F.col("_regular"), F.col("_day_start") - lookback).alias("_from"))
    return df.join(starts, "city", "left").where(F.coalesce(t >= F.col("_from"), F.lit(True))).select(*df.columns)


def current_aqi(df: DataFrame, strict: bool = False) -> DataFrame:
    """Sub-indices, index, category and dominant pollutant from the trailing means."""
    df = df.withColumns(
        {
            "pm2_5_aqi": aqi.pm25_index(F.col("pm2_5_24h_mean"), strict),
            "pm10_aqi": aqi.pm10_index(F.col("pm10_24h_mean"), strict),
        }
    )
    p25, p10 = F.col("pm2_5_aqi"), F.col("pm10_aqi")
    both = p25.isNotNull() & p10.isNotNull()
    df = df.withColumns(
        {
            "pm2_5_aqi": F.when(both, p25),
            "pm10_aqi": F.when(both, p10),
            "aqi_current": aqi.overall_index(p25, p10),
            "dominant_pollutant": aqi.dominant_pollutant(p25, p10),
        }
    )
    return df.withColumn("aqi_category", aqi.category(F.col("aqi_current")))


def future_targets(df: DataFrame, window=None) -> DataFrame:
    """AQI 24, 48 and 72 hours ahead."""
    if window is None:
        return drop_halo(future_targets(with_halo(df, 0, max(HORIZONS)), block_window()))
    return df.withColumns({f"target_aqi_{h}h": at_hour("aqi_current", -h, window) for h in HORIZONS})


def gate(df: DataFrame, on_gap: str) -> DataFrame:
    """``raise``: gaps fail now; ``quarantine``: drop the cities that have them; ``trust``: no check,
    a value that a gap touches is NULL."""
    if on_gap == "raise":
        return require_continuous(df)
    if on_gap == "quarantine":
        return quarantine_gaps(df)[0]
    if on_gap == "trust":
        return df
    raise ValueError(f"unknown gap policy {on_gap!r}")


def require_particulates(df: DataFrame) -> DataFrame:
    """Empty input, missing cells and negative concentrations are errors."""
    require_columns(df, ["city", "timestamp", "pm2_5", "pm10"], "AQI input")
    bad = df.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("city").isNull() | F.col("timestamp").isNull()
                   | aqi.nan_to_null(F.col("pm2_5")).isNull() | aqi.nan_to_null(F.col("pm10")).isNull()).alias("nulls"),
        F.count_if(F.col("pm2_5") < 0).alias("neg25"),
        F.count_if(F.col("pm10") < 0).alias("neg10"),
    ).first()
    if bad["n"] == 0:
        raise ValueError("Input dataframe cannot be empty.")
    if bad["nulls"]:
        raise ValueError("Required AQI target columns contain missing values.")
    if bad["neg25"] or bad["neg10"]:
        raise ValueError(f"{'PM2.5' if bad['neg25'] else 'PM10'} contains negative concentrations.")
    return df


def build_targets(
    df: DataFrame, on_gap: str = "trust", drop_incomplete: bool = False, block_hours: int = BLOCK_HOURS
) -> DataFrame:
    """W1-W3 in one shuffle: the two windows share their partitioning and order."""
    require_columns(df, ["city", "timestamp", "pm2_5", "pm10"], "AQI input")
    blocked = with_halo(gate(df, on_gap), MEAN_HOURS - 1, max(HORIZONS), block_hours)
    w = block_window()
    out = drop_halo(future_targets(current_aqi(trailing_means(blocked, w)), w))
    return complete_targets(out) if drop_incomplete else out


def build_aqi(df: DataFrame, on_gap: str = "trust", block_hours: int = BLOCK_HOURS) -> DataFrame:
    """W1-W2 without targets, which needs no look-ahead copies."""
    blocked = with_halo(gate(df, on_gap), MEAN_HOURS - 1, 0, block_hours)
    return drop_halo(current_aqi(trailing_means(blocked, block_window())))


def complete_targets(df: DataFrame) -> DataFrame:
    """W4."""
    return df.where(all_present(["aqi_current", *TARGETS]))


def build_summary(df: DataFrame, drop_incomplete: bool = False) -> DataFrame:
    """Counts over a target panel that still holds its incomplete rows."""
    known = F.col("aqi_current").isNotNull()
    all_targets = known & F.lit(True)
    targets = F.lit(True)
    for t in TARGETS:
        targets = targets & F.col(t).isNotNull()
    complete = all_targets & targets
    return df.agg(
        F.count("*").alias("input_rows"),
        (F.count_if(complete) if drop_incomplete else F.count("*")).alias("output_rows"),
        F.count_distinct("city").alias("cities"),
        F.count_if(known).alias("rows_with_current_aqi"),
        F.count_if(targets).alias("rows_with_all_targets"),
    )


def target_alignment(df: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Per horizon, targets that differ from the AQI actually found at that hour. All rows, not a sample."""
    later = df.select("city", F.col("timestamp").alias("_at"), F.col("aqi_current").alias("_expected"))
    long = df.unpivot(KEYS, TARGETS, "target", "value").where(F.col("value").isNotNull())
    long = long.withColumn("horizon_hours", F.regexp_extract("target", r"(\d+)", 1).cast("int"))
    due = long.withColumn("_at", F.col("timestamp") + F.make_interval(hours=F.col("horizon_hours")))
    wrong = F.coalesce(F.abs(F.col("value") - F.col("_expected")) > tolerance, F.lit(True))
    return (
        due.join(later, ["city", "_at"], "left")
        .groupBy("horizon_hours")
        .agg(F.count("*").alias("checked"), F.count_if(wrong).alias("mismatches"))
    )


def _span(df: DataFrame) -> DataFrame:
    return df.groupBy("city").agg(F.min("timestamp").alias("_start"), F.max("timestamp").alias("_end"))


def boundary_leaks(df: DataFrame) -> DataFrame:
    """Targets present in the last h rows of a city, which can only come from another city.

    On the hourly grid "the last h rows" are the rows later than ``end - h hours``: two joins-free aggregates per city
    instead of a ranking over its whole history.
    """
    tail = df.join(_span(df), "city")
    checks = [
        F.count_if((F.col("timestamp") > F.col("_end") - hours(h)) & F.col(f"target_aqi_{h}h").isNotNull()).alias(
            f"leaks_{h}h"
        )
        for h in HORIZONS
    ]
    return tail.groupBy("city").agg(*checks)


def warm_up(df: DataFrame) -> DataFrame:
    """AQI values before the 24th hour, and whether the 24th hour has one."""
    rows = df.join(_span(df), "city")
    first = F.col("_start") + hours(MEAN_HOURS - 1)
    known = F.col("aqi_current").isNotNull()
    return rows.groupBy("city").agg(
        F.count_if((F.col("timestamp") < first) & known).alias("early_aqi"),
        F.count_if((F.col("timestamp") == first) & known).alias("first_aqi"),
    )


def feature_warm_up(source: DataFrame, features: DataFrame, lag_hours: int = 72) -> DataFrame:
    """First usable feature hour per city against start + 72 h."""
    first = features.groupBy("city").agg(F.min("timestamp").alias("first_usable"))
    out = source.groupBy("city").agg(F.min("timestamp").alias("source_start")).join(first, "city", "left")
    ok = F.coalesce(F.col("first_usable") >= F.col("source_start") + hours(lag_hours), F.lit(False))
    return out.withColumn("passed", ok)
