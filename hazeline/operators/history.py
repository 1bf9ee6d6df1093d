"""H1-H7: keeping the live history, for all cities in one job.

Every step splits its input into accepted rows and refused rows with a reason, so that one city's bad data does not
stop the others.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.operators.quality import history_health
from hazeline.operators.relational import completed_hours, dedupe, newest_hours, one_to_one
from hazeline.schema import HISTORY_COLUMNS, KEYS, epoch_hours

BOOTSTRAP_HOURS = 120
KEPT_HOURS = 168
MINIMUM_HOURS = 97
LIVE_SOURCE = "openweather_live"
BOOTSTRAP_SOURCE = "open_meteo_bootstrap"

# Which source wins when two describe the same hour; unknown sources count as 0.
SOURCE_PRIORITY = {"open_meteo_bootstrap": 0, "openmeteo_bootstrap": 0, "openweather_live": 1}


def source_priority(source: Column) -> Column:
    chain = reduce(
        lambda c, item: c.when(source == item[0], F.lit(item[1])), list(SOURCE_PRIORITY.items())[1:],
        F.when(source == next(iter(SOURCE_PRIORITY)), F.lit(0)),
    )
    return chain.otherwise(F.lit(0))


def bootstrap(
    weather: DataFrame, pollution: DataFrame, cities: DataFrame, as_of, hours: int = BOOTSTRAP_HOURS,
    existing: DataFrame | None = None, validate: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """H1: (history, refused cities) from landed hourly payload rows; cities that already have a history are skipped."""
    if hours < MINIMUM_HOURS:
        raise ValueError(f"at least {MINIMUM_HOURS} raw hourly observations are required")
    if existing is not None:
        known = existing.select("city").distinct()
        weather, pollution = weather.join(known, "city", "left_anti"), pollution.join(known, "city", "left_anti")
    merged = one_to_one(weather, pollution, KEYS, validate)
    merged = merged.join(cities, "city").withColumn("source", F.lit(BOOTSTRAP_SOURCE))
    recent = newest_hours(completed_hours(merged.select(*HISTORY_COLUMNS), as_of), hours)
    health = history_health(recent, hours).select("city", "valid", "reasons")
    good = recent.join(health.where("valid").select("city"), "city", "left_semi").select(*HISTORY_COLUMNS)
    return good, health.where(~F.col("valid")).select("city", "reasons")


def _best_hours(rows: DataFrame, keep: int) -> DataFrame:
    """One row per (city, hour): a reading before stored rows, the newest reading first, then the source that wins; newest hours only."""
    best = dedupe(rows, KEYS, [F.col("_reading"), F.col("_observed"), source_priority(F.col("source")), F.col("source")])
    return newest_hours(best.select(*HISTORY_COLUMNS), keep)


def recover_gap(existing: DataFrame, recovered: DataFrame, keep: int = KEPT_HOURS) -> DataFrame:
    """H3: recovered rows replace the history; live rows inside the recovered span win their hour.

    A city without recovered rows keeps what it has; its readings are then refused by H4, which names it.
    """
    rows = _tagged(existing, recovered, None)
    spans = rows.groupBy("city").agg(
        F.min(F.when(F.col("_kind") == _RECOVERED, F.col("timestamp"))).alias("_first"),
        F.max(F.when(F.col("_kind") == _RECOVERED, F.col("timestamp"))).alias("_last"))
    held = F.col("_first").isNull() | (F.col("_kind") == _RECOVERED) | _live_inside()
    return _best_hours(rows.join(spans, "city").where(held), keep)


_STORED, _RECOVERED, _READING = 0, 1, 2


def _observed(df: DataFrame) -> Column:
    """When a reading was taken, if it says so; two readings of one hour are ordered by it."""
    return F.col("observed_at").cast("timestamp") if "observed_at" in df.columns else F.col("timestamp").cast("timestamp")


def _tagged(history: DataFrame, recovered: DataFrame | None, readings: DataFrame | None) -> DataFrame:
    """All rows in one frame with where they come from; a reading's hour is that of its time."""
    parts = [history.select(*HISTORY_COLUMNS, F.lit(_STORED).alias("_kind"), F.lit(None).cast("timestamp").alias("_observed"))]
    if recovered is not None:
        parts.append(recovered.select(*HISTORY_COLUMNS, F.lit(_RECOVERED).alias("_kind"), F.lit(None).cast("timestamp").alias("_observed")))
    if readings is not None:
        hour = F.date_trunc("hour", F.col("timestamp")).cast(readings.schema["timestamp"].dataType).alias("timestamp")
        columns = [hour if c == "timestamp" else F.col(c) for c in HISTORY_COLUMNS]
        parts.append(readings.select(*columns, F.lit(_READING).alias("_kind"), _observed(readings).alias("_observed")))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.withColumn("_reading", (F.col("_kind") == _READING).cast("int"))


def _live_inside() -> Column:
    return ((F.col("_kind") == _STORED) & (F.col("source") == LIVE_SOURCE)
            & F.col("timestamp").between(F.col("_first"), F.col("_last")))


def _route(latest: Column, reading: Column) -> Column:
    gap = epoch_hours(reading) - epoch_hours(latest)
    return F.when(latest.isNull(), "bootstrap").when(gap > 1, "recover").otherwise("upsert")


def merge(history: DataFrame, recovered: DataFrame | None, readings: DataFrame, keep: int = KEPT_HOURS) -> tuple[DataFrame, DataFrame]:
    """H3-H5 as one merge: (new history, refused readings with ``latest_history`` and ``reason``).

    One aggregate gives each city's newest stored hour, newest reading and recovered span, and with them its route. Rows that the
    route holds, and readings up to the end of the contiguous run behind the newest held hour, meet in one maximum per (city, hour).
    A run is found as an island: behind the newest held hour, the n-th distinct hour is n hours later (a city's reading hours are one array,
    which time bounds: 8,766 a year). So a catch-up of several hours is accepted, and only what lies behind a hole is refused, as ``gap``; a city that needed rows and got none is ``no_recovery``.
    """
    rows = _tagged(history, recovered, readings)

    def at(kind, f):
        return f(F.when(F.col("_kind") == kind, F.col("timestamp")))

    spans = rows.groupBy("city").agg(at(_STORED, F.max).alias("_latest"), at(_READING, F.max).alias("_fresh"),
                                     at(_RECOVERED, F.min).alias("_first"), at(_RECOVERED, F.max).alias("_last"),
                                     F.collect_set(F.when(F.col("_kind") == _READING, epoch_hours(F.col("timestamp")))).alias("_hours"))
    route = F.when(F.col("_fresh").isNull(), "upsert").otherwise(_route(F.col("_latest"), F.col("_fresh")))
    if recovered is None:
        route = F.lit("upsert")
    spans = spans.withColumn("_route", route)
    repaired = (F.col("_route") != "upsert") & F.col("_last").isNotNull()
    spans = spans.withColumns({"_repaired": repaired, "_end": F.when(repaired, F.col("_last")).otherwise(F.col("_latest"))})
    # Behind the newest held hour, the n-th reading hour lies n hours later as long as the run goes on; differences never fall again.
    behind = F.filter(F.array_sort("_hours"), lambda h: h > epoch_hours(F.col("_end")))
    holes = F.transform(behind, lambda h, i: h - epoch_hours(F.col("_end")) - i - 1)
    spans = spans.withColumn("_run", F.size(F.filter(holes, lambda x: x == 0))).drop("_hours")
    known = rows.join(spans, "city").withColumn("_ahead", epoch_hours(F.col("timestamp")) - epoch_hours(F.col("_end")))
    accepted = F.coalesce(F.col("_ahead") <= F.col("_run"), F.lit(False))
    held = (F.when(F.col("_kind") == _READING, accepted).when(F.col("_kind") == _RECOVERED, F.col("_repaired"))
            .otherwise(~F.col("_repaired") | _live_inside()))
    reason = F.when((F.col("_route") != "upsert") & ~F.col("_repaired") | F.col("_end").isNull(), "no_recovery").otherwise("gap")
    refused = known.where((F.col("_kind") == _READING) & ~accepted).select(
        *HISTORY_COLUMNS, F.col("_end").alias("latest_history"), reason.alias("reason"))
    return _best_hours(known.where(held), keep), refused


def upsert(history: DataFrame, readings: DataFrame, keep: int = KEPT_HOURS) -> tuple[DataFrame, DataFrame]:
    """H4: (history with the readings, readings refused because hours in between are still missing).

    A reading replaces the row of its hour, the newest of several (by ``observed_at``, if readings have it). Hours that follow one another
    behind the newest stored hour are all accepted.
    """
    return merge(history, None, readings, keep)


def routes(history: DataFrame, readings: DataFrame) -> DataFrame:
    """H5: what each city needs: ``bootstrap`` (no history), ``recover`` (more than an hour behind) or ``upsert``."""
    stored = history.groupBy("city").agg(F.max("timestamp").alias("latest_history"))
    fresh = readings.groupBy("city").agg(F.max("timestamp").alias("reading"))
    gap = epoch_hours(F.col("reading")) - epoch_hours(F.col("latest_history"))
    return fresh.join(stored, "city", "left").withColumns(
        {"gap_hours": gap.cast("long"), "route": _route(F.col("latest_history"), F.col("reading"))})


def refresh(
    history: DataFrame, readings: DataFrame, recovered: DataFrame, keep: int = KEPT_HOURS
) -> tuple[DataFrame, DataFrame]:
    """H5: all cities in one pass. ``recovered`` holds landed history rows for cities that need them.

    Bootstrapped cities start from their recovered rows; cities with a gap merge them (H3); then every reading is
    upserted (H4). The route is a column decided per city, not a loop over cities.
    """
    return merge(history, recovered, readings, keep)


def checked(history: DataFrame, minimum: int = MINIMUM_HOURS) -> tuple[DataFrame, DataFrame]:
    """The check after an upsert: (cities whose history is acceptable, the others with the reasons)."""
    health = history_health(history, minimum).select("city", "valid", "reasons")
    good = history.join(health.where("valid").select("city"), "city", "left_semi").select(*HISTORY_COLUMNS)
    return good, health.where(~F.col("valid")).select("city", "reasons")


def newest_source(history: DataFrame) -> DataFrame:
    """H7: the source label of each city's newest row, ``unknown`` if absent."""
    return history.groupBy("city").agg(
        F.coalesce(F.max_by("source", "timestamp"), F.lit("unknown")).alias("source"), F.max("timestamp").alias("timestamp")
    )


def _named(bad: DataFrame) -> str:
    """A few of the refused cities and how many there are."""
    first = bad.orderBy("city").limit(20).collect()
    return f"history of {bad.count()} cities refused: " + "; ".join(f"{r['city']}: {', '.join(r['reasons'])}" for r in first)


def validated(history: DataFrame, minimum: int = MINIMUM_HOURS) -> DataFrame:
    """H6: fail unless every city's history is acceptable."""
    bad = history_health(history, minimum).where(~F.col("valid"))
    if not bad.isEmpty():
        raise ValueError(_named(bad))
    return history


_COMMIT = "version long, folder string"


def _newest_version(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and folder of the newest published version; 0 where there is none."""
    try:
        commits = spark.read.schema(_COMMIT).option("recursiveFileLookup", "true").parquet(f"{path}/commits")
        row = commits.agg(F.max(F.struct("version", "folder")).alias("newest")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, None
    return (row.newest.version, f"{path}/{row.newest.folder}") if row.newest else (0, None)


def save(history: DataFrame, path: str, validate: bool = True, minimum: int = MINIMUM_HOURS) -> int:
    """H6: publish a new version, in which the cities given replace their stored rows and all others stay; returns its number.

    Files are cut by ranges of (city, hour), so a long history of one city is many tasks' work. The version's files are written and
    validated first; only then a commit names them, so readers see whole, accepted versions alone. All refused cities of a failed
    version are written beside it (``refused/``). Versions are published one after the other: a number that is taken already is an error.
    """
    spark = history.sparkSession
    number, folder = _newest_version(spark, path)
    rows = history.select(*HISTORY_COLUMNS)
    if folder:
        stored = spark.read.parquet(folder).join(rows.select("city").distinct(), "city", "left_anti")
        rows = rows.unionByName(stored.select(*HISTORY_COLUMNS))
    number += 1
    name = f"{number:012d}-{uuid.uuid4().hex[:12]}"
    rows.repartitionByRange("city", "timestamp").sortWithinPartitions("city", "timestamp").write.parquet(f"{path}/data/{name}")
    if validate:
        health = history_health(spark.read.parquet(f"{path}/data/{name}"), minimum)
        health.where(~F.col("valid")).select("city", "reasons").write.parquet(f"{path}/refused/{name}")
        bad = spark.read.parquet(f"{path}/refused/{name}")
        if not bad.isEmpty():
            raise ValueError(_named(bad))
    spark.createDataFrame([(number, f"data/{name}")], _COMMIT).write.mode("error").parquet(f"{path}/commits/{number:012d}")
    return number


def load(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """H6: the newest published version."""
    _, folder = _newest_version(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no history has been published at {path}")
    history = spark.read.parquet(folder).select(*HISTORY_COLUMNS)
    return validated(history) if validate else history
