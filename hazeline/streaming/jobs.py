"""The hourly loop as Structured Streaming jobs.

Sources and sinks are files in the shared folder; state and progress live in its checkpoint, so a job survives the loss
of executors and restarts where it stopped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from hazeline.operators.history import KEPT_HOURS, LIVE_SOURCE, upsert
from hazeline.operators.ledger import SCORED, scores
from hazeline.operators.relational import dedupe, newest_hours
from hazeline.operators.targets import current_aqi
from hazeline.schema import HISTORY_COLUMNS, KEYS, LEDGER_COLUMNS, LEDGER_KEYS, LEDGER_SCHEMA, POLLUTANTS, WEATHER, epoch_hours
from hazeline.session import work_dir


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1000):
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def run_to_end(query_writer, checkpoint: str):
    """Process everything that has arrived, then stop."""
    query = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


# T1 ---------------------------------------------------------------------------------------------------------------


def read_versions(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def latest_readings(versions: DataFrame) -> DataFrame:
    """State of an append-only reading table: the newest observation of each (city, hour)."""
    return dedupe(versions, KEYS, [F.col("observed_at"), F.col("reading_id")])


def hourly_readings(readings: DataFrame, path: str, checkpoint: str, id_column: str = "reading_id"):
    """Readings stream to an append-only hourly table.

    ``readings`` has city, observed_at (TIMESTAMP), the reading's id and its values. Each batch is reduced to one newest row per
    (city, hour) before it is written, and readers take the newest version (``latest_readings``): a later reading of the hour
    replaces an earlier one, and a repeated delivery is the same version again. Nothing waits for a watermark, so rows count however
    late they come and however the input is cut into files and batches. Batches write to their own folder, which makes a repeated
    batch overwrite itself.
    """
    bucketed = readings.withColumn("timestamp", F.date_trunc("hour", F.col("observed_at")))

    def store(batch: DataFrame, batch_id: int) -> None:
        newest = dedupe(batch, KEYS, [F.col("observed_at"), F.col(id_column)])
        newest.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run_to_end(bucketed.writeStream.foreachBatch(store), checkpoint)


# T2 ---------------------------------------------------------------------------------------------------------------

HOURLY_SQL = "city string, timestamp timestamp, pm2_5 {pm2_5}, pm10 {pm10}, observed_at timestamp, day date, batch long"
MEAN_HOURS = 24
#: Which version of an hour counts: the one observed last, whatever batch brought it; without such a time the largest values.
HOUR_ORDER = ["observed_at", "pm2_5", "pm10"]


def _versions(spark: SparkSession, path: str, schema: str, hours_of: DataFrame) -> DataFrame:
    """Newest version of each (city, hour) among the days that ``hours_of`` (city, day) names: partition pruning by day."""
    stored = spark.read.schema(schema).parquet(path)
    stored = stored.join(hours_of.select("city", "day").distinct(), ["city", "day"], "left_semi")
    return dedupe(stored, KEYS, HOUR_ORDER).drop("batch", "day")


def trailing_aqi(hourly: DataFrame, path: str, checkpoint: str):
    """Trailing 24-hour AQI per city from an hourly stream (city, timestamp, pm2_5, pm10), as files under ``path``/aqi.

    An hour may come again with other values; rows with an ``observed_at`` are ordered by it, in one batch as across batches. Each batch first stores its hours. A new or revised hour changes the trailing means of itself and the 23 hours behind it: these
    are computed anew from the stored hours and written as a version of this batch. Readers take the newest version
    (``latest_trailing_aqi``). So late, revised and newest hours all count, and the result is that of one run over all rows.
    """
    types = dict(hourly.dtypes)
    schema = HOURLY_SQL.format(**types)
    ahead = F.sequence(F.lit(0), F.lit(MEAN_HOURS - 1))

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = F.col("observed_at") if "observed_at" in batch.columns else F.col("timestamp")
        hours_in = dedupe(batch.select(*KEYS, "pm2_5", "pm10", seen.cast("timestamp").alias("observed_at")), KEYS, HOUR_ORDER)
        hours_in.withColumn("day", F.to_date("timestamp")).write.partitionBy("day").mode("overwrite").parquet(
            f"{path}/hours/batch={batch_id}")
        touched = (hours_in.select("city", F.explode(ahead).alias("k"), "timestamp")
                   .select("city", (F.col("timestamp") + F.make_interval(hours=F.col("k"))).alias("timestamp")).distinct())
        days = touched.select("city", F.explode(F.sequence(
            F.to_date(F.col("timestamp") - F.expr(f"INTERVAL {MEAN_HOURS - 1} HOURS")), F.to_date("timestamp"))).alias("day"))
        known = _versions(spark, f"{path}/hours", schema, days)
        spread = known.select("city", F.explode(ahead).alias("k"), F.col("timestamp").alias("at"), "pm2_5", "pm10").select(
            "city", (F.col("at") + F.make_interval(hours=F.col("k"))).alias("timestamp"), "pm2_5", "pm10")
        means = spread.join(touched, KEYS, "left_semi").groupBy(*KEYS).agg(
            F.count(F.when(F.col("pm2_5").isNotNull() & F.col("pm10").isNotNull(), 1)).alias("hours"),
            (F.sum("pm2_5").cast("double") / F.lit(float(MEAN_HOURS))).alias("pm2_5_24h_mean"),
            (F.sum("pm10").cast("double") / F.lit(float(MEAN_HOURS))).alias("pm10_24h_mean"))
        current_aqi(means.where(F.col("hours") == MEAN_HOURS).drop("hours")).write.mode("overwrite").parquet(
            f"{path}/aqi/batch={batch_id}")

    return run_to_end(hourly.writeStream.foreachBatch(store), checkpoint)


def latest_trailing_aqi(spark: SparkSession, path: str) -> DataFrame:
    """State of a T2 table: the newest version of each (city, hour)."""
    return dedupe(spark.read.parquet(f"{path}/aqi"), KEYS, [F.col("batch")]).drop("batch")


# T3 ---------------------------------------------------------------------------------------------------------------

ACTUALS_SQL = "city_key string, timestamp timestamp, aqi_current double, observed_at timestamp, day date, batch long"
FORECAST_COLUMNS = [c for c in LEDGER_COLUMNS if c not in SCORED]
FORECASTS_SQL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LEDGER_SCHEMA if f.name in FORECAST_COLUMNS)
SCORES_SQL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LEDGER_SCHEMA) + ", observed_at timestamp, day date, batch long"
_FORECAST, _ACTUAL = "forecast", "actual"


def both_kinds(forecasts: DataFrame, actuals: DataFrame) -> DataFrame:
    """The two streams as one, so that a batch and its commit cover both.

    ``forecasts`` are ledger rows (``LEDGER_SCHEMA`` without the scores); ``actuals`` have city, timestamp, aqi_current and, where an hour
    can be revised, ``observed_at``.
    """
    seen = F.col("observed_at") if "observed_at" in actuals.columns else F.col("timestamp")
    made = forecasts.select(F.lit(_FORECAST).alias("kind"), F.struct(*[F.col(c) for c in FORECAST_COLUMNS]).alias("forecast"))
    known = actuals.select(F.lit(_ACTUAL).alias("kind"), F.struct(
        F.lower("city").alias("city_key"), F.col("timestamp").cast("timestamp").alias("timestamp"),
        F.col("aqi_current").cast("double").alias("aqi_current"), seen.cast("timestamp").alias("observed_at")).alias("actual"))
    return made.unionByName(known, allowMissingColumns=True)


def _stored(spark: SparkSession, path: str, schema: str, days: DataFrame, upto: int) -> DataFrame:
    """Rows of a batch-wise table that batches up to ``upto`` wrote, of the days that ``days`` names."""
    rows = spark.read.schema(schema).parquet(path).where(F.col("batch") <= upto)
    return rows.join(days.select("day").distinct(), "day", "left_semi")


def matured_forecasts(forecasts: DataFrame, actuals: DataFrame, path: str, checkpoint: str, now: Column | None = None):
    """Forecasts wait in a table until the AQI of their target hour is known, however late that is.

    A batch first stores its forecasts and actuals by the day of the hour they speak of. It then scores what is new on either side:
    its forecasts against all stored actuals of their days, and all stored forecasts of its actuals' days against these. What is
    scored already from the same observation or a later one is left out by an anti-join. Nothing waits in state and nothing expires.

    A batch writes only folders of its own number and reads those of batches up to it, so a repeated batch overwrites itself.
    Readers take ``latest_scores``: a revised hour scores anew, the newest observation counts, in whatever order files arrive.
    An hour with an observed AQI has come. ``now`` is the time noted as ``evaluated_at``, by default the batch's own.
    """
    at = F.current_timestamp() if now is None else now.cast("timestamp")

    def store(batch: DataFrame, number: int) -> None:
        spark, mine = batch.sparkSession, f"batch={number}"
        day = F.to_date("timestamp")
        known = batch.where(F.col("kind") == _ACTUAL).select("actual.*").where(_finite(F.col("aqi_current")))
        known = dedupe(known, ["city_key", "timestamp"], [F.col("observed_at"), F.col("aqi_current")])
        known.withColumn("day", day).write.partitionBy("day").mode("overwrite").parquet(f"{path}/actuals/{mine}")
        made = batch.where(F.col("kind") == _FORECAST).select("forecast.*")
        made = dedupe(made, LEDGER_KEYS, [F.struct(*[c for c in FORECAST_COLUMNS if c not in LEDGER_KEYS])], keep="first")
        made.withColumn("day", F.to_date("target_timestamp")).write.partitionBy("day").mode("overwrite").parquet(f"{path}/forecasts/{mine}")

        actuals_sql, forecasts_sql = ACTUALS_SQL, FORECASTS_SQL + ", day date, batch long"
        new_actuals = spark.read.schema(actuals_sql.rsplit(", ", 1)[0]).parquet(f"{path}/actuals/{mine}")
        new_forecasts = spark.read.schema(FORECASTS_SQL + ", day date").parquet(f"{path}/forecasts/{mine}")
        days = new_actuals.select("day").union(new_forecasts.select("day")).distinct()
        waiting = _earliest(_stored(spark, f"{path}/forecasts", forecasts_sql, days, number))
        hours = dedupe(_stored(spark, f"{path}/actuals", actuals_sql, days, number).drop("batch"), ["city_key", "timestamp"],
                       [F.col("observed_at"), F.col("aqi_current")])
        due = waiting.withColumn("city_key", F.lower("city")).join(
            hours.select("city_key", F.col("timestamp").alias("target_timestamp"), "aqi_current", "observed_at"), ["city_key", "target_timestamp"])
        if number:
            done = _stored(spark, f"{path}/scored", SCORES_SQL, days, number - 1)
            done = done.groupBy(*LEDGER_KEYS).agg(F.max(F.struct("observed_at", "actual_aqi")).alias("done"))
            keys = [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in LEDGER_KEYS]
            newer = F.struct("d.observed_at", "d.aqi_current") <= F.col("s.done")
            due = due.alias("d").join(done.alias("s"), [*keys, newer], "left_anti")
        scored = scores(due.drop("city_key"), F.col("aqi_current"), at)
        scored.select(*LEDGER_COLUMNS, "observed_at", "day").write.partitionBy("day").mode("overwrite").parquet(f"{path}/scored/{mine}")

    return run_to_end(both_kinds(forecasts, actuals).writeStream.foreachBatch(store), checkpoint)


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _earliest(forecasts: DataFrame) -> DataFrame:
    """One row per ledger key: the one of the first batch that brought it, as a ledger that refuses known keys would hold it."""
    return dedupe(forecasts, LEDGER_KEYS, [F.col("batch")], keep="first").drop("batch")


def latest_scores(spark: SparkSession, path: str) -> DataFrame:
    """State of a T3 table: the scored forecasts, each by the newest observation of its hour."""
    rows = spark.read.schema(SCORES_SQL).parquet(f"{path}/scored")
    return dedupe(rows.drop("day", "batch"), LEDGER_KEYS, [F.col("observed_at"), F.col("actual_aqi")]).drop("observed_at")


def pending_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """The forecasts of a T3 table that wait for their hour."""
    made = _earliest(spark.read.schema(FORECASTS_SQL + ", day date, batch long").parquet(f"{path}/forecasts")).drop("day")
    return made.join(latest_scores(spark, path).select(*LEDGER_KEYS), LEDGER_KEYS, "left_anti")


# T1, second half ---------------------------------------------------------------------------------------------------

_WEATHER, _POLLUTION = "weather", "pollution"


def live_history(weather: DataFrame, pollution: DataFrame, cities: DataFrame, history: DataFrame, path: str, checkpoint: str,
                 keep: int = KEPT_HOURS):
    """Weather and pollution readings paired by city and UTC hour, and the pairs upserted (H4) into the history, batch by batch.

    ``weather`` and ``pollution`` have city, observed_at and their values; ``cities`` city, latitude, longitude; ``history`` is what is stored
    before the first batch. A reading without its counterpart waits in the table: the pair is formed by the batch that brings the
    other one. Of several readings of an hour the newest counts, on either side. Hours behind a hole wait, too, until it is filled.

    A batch writes folders of its own number only (readings by day, accepted pairs) and reads those of batches up to it: repeating it
    changes nothing. Readers take ``live_state``.
    """
    values = {_WEATHER: list(WEATHER), _POLLUTION: list(POLLUTANTS)}
    sides = {_WEATHER: weather, _POLLUTION: pollution}
    types = {kind: ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in values[kind]) for kind, df in sides.items()}
    both = None
    for kind, df in sides.items():
        rows = df.select(F.lit(kind).alias("kind"), "city", F.date_trunc("hour", F.col("observed_at")).alias("timestamp"), "observed_at",
                         F.struct(*values[kind]).alias(kind))
        both = rows if both is None else both.unionByName(rows, allowMissingColumns=True)

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        for kind in sides:
            mine = batch.where(F.col("kind") == kind).select(*KEYS, "observed_at", f"{kind}.*").withColumn("day", F.to_date("timestamp"))
            mine.write.partitionBy("day").mode("overwrite").parquet(f"{path}/{kind}/batch={number}")
        held = live_state(spark, path, history, keep, number - 1)
        # Readings that can still change the history: those of its hours and behind them.
        since = held.groupBy("city").agg(F.to_date(F.min("timestamp")).alias("since"))
        newest = {}
        for kind in sides:
            schema = f"city string, timestamp timestamp, observed_at timestamp, {types[kind]}, day date, batch long"
            rows = spark.read.schema(schema).parquet(f"{path}/{kind}").where(F.col("batch") <= number)
            rows = rows.join(since, (rows["city"] == since["city"]) & (rows["day"] >= since["since"]), "left_semi").drop("day", "batch")
            newest[kind] = dedupe(rows, KEYS, [F.col("observed_at"), F.struct(*values[kind])])
        pairs = newest[_WEATHER].withColumnRenamed("observed_at", "_w").join(newest[_POLLUTION].withColumnRenamed("observed_at", "_p"), KEYS)
        hour = F.col("timestamp").cast(history.schema["timestamp"].dataType)
        pairs = pairs.join(cities, "city").withColumns({"source": F.lit(LIVE_SOURCE), "observed_at": F.greatest("_w", "_p"), "timestamp": hour})
        accepted, _ = upsert(held, pairs.select(*HISTORY_COLUMNS, "observed_at"), keep)
        accepted.where(F.col("source") == LIVE_SOURCE).write.mode("overwrite").parquet(f"{path}/history/batch={number}")

    return run_to_end(both.writeStream.foreachBatch(store), checkpoint)


def live_state(spark: SparkSession, path: str, history: DataFrame, keep: int = KEPT_HOURS, upto: int | None = None) -> DataFrame:
    """The history that a T1 job started from, with what its batches (up to ``upto``) accepted; the newest batch's row of an hour counts."""
    base = history.select(*HISTORY_COLUMNS)
    if upto is not None and upto < 0:
        return newest_hours(base, keep)
    added = spark.read.schema(StructType([*base.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/history")
    added = added if upto is None else added.where(F.col("batch") <= upto)
    rows = base.withColumn("batch", F.lit(-1).cast("long")).unionByName(added)
    return newest_hours(dedupe(rows, KEYS, [F.col("batch")]).drop("batch"), keep)


# T4 ---------------------------------------------------------------------------------------------------------------


def newest_readings(readings: DataFrame, path: str, checkpoint: str):
    """T4: per batch, the newest hour and the number of readings of each city."""

    def store(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.groupBy("city").agg(
            F.max(F.date_trunc("hour", F.col("observed_at"))).alias("reading"), F.count("*").alias("readings")
        )
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run_to_end(readings.writeStream.foreachBatch(store), checkpoint)


def gap_alarms(batches: DataFrame, stored: DataFrame) -> DataFrame:
    """T4: cities whose readings run more than one hour ahead of the stored history: one row per city over all batches so far.

    ``stored`` is the history (city, timestamp) as it stands when the alarms are read, so an hour that has been stored meanwhile
    ends its alarm.
    """
    newest = stored.groupBy("city").agg(F.max("timestamp").cast("timestamp").alias("latest_history"))
    fresh = batches.groupBy("city").agg(F.max("reading").alias("reading"), F.sum("readings").alias("readings"))
    gap = epoch_hours(F.col("reading")) - epoch_hours(F.col("latest_history"))
    alarms = fresh.join(newest, "city", "left").withColumn("gap_hours", gap.cast("long"))
    return alarms.where(F.col("latest_history").isNull() | (F.col("gap_hours") > 1))


def land(df: DataFrame, purpose: str) -> str:
    """Write a table to the shared folder for a stream to pick up."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return path


