"""H1-H7: live history maintenance with the panel as landed payloads and the events as live readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeline.catalog.inputs import panel, readings, sparse
from hazeline.catalog.registry import query
from hazeline.catalog.tables import _hourly_payloads
from hazeline.operators import history as H
from hazeline.operators import relational as R
from hazeline.sources import landed as L
from hazeline.schema import HISTORY_COLUMNS, KEYS, POLLUTANTS, WEATHER
from hazeline.session import work_dir, written

_DOUBLES = "latitude longitude pm2_5 pm10 carbon_monoxide"
_COLS = ", ".join(c for c in HISTORY_COLUMNS if c != "source")


def _ts(text):
    return F.lit(text).cast("timestamp_ntz")


def _with_source(df, source):
    return df.withColumn("source", F.lit(source)).select(*HISTORY_COLUMNS)


@query("h1_bootstrap", f"""
SELECT {_COLS}, 'open_meteo_bootstrap' AS source FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn
  FROM panel WHERE timestamp < TIMESTAMP '2024-01-30 12:00:00' AND city <> 'view') WHERE rn <= 120""", _DOUBLES)
def bootstrap(spark, folder):
    p = panel(spark, folder)
    cities = p.groupBy("city").agg(F.first("latitude").alias("latitude"), F.first("longitude").alias("longitude"))
    good, _ = H.bootstrap(
        p.select(*KEYS, *WEATHER), p.select(*KEYS, *POLLUTANTS), cities, _ts("2024-01-30 12:34:00"),
        existing=p.where(F.col("city") == "view"), validate=False)
    return good


@query("h1_landed_bootstrap", f"""
SELECT {_COLS}, 'open_meteo_bootstrap' AS source FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn
  FROM panel WHERE timestamp < TIMESTAMP '2024-01-30 12:00:00' AND city <> 'view') WHERE rn <= 120""", " ".join(["latitude longitude", *WEATHER, *POLLUTANTS]))
def landed_bootstrap(spark, folder):
    """H1 from the payloads as they were landed, weather and pollution each parsed and checked on its own."""
    p = panel(spark, folder)
    payloads = _hourly_payloads(spark, folder)
    weather, _ = L.hourly_checked(payloads, L.WEATHER_NAMES)
    pollution, _ = L.hourly_checked(payloads, {x: x for x in POLLUTANTS})
    cities = p.groupBy("city").agg(F.first("latitude").alias("latitude"), F.first("longitude").alias("longitude"))
    naive = F.col("timestamp").cast("timestamp_ntz")
    good, _ = H.bootstrap(weather.withColumn("timestamp", naive), pollution.withColumn("timestamp", naive), cities,
                          _ts("2024-01-30 12:34:00"), existing=p.where(F.col("city") == "view"), validate=False)
    return good


@query("h2_same_hour", """
SELECT a.city, a.user_id, w AS weather_at, p AS pollution_at, date_trunc('hour', w) = date_trunc('hour', p) AS same_hour FROM
  (SELECT city || '|' || user_id AS city, user_id, max(ts) AS w FROM readings GROUP BY ALL) a
  JOIN (SELECT city || '|' || user_id AS city, max(ts) AS p FROM readings WHERE k < 50 GROUP BY ALL) b USING (city)""")
def same_hour(spark, folder):
    r = readings(spark, folder).withColumn("city", F.concat_ws("|", "city", "user_id"))
    w = r.groupBy("city", "user_id").agg(F.max("ts").alias("weather_at"))
    p = r.where(F.col("k") < 50).groupBy("city").agg(F.max("ts").alias("pollution_at"))
    return R.same_hour(w, p)


_RECOVERED = f"""
live AS (SELECT s.* FROM sparse s JOIN (SELECT max(timestamp) - INTERVAL 167 HOUR AS a, max(timestamp) AS b FROM panel) x
  ON s.timestamp BETWEEN x.a AND x.b),
base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM panel) WHERE rn <= 168)"""


@query("h3_recover_gap", f"""WITH {_RECOVERED}
SELECT {_COLS}, CASE WHEN l.pm10 IS NULL THEN 'open_meteo_bootstrap' ELSE 'openweather_live' END AS source
FROM (SELECT b.*, l.city AS hit FROM base b LEFT JOIN live l ON l.city = b.city AND l.timestamp = b.timestamp) b
LEFT JOIN (SELECT city AS c, timestamp AS t, pm10 FROM live) l ON l.c = b.city AND l.t = b.timestamp""".replace("l.pm10 IS NULL", "l.c IS NULL").replace(
    f"SELECT {_COLS},", "SELECT " + ", ".join(f"b.{c}" for c in HISTORY_COLUMNS if c != "source") + ","), _DOUBLES)
def recover_gap(spark, folder):
    p = panel(spark, folder)
    recovered = _with_source(R.newest_hours(p, 168), H.BOOTSTRAP_SOURCE)
    return H.recover_gap(_with_source(sparse(spark, folder), H.LIVE_SOURCE), recovered)


_CUT = "TIMESTAMP '2024-01-29 00:00:00'"


def _history_and_readings(spark, folder):
    history = _with_source(panel(spark, folder).where(F.col("timestamp") < _ts("2024-01-29 00:00:00")), H.BOOTSTRAP_SOURCE)
    return history, _with_source(sparse(spark, folder), H.LIVE_SOURCE)


_RUN = f"""
ahead AS (SELECT *, date_diff('hour', {_CUT} - INTERVAL 1 HOUR, timestamp) AS ahead FROM sparse WHERE timestamp >= {_CUT}),
run AS (SELECT *, ahead - row_number() OVER (PARTITION BY city ORDER BY ahead) AS behind FROM ahead)"""


@query("h4_upsert", f"""
WITH {_RUN},
merged AS (SELECT p.*, CASE WHEN s.c IS NULL THEN 'open_meteo_bootstrap' ELSE 'openweather_live' END AS source
  FROM panel p LEFT JOIN (SELECT city AS c, timestamp AS t FROM sparse WHERE timestamp < {_CUT}
    UNION ALL SELECT city, timestamp FROM run WHERE behind = 0) s ON s.c = p.city AND s.t = p.timestamp
  WHERE p.timestamp < {_CUT} OR s.c IS NOT NULL)
SELECT {_COLS}, source FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM merged) WHERE rn <= 168""", _DOUBLES)
def upsert(spark, folder):
    return H.upsert(*_history_and_readings(spark, folder))[0]


@query("h4_refused", f"""
WITH {_RUN} SELECT city, timestamp, {_CUT} - INTERVAL 1 HOUR AS latest_history, 'gap' AS reason FROM run WHERE behind > 0""")
def refused(spark, folder):
    return H.upsert(*_history_and_readings(spark, folder))[1].select(*KEYS, "latest_history", "reason")


# Readings of two kinds for one hour: corrected ones carry a later observation time and other values.
@query("h4_corrected", f"""
WITH fixed AS (
  SELECT timestamp, city, CASE WHEN date_part('hour', timestamp) % 3 = 0 THEN pm10 + 1 ELSE pm10 END AS pm10 FROM panel
  WHERE timestamp >= {_CUT}),
merged AS (SELECT city, timestamp, pm10, 'openweather_live' AS source FROM fixed
  UNION ALL SELECT city, timestamp, pm10, 'open_meteo_bootstrap' FROM panel WHERE timestamp < {_CUT})
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM merged) WHERE rn <= 168""".replace(
    "SELECT * FROM (SELECT *, row", "SELECT city, timestamp, pm10, source FROM (SELECT *, row"), "pm10")
def corrected(spark, folder):
    """A catch-up of several hours, each reading twice; the later observation of an hour is the one kept."""
    p = panel(spark, folder)
    history = _with_source(p.where(F.col("timestamp") < _ts("2024-01-29 00:00:00")), H.BOOTSTRAP_SOURCE)
    first = _with_source(p.where(F.col("timestamp") >= _ts("2024-01-29 00:00:00")), H.LIVE_SOURCE).withColumn(
        "observed_at", F.col("timestamp") + F.expr("INTERVAL 10 MINUTES"))
    changed = F.when(F.hour("timestamp") % 3 == 0, F.col("pm10") + 1).otherwise(F.col("pm10")).cast(dict(first.dtypes)["pm10"])
    second = first.withColumn("pm10", changed).withColumn("observed_at", F.col("timestamp") + F.expr("INTERVAL 50 MINUTES"))
    return H.upsert(history, second.unionByName(first))[0].select(*KEYS, "pm10", "source")


def _refresh_inputs(spark, folder):
    """The panel as the stored table it is in use, cut into history, live readings and recovered rows."""
    p = written(panel(spark, folder), "panel")
    upto = F.when(F.col("city") == "error", _ts("2024-01-30 20:00:00")).otherwise(_ts("2024-01-30 23:00:00"))
    history = _with_source(p.where((F.col("city") != "click") & (F.col("timestamp") < upto)), H.BOOTSTRAP_SOURCE)
    return history, _with_source(R.newest_hours(p, 1), H.LIVE_SOURCE), _with_source(R.newest_hours(p, 168), H.BOOTSTRAP_SOURCE)


@query("h5_routes", """
SELECT city, TIMESTAMP '2024-01-30 23:00:00' AS reading,
  CASE city WHEN 'click' THEN NULL WHEN 'error' THEN TIMESTAMP '2024-01-30 19:00:00' ELSE TIMESTAMP '2024-01-30 22:00:00' END AS latest_history,
  CASE city WHEN 'click' THEN NULL WHEN 'error' THEN 4 ELSE 1 END::BIGINT AS gap_hours,
  CASE city WHEN 'click' THEN 'bootstrap' WHEN 'error' THEN 'recover' ELSE 'upsert' END AS route FROM (SELECT DISTINCT city FROM panel)""")
def routes(spark, folder):
    history, fresh, _ = _refresh_inputs(spark, folder)
    return H.routes(history, fresh)


@query("h5_refresh", f"""
SELECT {_COLS}, CASE WHEN rn = 1 THEN 'openweather_live' ELSE 'open_meteo_bootstrap' END AS source
FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM panel) WHERE rn <= 168""", _DOUBLES)
def refresh(spark, folder):
    return H.refresh(*_refresh_inputs(spark, folder))[0]


@query("h5_catch_up", f"""
WITH cut AS (SELECT city, CASE city WHEN 'click' THEN NULL WHEN 'error' THEN TIMESTAMP '2024-01-28 05:00:00' ELSE TIMESTAMP '2024-01-30 19:00:00' END AS held,
    TIMESTAMP '2024-01-30 15:00:00' AS given FROM (SELECT DISTINCT city FROM panel)),
ready AS (SELECT p.*, held, CASE WHEN city IN ('click', 'error') THEN given ELSE held END AS upto FROM panel p JOIN cut USING (city)),
merged AS (SELECT *, CASE WHEN timestamp >= TIMESTAMP '2024-01-30 12:00:00' THEN 'openweather_live' ELSE 'open_meteo_bootstrap' END AS source FROM ready)
SELECT {_COLS}, source FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM merged) WHERE rn <= 168""", _DOUBLES)
def catch_up(spark, folder):
    """Twelve hours of readings at once: one city without a history, one far behind it, the others with a few hours to catch up."""
    p = written(panel(spark, folder), "panel")
    upto = (F.when(F.col("city") == "click", _ts("1970-01-01 00:00:00")).when(F.col("city") == "error", _ts("2024-01-28 05:00:00"))
            .otherwise(_ts("2024-01-30 19:00:00")))
    history = _with_source(p.where(F.col("timestamp") <= upto), H.BOOTSTRAP_SOURCE)
    fresh = _with_source(p.where(F.col("timestamp") >= _ts("2024-01-30 12:00:00")), H.LIVE_SOURCE)
    recovered = _with_source(R.newest_hours(p.where(F.col("timestamp") <= _ts("2024-01-30 15:00:00")), 168), H.BOOTSTRAP_SOURCE)
    return H.refresh(history, fresh, recovered)[0]


@query("h5_refused", """
SELECT city, timestamp, NULL::TIMESTAMP AS latest_history, 'no_recovery' AS reason FROM panel
WHERE city = 'click' AND timestamp >= TIMESTAMP '2024-01-30 12:00:00' UNION ALL
SELECT city, timestamp, TIMESTAMP '2024-01-30 09:00:00', 'gap' FROM panel WHERE city = 'error' AND timestamp >= TIMESTAMP '2024-01-30 12:00:00'""")
def refused_refresh(spark, folder):
    """A city without history and recovered rows, and one whose recovered rows end before its readings."""
    p = written(panel(spark, folder), "panel")
    upto = F.when(F.col("city") == "error", _ts("2024-01-28 05:00:00")).otherwise(_ts("2024-01-30 19:00:00"))
    history = _with_source(p.where((F.col("city") != "click") & (F.col("timestamp") <= upto)), H.BOOTSTRAP_SOURCE)
    fresh = _with_source(p.where(F.col("timestamp") >= _ts("2024-01-30 12:00:00")), H.LIVE_SOURCE)
    recovered = _with_source(p.where((F.col("city") == "error") & (F.col("timestamp") <= _ts("2024-01-30 09:00:00"))), H.BOOTSTRAP_SOURCE)
    return H.refresh(history, fresh, recovered)[1].select(*KEYS, "latest_history", "reason")


@query("h6_saved_history", f"""
SELECT {_COLS}, 'open_meteo_bootstrap' AS source FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM panel)
WHERE rn <= 168""", _DOUBLES)
def saved(spark, folder):
    path = work_dir(spark, "history")
    H.save(_with_source(R.newest_hours(panel(spark, folder), 168), H.BOOTSTRAP_SOURCE), path)
    return H.load(spark, path)


@query("h6_versions", f"""
SELECT {_COLS.replace("pm10,", "CASE WHEN city = 'click' THEN pm10 + 1 ELSE pm10 END AS pm10,")}, 'open_meteo_bootstrap' AS source FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM panel)
WHERE rn <= 168""", _DOUBLES)
def versions(spark, folder):
    """A second version replaces one city; the others come over from the first. A third one fails its validation and is never seen."""
    path = work_dir(spark, "history")
    first = _with_source(R.newest_hours(panel(spark, folder), 168), H.BOOTSTRAP_SOURCE)
    H.save(first, path)
    click = H.load(spark, path).where(F.col("city") == "click")
    plus = (F.col("pm10") + 1).cast(dict(first.dtypes)["pm10"])
    H.save(click.withColumn("pm10", plus), path)
    try:
        H.save(click.withColumn("pm10", -plus), path)
    except ValueError:
        return H.load(spark, path)
    raise AssertionError("a history with negative values was published")


@query("h7_newest_source", """
SELECT city, CASE WHEN city = 'click' THEN 'unknown' ELSE 'openweather_live' END AS source, max(timestamp) AS timestamp FROM sparse GROUP BY city""")
def newest_source(spark, folder):
    rows = sparse(spark, folder).withColumn("source", F.when(F.col("city") != "click", H.LIVE_SOURCE))
    return H.newest_source(rows)
