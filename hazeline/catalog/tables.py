"""Tables, joins, splits, files, feature store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from hazeline.catalog.inputs import events, feature_panel, feature_table, panel, predictions, readings, sparse, target_panel
from hazeline.catalog.quality import SPLIT_SQL, split_panel
from hazeline.catalog.registry import query
from hazeline.operators import relational as R
from hazeline.operators import splits as P
from hazeline.operators import store
from hazeline.operators.features import complete_rows
from hazeline.schema import CITIES, FEATURES, KEYS, PANEL_COLUMNS, POLLUTANTS, TARGETS, WEATHER, city_dimension
from hazeline.session import work_dir
from hazeline.sources import landed as L

_PANEL_DOUBLES = "pm2_5 pm10 carbon_monoxide latitude longitude"


# Files ------------------------------------------------------------------------------------------------------------


@query("s1_csv_source", f"SELECT {', '.join(PANEL_COLUMNS)} FROM panel", " ".join(PANEL_COLUMNS[2:]))
def csv_source(spark, folder):
    """The panel written as CSV (S4) and read back with its schema."""
    path = work_dir(spark, "csv")
    L.write_csv(panel(spark, folder).select(*PANEL_COLUMNS), path)
    return L.read_csv(spark, path)


@query("s2_parquet_source", "SELECT event_id, ts AS timestamp, event_type AS city, value FROM events", "value")
def parquet_source(spark, folder):
    path = work_dir(spark, "events")
    events(spark, folder).select("event_id", F.col("ts").alias("timestamp"), F.col("event_type").alias("city"), "value").write.parquet(path)
    return L.read_panel(spark, path)


@query("s3_parquet_sink", f"SELECT {', '.join(PANEL_COLUMNS)} FROM panel", _PANEL_DOUBLES)
def parquet_sink(spark, folder):
    path = work_dir(spark, "panel")
    L.write_panel(panel(spark, folder), path)
    return L.read_panel(spark, path).select(*PANEL_COLUMNS)


@query("s4_csv_sink", "SELECT count(*) AS rows, count(DISTINCT city) AS cities FROM panel")
def csv_sink(spark, folder):
    path = work_dir(spark, "csv")
    L.write_csv(panel(spark, folder).select(*PANEL_COLUMNS), path)
    return L.read_csv_text(spark, path).agg(F.count("*").alias("rows"), F.count_distinct("city").alias("cities"))


def _hourly_payloads(spark, folder):
    """One payload per city and day, as an hourly API would have landed it."""
    day = panel(spark, folder).groupBy("city", F.to_date("timestamp").alias("day")).agg(
        F.array_sort(F.collect_list(F.struct(
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm").alias("time"),
            *[F.col(c).cast("double").alias(s) for s, c in L.WEATHER_NAMES.items()],
            *[F.col(c).cast("double").alias(c) for c in POLLUTANTS],
        ))).alias("r"))
    names = ["time", *L.WEATHER_NAMES, *POLLUTANTS]
    hourly = F.struct(*[F.col(f"r.{n}").alias(n) for n in names])
    return day.select("city", F.to_json(F.struct(hourly.alias("hourly"))).alias("payload"))


_S5 = ["timestamp", "city", *WEATHER, *POLLUTANTS]


@query("s5_hourly_payload", f"SELECT {', '.join(_S5)} FROM panel", " ".join([*WEATHER, *POLLUTANTS]))
def hourly_payload(spark, folder):
    names = {**L.WEATHER_NAMES, **{p: p for p in POLLUTANTS}}
    return L.hourly_rows(_hourly_payloads(spark, folder), names).select(*_S5)


@query("s5_refused", """
WITH d AS (SELECT city, date_part('day', CAST(timestamp AS DATE)) AS dom, CAST(timestamp AS DATE) AS day, count(*) AS n FROM panel GROUP BY ALL),
e AS (SELECT city, CASE dom WHEN 3 THEN 'bad_time' WHEN 5 THEN 'no_time' WHEN 7 THEN 'bad_value' END AS reason,
  CASE WHEN dom = 5 THEN 0 WHEN dom IN (3, 7) THEN n - 1 ELSE n END AS good FROM d)
SELECT city, reason, count(*) AS n FROM e WHERE reason IS NOT NULL GROUP BY ALL
UNION ALL SELECT city, 'accepted', sum(good)::BIGINT FROM e GROUP BY city""")
def hourly_refused(spark, folder):
    """Payloads of three days of the month are damaged: a time that is none, no time list, a value that is no number."""
    landed = _hourly_payloads(spark, folder)
    dom = F.substring(F.regexp_extract("payload", r'"time":\["([0-9-]{10})', 1), 9, 2)
    damaged = (F.when(dom == "03", F.regexp_replace("payload", r'"time":\["[^"]*"', '"time":["soon"'))
               .when(dom == "05", F.regexp_replace("payload", '"time":', '"tme":'))
               .when(dom == "07", F.regexp_replace("payload", r'"pm10":\[[^,\]]*', '"pm10":["n/a"')).otherwise(F.col("payload")))
    good, bad = L.hourly_checked(landed.withColumn("payload", damaged), {**L.WEATHER_NAMES, **{p: p for p in POLLUTANTS}})
    states = good.select("city", F.lit("accepted").alias("reason")).unionByName(bad.select("city", "reason"))
    return states.groupBy("city", "reason").agg(F.count("*").alias("n"))


def _current_payloads(spark, folder):
    e = F.col("event_id")
    v, k = F.col("value"), F.col("k")
    body = F.struct(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("dt"),
        F.struct(F.lit(31.5).alias("lat"), F.lit(74.25).alias("lon")).alias("coord"),
        F.struct((F.col("user_id") % 40).alias("temp"), F.when(e % 53 != 0, k).alias("humidity"), (k + 950).alias("pressure")).alias("main"),
        F.when(e % 3 != 0, F.struct((k % 20).alias("speed"), (e % 360).alias("deg"))).alias("wind"),
        F.when(e % 5 == 0, F.struct(v.alias("1h"))).alias("rain"),
        F.when(e % 7 == 0, F.struct((-v).alias("1h"))).alias("snow"),
    )
    return readings(spark, folder).withColumn("value", v.cast("double")).select("event_id", F.to_json(body).alias("payload"))


@query("s6_current_weather", """
SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS timestamp, 31.5 AS latitude, 74.25 AS longitude, user_id % 40 AS temperature,
  CASE WHEN event_id % 53 <> 0 THEN k END AS humidity,
  greatest(CASE WHEN event_id % 5 = 0 THEN value ELSE 0 END - CASE WHEN event_id % 7 = 0 THEN value ELSE 0 END, 0) AS precipitation,
  CASE WHEN event_id % 3 <> 0 THEN k % 20 ELSE 0 END AS wind_speed, CASE WHEN event_id % 3 <> 0 THEN event_id % 360 ELSE 0 END AS wind_direction,
  950 + k AS pressure, event_id % 53 <> 0 AS accepted FROM readings""",
       "latitude longitude temperature humidity precipitation wind_speed wind_direction pressure")
def current_weather(spark, folder):
    return L.current_weather(_current_payloads(spark, folder), keep=["event_id"])


def _pollution_payloads(spark, folder):
    e, v, k = F.col("event_id"), F.col("value").cast("double"), F.col("k")
    reading = F.struct(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("dt"),
        F.struct(
            F.when(e % 89 == 0, -v - 1).otherwise(v).alias("pm2_5"), (v + k).alias("pm10"), k.alias("co"), k.alias("no2"),
            F.when(e % 61 != 0, k).alias("so2"), k.alias("o3")).alias("components"),
    )
    body = F.struct(
        F.struct(F.lit(31.5).alias("lat"), F.lit(74.25).alias("lon")).alias("coord"),
        F.when(e % 59 == 0, F.array().cast("array<struct<dt:bigint,components:struct<pm2_5:double,pm10:double,co:int,no2:int,so2:int,o3:int>>>")).otherwise(F.array(reading)).alias("list"),
    )
    return readings(spark, folder).select("event_id", F.to_json(body).alias("payload"))


_P6 = "CASE WHEN event_id % 59 <> 0 THEN {} END"


@query("s6_current_pollution", f"""
SELECT event_id, {_P6.format("CAST(date_trunc('second', ts) AS TIMESTAMP)")} AS timestamp, 31.5 AS latitude, 74.25 AS longitude,
  {_P6.format('CASE WHEN event_id % 89 = 0 THEN -value - 1 ELSE value END')} AS pm2_5, {_P6.format('value + k')} AS pm10,
  {_P6.format('k')} AS carbon_monoxide, {_P6.format('k')} AS nitrogen_dioxide,
  {_P6.format('CASE WHEN event_id % 61 <> 0 THEN k END')} AS sulphur_dioxide, {_P6.format('k')} AS ozone,
  event_id % 59 <> 0 AND event_id % 61 <> 0 AND event_id % 89 <> 0 AS accepted FROM readings""",
       "latitude longitude pm2_5 pm10 carbon_monoxide nitrogen_dioxide sulphur_dioxide ozone")
def current_pollution(spark, folder):
    return L.current_pollution(_pollution_payloads(spark, folder), keep=["event_id"])


def _station_payloads(spark, folder):
    e, v = F.col("event_id"), F.col("value")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    body = F.struct(
        F.when(e % 41 == 0, "error").otherwise("ok").alias("status"),
        F.struct(
            F.when(e % 11 == 0, "-").when(e % 13 == 0, "").otherwise(v.cast("string")).alias("aqi"),
            F.struct(
                F.concat(F.lit("station "), F.col("city")).alias("name"),
                F.when(e % 17 == 0, F.array(F.lit(1.5))).otherwise(F.array(F.lit(31.5), F.lit(74.25))).alias("geo")).alias("city"),
            F.struct(F.when(e % 19 == 0, "soon").otherwise(F.concat(iso, F.lit("+05:00"))).alias("iso")).alias("time"),
        ).alias("data"),
    )
    return readings(spark, folder).select("event_id", F.to_json(body).alias("payload"))


@query("s7_station_feed", """
SELECT event_id, CASE WHEN event_id % 19 <> 0 THEN CAST(date_trunc('second', ts) AS TIMESTAMP) - INTERVAL 5 HOUR END AS timestamp,
  CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 THEN value END AS reported_aqi, 'station ' || city AS station_name,
  CASE WHEN event_id % 17 <> 0 THEN 31.5 END AS latitude, CASE WHEN event_id % 17 <> 0 THEN 74.25 END AS longitude,
  event_id % 41 <> 0 AS accepted FROM readings""", "reported_aqi latitude longitude")
def station_feed(spark, folder):
    return L.station_feed(_station_payloads(spark, folder), keep=["event_id"])


@query("s10_prediction_files", """
SELECT city, timestamp, horizon_hours, model, y_true, prediction, horizon_hours || 'h' AS horizon FROM predictions""", "y_true prediction")
def prediction_files(spark, folder):
    path = work_dir(spark, "predictions")
    L.write_predictions(predictions(spark, folder), path)
    return L.read_predictions(spark, path)


@query("s11_city_dimension", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {a}::DOUBLE, {b}::DOUBLE)" for c, a, b in CITIES)
       + ") t(city, latitude, longitude)", "latitude longitude")
def dimension(spark, folder):
    return city_dimension(spark)


# Rows -------------------------------------------------------------------------------------------------------------


@query("k1_newest_hours", """
SELECT city, timestamp, pm2_5, pm10 FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM panel)
WHERE rn <= 168""", "pm2_5 pm10")
def newest_hours(spark, folder):
    return R.newest_hours(panel(spark, folder).select(*KEYS, "pm2_5", "pm10"), 168)


@query("k1_newest_events_per_user", """
SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn <= 24""")
def newest_events(spark, folder):
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    return R.newest_n(events(spark, folder).select("user_id", "event_id", "ts"), ["user_id"], order, 24)


@query("k2_dedupe_keep_last", """
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""", "value")
def keep_last(spark, folder):
    ev = events(spark, folder)
    return R.dedupe(ev, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "value")


@query("k2_dedupe_keep_first", """
SELECT city, timestamp, event_id FROM (SELECT *, row_number() OVER (PARTITION BY city, timestamp ORDER BY ts, event_id) AS rn FROM readings)
WHERE rn = 1""")
def keep_first(spark, folder):
    r = readings(spark, folder)
    return R.dedupe(r, KEYS, [F.col("ts"), F.col("event_id")], "first").select(*KEYS, "event_id")


@query("k3_completed_hours", "SELECT city, timestamp FROM panel WHERE timestamp < TIMESTAMP '2024-01-20 12:00:00'")
def completed(spark, folder):
    as_of = F.lit("2024-01-20 12:34:56").cast("timestamp_ntz")
    return R.completed_hours(panel(spark, folder), as_of).select(*KEYS)


@query("k4_master_union", "SELECT city, timestamp, pm2_5 FROM panel", "pm2_5")
def master(spark, folder):
    """Panels of three groups of cities, as they come from separate loads."""
    p = panel(spark, folder).select(*KEYS, "pm2_5")
    return R.build_master([p.where(F.pmod(F.hash("city"), F.lit(3)) == i) for i in range(3)])


def _draw(*parts: str) -> str:
    x = "42::BIGINT"
    for p in parts:
        x = f"((({x}) + ({p})) * 48271) % 2147483647"
    return f"((({x}) * 48271 % 2147483647) * 48271) % 2147483647"


_HOURS = "(epoch(timestamp) / 3600)::BIGINT"


@query("k5_sample_per_city", f"""
SELECT city, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY {_draw(_HOURS)}, timestamp) AS rn FROM panel)
WHERE rn <= 10""")
def sample_per_city(spark, folder):
    return R.sample_per_city(panel(spark, folder).select(*KEYS))


@query("k6_sample_rows", f"SELECT city, timestamp FROM panel ORDER BY {_draw(_HOURS, 'ascii(city)')}, timestamp, city LIMIT 2000")
def sample_rows(spark, folder):
    return R.sample_rows(panel(spark, folder).select(*KEYS))


@query("k7_key_differences", f"""
WITH {SPLIT_SQL}, a AS (SELECT DISTINCT timestamp FROM split WHERE split = 'train'), b AS (SELECT DISTINCT timestamp FROM sparse)
SELECT coalesce(a.timestamp, b.timestamp) AS timestamp, (a.timestamp IS NOT NULL)::INT AS in_left, (b.timestamp IS NOT NULL)::INT AS in_right
FROM a FULL JOIN b ON a.timestamp = b.timestamp WHERE a.timestamp IS NULL OR b.timestamp IS NULL""")
def key_differences(spark, folder):
    train = split_panel(spark, folder).where(F.col("split") == "train")
    return R.key_differences(train, sparse(spark, folder), "timestamp")


@query("k8_sorted_output", "SELECT city, timestamp, pm10 FROM panel ORDER BY city, timestamp DESC", "pm10")
def sorted_output(spark, folder):
    return R.sorted_output(panel(spark, folder).select(*KEYS, "pm10"), "city", F.col("timestamp").desc())


# Joins ------------------------------------------------------------------------------------------------------------


@query("j1_weather_and_pollution", "SELECT city, timestamp, temperature, humidity, pm2_5, pm10 FROM sparse", "pm2_5 pm10")
def weather_and_pollution(spark, folder):
    p = sparse(spark, folder)
    w, q = p.select(*KEYS, "temperature", "humidity"), panel(spark, folder).select(*KEYS, "pm2_5", "pm10")
    return R.one_to_one(w, q, KEYS)


@query("j2_overlap", "SELECT count(*) AS overlap FROM sparse JOIN panel USING (city, timestamp)")
def overlap(spark, folder):
    return R.overlap_count(sparse(spark, folder), panel(spark, folder))


@query("j5_common_keys", """
SELECT count(*) AS rows, count(DISTINCT t.city) AS cities, 0::DOUBLE AS max_target_difference, true AS passed
FROM targets t JOIN predictions p ON p.city = t.city AND p.timestamp = t.timestamp AND p.horizon_hours = 24 AND p.model = 'mean_24h'""",
       "max_target_difference")
def common_keys(spark, folder):
    theirs = predictions(spark, folder).where((F.col("horizon_hours") == 24) & (F.col("model") == "mean_24h"))
    theirs = theirs.withColumnRenamed("prediction", "y_pred")
    return R.agreement(R.common_keys(target_panel(spark, folder), theirs, "target_aqi_24h"), "target_aqi_24h")


def _asof_features(spark, folder):
    """Each hour's values, available from its last event on."""
    return readings(spark, folder).groupBy(F.col("city").alias("city_id"), "timestamp").agg(
        F.max("ts").alias("event_timestamp"), F.min("value").alias("pm2_5"), F.max("value").alias("pm10")
    ).drop("timestamp")


def _lookups(spark, folder):
    return readings(spark, folder).select("event_id", F.col("city").alias("city_id"), F.col("ts").alias("event_timestamp"))


def _asof_sql(ttl):
    alive = f"l.event_timestamp <= f.event_timestamp + INTERVAL {ttl} HOUR"
    return f"""
WITH f AS (SELECT city AS city_id, max(ts) AS event_timestamp, min(value) AS pm2_5, max(value) AS pm10 FROM readings GROUP BY city, timestamp)
SELECT l.event_id, l.city_id, l.event_timestamp, CASE WHEN {alive} THEN f.event_timestamp END AS feature_timestamp,
  CASE WHEN {alive} THEN f.pm2_5 END AS pm2_5, CASE WHEN {alive} THEN f.pm10 END AS pm10
FROM (SELECT event_id, city AS city_id, ts AS event_timestamp FROM readings) l
ASOF LEFT JOIN f ON l.city_id = f.city_id AND l.event_timestamp >= f.event_timestamp"""


@query("j6_point_in_time", _asof_sql(168), "pm2_5 pm10")
def point_in_time(spark, folder):
    return R.asof_join(_lookups(spark, folder), _asof_features(spark, folder))


@query("j6_point_in_time_short_ttl", _asof_sql(1), "pm2_5 pm10")
def point_in_time_short(spark, folder):
    return R.asof_join(_lookups(spark, folder), _asof_features(spark, folder), ttl_hours=1)


@query("j7_attach_targets", "SELECT city, timestamp, aqi_rolling_mean_24h, target_aqi_24h, target_aqi_48h, target_aqi_72h FROM features",
       "aqi_rolling_mean_24h")
def attach_targets(spark, folder):
    retrieved = feature_panel(spark, folder).select(*KEYS, "aqi_rolling_mean_24h")
    return R.attach_targets(retrieved, target_panel(spark, folder), TARGETS)


@query("j7_unattached", """
SELECT count(*) AS rows, count(*) FILTER (WHERE target_aqi_24h IS NULL) AS missing_target_aqi_24h,
  count(*) FILTER (WHERE target_aqi_48h IS NULL) AS missing_target_aqi_48h, count(*) FILTER (WHERE target_aqi_72h IS NULL) AS missing_target_aqi_72h
FROM panel LEFT JOIN targets USING (city, timestamp)""")
def unattached(spark, folder):
    joined = R.attach_targets(panel(spark, folder).select(*KEYS), target_panel(spark, folder), TARGETS)
    return R.unattached(joined, TARGETS)


# Splits -----------------------------------------------------------------------------------------------------------


@query("p1_purged_split", f"WITH {SPLIT_SQL} SELECT city, timestamp, split FROM split")
def purged(spark, folder):
    return split_panel(spark, folder).select(*KEYS, "split")


@query("p2_split_summary", f"""WITH {SPLIT_SQL}
SELECT split, count(*) AS rows, min(timestamp) AS start, max(timestamp) AS "end", 72 AS purge_hours, '' AS excluded_cities
FROM split GROUP BY split""")
def split_summary(spark, folder):
    return P.split_summary(split_panel(spark, folder))


FOLDS = P.expanding_folds(
    [datetime(2024, 1, 15), datetime(2024, 1, 22)], datetime(2024, 1, 1), datetime(2024, 1, 30, 23))

FOLD_TABLE = "folds AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', 'train', TIMESTAMP '{a}', TIMESTAMP '{b}'), ('{n}', 'validation', TIMESTAMP '{c}', TIMESTAMP '{d}')"
    for n, a, b, c, d in FOLDS) + ") t(fold, role, a, b))"
FOLD_SQL = FOLD_TABLE + """,
labelled AS (SELECT f.fold, f.role, t.* FROM targets t JOIN folds f ON t.timestamp BETWEEN f.a AND f.b)"""


@query("p3_walk_forward", f"WITH {FOLD_SQL} SELECT city, timestamp, fold, role FROM labelled")
def walk_forward(spark, folder):
    return P.walk_forward(panel(spark, folder).select(*KEYS), FOLDS)


@query("p4_purge_gaps", f"""WITH {FOLD_SQL}
SELECT fold, max(timestamp) FILTER (WHERE role = 'train') AS train_end, min(timestamp) FILTER (WHERE role <> 'train') AS evaluation_start,
  date_diff('second', max(timestamp) FILTER (WHERE role = 'train'), min(timestamp) FILTER (WHERE role <> 'train')) / 3600::DOUBLE AS gap_hours,
  true AS passed FROM labelled GROUP BY fold""", "gap_hours")
def purge_gaps(spark, folder):
    return P.purge_gaps(P.walk_forward(panel(spark, folder).select(*KEYS), FOLDS))


def _sides(spark, folder):
    rows = P.walk_forward(feature_table(spark, folder), FOLDS[:1])
    return rows.where(F.col("role") == "train"), rows.where(F.col("role") != "train")


_CC = " AND ".join(f"{c} IS NOT NULL" for c in [*FEATURES, *TARGETS])


@query("p5_split_bundle", f"""
WITH c AS MATERIALIZED (SELECT city, timestamp FROM features WHERE {_CC}),
a AS (SELECT * FROM c WHERE timestamp BETWEEN TIMESTAMP '{FOLDS[0][1]}' AND TIMESTAMP '{FOLDS[0][2]}'),
b AS (SELECT * FROM c WHERE timestamp BETWEEN TIMESTAMP '{FOLDS[0][3]}' AND TIMESTAMP '{FOLDS[0][4]}')
SELECT (SELECT count(*) FROM a) AS train_rows, (SELECT count(DISTINCT city) FROM a) AS train_cities, (SELECT min(timestamp) FROM a) AS train_start,
  (SELECT max(timestamp) FROM a) AS train_end, 0::BIGINT AS train_missing_features, 0::BIGINT AS train_missing_targets,
  (SELECT count(*) FROM b) AS evaluation_rows, (SELECT count(DISTINCT city) FROM b) AS evaluation_cities, (SELECT min(timestamp) FROM b) AS evaluation_start,
  (SELECT max(timestamp) FROM b) AS evaluation_end, 0::BIGINT AS evaluation_missing_features, 0::BIGINT AS evaluation_missing_targets,
  0::BIGINT AS train_duplicates, 0::BIGINT AS evaluation_duplicates, 0::BIGINT AS city_differences, 0::BIGINT AS overlap,
  date_diff('second', (SELECT max(timestamp) FROM a), (SELECT min(timestamp) FROM b)) / 3600::DOUBLE AS gap_hours, true AS passed""", "gap_hours")
def split_bundle(spark, folder):
    train, evaluation = _sides(spark, folder)
    return P.split_bundle(train, evaluation, cities=5)


# Feature store ----------------------------------------------------------------------------------------------------


@query("f1_offline_table", f"SELECT city AS city_id, timestamp AS event_timestamp, timestamp AS created, {', '.join(FEATURES)} FROM features WHERE {_CC}",
       " ".join(FEATURES))
def offline_table(spark, folder):
    return store.offline_table(complete_rows(feature_panel(spark, folder)))


@query("f1_offline_report", f"""
WITH c AS (SELECT * FROM features WHERE {_CC})
SELECT count(*) AS rows, count(DISTINCT city) AS cities, min(timestamp) AS start, max(timestamp) AS "end", true AS balanced,
  (SELECT min(n) FROM (SELECT count(*) AS n FROM c GROUP BY city)) AS rows_per_city, 0::BIGINT AS missing_feature_cells,
  0::BIGINT AS duplicate_rows, 56 AS feature_count, true AS passed FROM c""")
def offline_report(spark, folder):
    return store.offline_report(store.offline_table(feature_table(spark, folder)))


@query("f3_latest_features", f"""
SELECT city AS city_id, timestamp AS event_timestamp, timestamp AS created, {', '.join(FEATURES)} FROM (
  SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM features WHERE {_CC}) WHERE rn = 1""", " ".join(FEATURES))
def latest_features(spark, folder):
    return store.latest_features(store.offline_table(complete_rows(feature_panel(spark, folder))))


@query("f4_retrieval_parity", "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, 0::DOUBLE AS max_absolute_difference, 0::BIGINT AS only_one_side, true AS matches" for c in FEATURES),
       "max_absolute_difference")
def parity(spark, folder):
    """Features written to the offline store and read back point-in-time equal those computed."""
    built = store.offline_table(feature_table(spark, folder))
    path = work_dir(spark, "offline")
    store.write_offline(built, path)
    stored = spark.read.parquet(path).select(*built.columns)
    keys = ["city_id", "event_timestamp"]
    found = R.asof_join(built.select(*keys), stored, created="created")
    return store.retrieval_parity(built, found, keys)
