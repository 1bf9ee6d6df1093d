"""Data quality and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeline.catalog import twin as S
from hazeline.catalog.inputs import aqi_panel, dirty, events, feature_panel, panel, readings, sparse, target_panel
from hazeline.catalog.registry import query
from hazeline.operators import audit as A
from hazeline.operators import quality as Q
from hazeline.operators.splits import purged_split
from hazeline.plans import panel as P
from hazeline.schema import CATEGORY_ORDER, FEATURES, PANEL_COLUMNS, POLLUTANTS, RANGE_RULES, SHORT_CATEGORY_ORDER, TARGETS

_DIRTY = ["city", "timestamp", "event_id", "pm2_5", "pm10", "carbon_monoxide", "nitrogen_dioxide", "sulphur_dioxide", "ozone",
          "dust", "temperature", "humidity", "precipitation", "wind_speed", "wind_direction", "pressure", "latitude",
          "longitude"]


def _stack(parts) -> str:
    return "\nUNION ALL ".join(parts)


@query("v2_missing_cells", _stack(
    f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM dirty" for c in _DIRTY))
def missing_cells(spark, folder):
    return Q.missing_cells(dirty(spark, folder))


@query("v2_missing_total", "SELECT count(*) FILTER (WHERE pm2_5 IS NULL) AS missing_values FROM dirty")
def missing_total(spark, folder):
    return Q.missing_total(dirty(spark, folder))


@query("v3_duplicate_rows", """
SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, city, timestamp, k FROM readings)))::BIGINT AS duplicate_rows
FROM readings""")
def duplicate_rows(spark, folder):
    return Q.duplicate_rows(readings(spark, folder).select("user_id", "city", "timestamp", "k"))


@query("v4_duplicate_keys", """
SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM readings GROUP BY city, timestamp)""")
def duplicate_keys(spark, folder):
    return Q.duplicate_keys(readings(spark, folder), ["city", "timestamp"])


def _texts(spark, folder):
    e = F.col("event_id")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return events(spark, folder).select(
        F.when(e % 101 == 0, "not a time").when(e % 2 == 0, F.concat(iso, F.lit("Z"))).otherwise(
            F.concat(iso, F.lit("+05:00"))).alias("timestamp"))


@query("v5_v6_timestamp_text", """
SELECT count(*) FILTER (WHERE event_id % 101 = 0) AS invalid_timestamps,
  count(*) FILTER (WHERE event_id % 101 = 0) = 0 AS timezone_present FROM events""")
def timestamp_text(spark, folder):
    return Q.timestamp_text(_texts(spark, folder))


@query("v8_balance", """
SELECT count(*) AS city_count, min(n) = max(n) AS balanced_cities, CASE WHEN min(n) = max(n) THEN min(n) END AS expected_rows_per_city
FROM (SELECT city, count(*) AS n FROM panel GROUP BY city)""")
def balance(spark, folder):
    return Q.balance(panel(spark, folder))


def _violation(c: str) -> str:
    low, high = RANGE_RULES[c]
    tests = [f"{c} IS NULL"] + ([f"{c} < {low}"] if low is not None else []) + ([f"{c} > {high}"] if high is not None else [])
    return " OR ".join(tests)


@query("v9_range_violations", _stack(
    f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {_violation(c)}) AS invalid FROM dirty" for c in RANGE_RULES))
def range_violations(spark, folder):
    return Q.range_violations(dirty(spark, folder))


_WEATHER = ["temperature", "humidity", "precipitation", "wind_speed", "wind_direction", "pressure"]


def _varies(table):
    return _stack(
        f"SELECT '{c}' AS variable, coalesce(bool_or(n > 1), false) AS varies FROM (SELECT count(DISTINCT {c}) AS n FROM {table} "
        f"GROUP BY city, CAST(timestamp AS DATE))" for c in _WEATHER)


@query("v10_weather_variability", _varies("panel"))
def variability(spark, folder):
    return Q.weather_variability(panel(spark, folder))


_REPORT_SQL = f"""
WITH base AS (
  SELECT count(*) AS row_count, 18 AS column_count, count(DISTINCT city) AS city_count,
    count(*) FILTER (WHERE pm2_5 IS NULL) AS missing_values, 0::BIGINT AS duplicate_rows,
    {', '.join(f"count(*) FILTER (WHERE {_violation(c)}) AS bad_{c}" for c in RANGE_RULES)} FROM dirty),
per_city AS (SELECT city, count(*) AS n FROM dirty GROUP BY city),
gap AS (SELECT count(*) = 0 AS ok FROM (SELECT timestamp, lag(timestamp) OVER (PARTITION BY city ORDER BY timestamp) AS p FROM dirty)
  WHERE p IS NOT NULL AND timestamp <> p + INTERVAL 1 HOUR),
vary AS (SELECT bool_and(varies) AS ok FROM ({_varies('dirty')}) WHERE variable <> 'precipitation'),
eq AS (SELECT min(n) = max(n) AS ok FROM per_city)
SELECT row_count, column_count, city_count, missing_values, duplicate_rows, gap.ok AS hourly_continuity, eq.ok AS balanced_cities,
  vary.ok AS weather_variability_valid,
  concat_ws(',', {', '.join(f"CASE WHEN bad_{c} > 0 THEN '{c}=' || bad_{c} END" for c in RANGE_RULES)}) AS invalid_ranges,
  concat_ws('|', CASE WHEN missing_values > 0 THEN 'Dataset contains ' || missing_values || ' missing values.' END,
    '{Q.WARN_ZONE}', CASE WHEN NOT gap.ok THEN '{Q.WARN_GAPS}' END, CASE WHEN NOT eq.ok THEN '{Q.WARN_BALANCE}' END,
    '{Q.WARN_RANGE}', CASE WHEN NOT vary.ok THEN '{Q.WARN_WEATHER}' END, '{Q.WARN_AQI}', '{Q.WARN_CATEGORY}') AS warnings,
  '' AS errors, 'REVIEW' AS status
FROM base, gap, vary, eq"""


@query("v11_validation_report", _REPORT_SQL)
def report(spark, folder):
    text = dirty(spark, folder).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    pairs = F.transform(
        F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col("invalid_numeric_ranges")[c].alias("v")) for c in RANGE_RULES]),
                 lambda s: s["v"].isNotNull()),
        lambda s: F.concat(s["k"], F.lit("="), s["v"].cast("string")))
    return Q.validation_report(text, "events").select(
        "row_count", "column_count", "city_count", "missing_values", "duplicate_rows", "hourly_continuity", "balanced_cities",
        "weather_variability_valid", F.array_join(pairs, ",").alias("invalid_ranges"),
        F.array_join("warnings", "|").alias("warnings"), F.array_join("errors", "|").alias("errors"), "status")


@query("v12_negative_counts", _stack(
    f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} < 0) AS negative FROM dirty"
    for c in ["precipitation", "wind_speed", *POLLUTANTS]))
def negative_counts(spark, folder):
    return Q.negative_counts(dirty(spark, folder))


@query("v13_minimum_history", """
SELECT city, count(*) AS rows, count(*) >= 97 AS enough FROM sparse GROUP BY city""")
def minimum_history(spark, folder):
    return Q.minimum_history(sparse(spark, folder), 97)


@query("v13_minimum_aqi_history", """
SELECT city, count(aqi_current) AS rows, count(aqi_current) >= 73 AS enough FROM named GROUP BY city""")
def minimum_aqi_history(spark, folder):
    return Q.minimum_history(aqi_panel(spark, folder), 73, F.col("aqi_current").isNotNull())


@query("v14_feature_health", _stack(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS missing, 0::BIGINT AS infinite FROM features"
    for c in FEATURES))
def feature_health(spark, folder):
    return Q.feature_health(feature_panel(spark, folder))


@query("v15_dataset_contract", """
SELECT count(*) AS rows, count(DISTINCT city) AS cities, min(timestamp) AS start, max(timestamp) AS "end", true AS passed FROM panel""")
def contract(spark, folder):
    return Q.dataset_contract(panel(spark, folder), 3600, 5, "2024-01-01 00:00:00", "2024-01-30 23:00:00")


_CLIP = ["pm10", "pm2_5", "carbon_monoxide", "nitrogen_dioxide", "sulphur_dioxide", "ozone", "dust"]


@query("v16_clip_negatives", f"""
SELECT event_id, {', '.join(f'CASE WHEN {c} < 0 THEN 0 ELSE {c} END AS {c}' for c in ('pm10', 'pm2_5'))} FROM dirty""",
       "pm10 pm2_5")
def clip_negatives(spark, folder):
    return Q.clip_negatives(dirty(spark, folder)).select("event_id", "pm10", "pm2_5")


@query("v16_clip_report", _stack(
    f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} < 0) AS values_clipped, CAST(min({c}) FILTER (WHERE {c} < 0) AS DOUBLE) "
    f"AS minimum_before, 0::DOUBLE AS replacement FROM dirty" for c in _CLIP), "minimum_before replacement")
def clip_report(spark, folder):
    return Q.clip_report(dirty(spark, folder))


_PANEL_DOUBLES = "pm2_5 pm10 carbon_monoxide latitude longitude"


@query("v17_exclude_cities", "SELECT city, count(*) AS rows FROM panel WHERE city NOT IN ('view') GROUP BY city")
def exclude(spark, folder):
    return Q.exclude_cities(panel(spark, folder), ["view"]).groupBy("city").agg(F.count("*").alias("rows"))


@query("v18_canonical", f"SELECT {', '.join(PANEL_COLUMNS)} FROM panel", _PANEL_DOUBLES)
def canonical(spark, folder):
    return Q.canonical(panel(spark, folder), PANEL_COLUMNS)


@query("v19_row_conservation", """
SELECT count(*) AS input_rows, count(*) FILTER (WHERE city = 'view') AS excluded_rows,
  count(*) FILTER (WHERE city <> 'view') AS output_rows, true AS passed FROM panel""")
def conservation(spark, folder):
    p = panel(spark, folder)
    return Q.row_conservation(p, Q.exclude_cities(p, ["view"]), ["view"])


# Audits -----------------------------------------------------------------------------------------------------------

_NUMERIC = ["latitude", "longitude", *POLLUTANTS, *_WEATHER]
_LONG = "UNPIVOT (SELECT city, timestamp, {cols} FROM {t}) ON {names} INTO NAME variable VALUE value"


def _unpivot(table, names, ids="city, timestamp, "):
    cols = ", ".join(f"CAST({c} AS DECIMAL(18,4)) AS {c}" for c in names)
    return f"(UNPIVOT (SELECT {ids}{cols} FROM {table}) ON {', '.join(names)} INTO NAME variable VALUE value)"


_STD = "CASE WHEN count({v}) > 1 THEN sqrt(greatest(count({v})::DOUBLE * sum({v} * {v})::DOUBLE - sum({v})::DOUBLE * sum({v})::DOUBLE, 0) / (count({v})::DOUBLE * (count({v})::DOUBLE - 1))) END"
_MEAN = "sum({v})::DOUBLE / nullif(count({v}), 0)"


@query("a1_describe", f"""
SELECT variable, count(*) AS count, {_MEAN.format(v='value')} AS mean, stddev_samp(value::DOUBLE) AS std, min(value) AS min,
  {', '.join(f'quantile_cont(value::DOUBLE, {p}) AS {n}' for p, n in zip(A.DESCRIBE_PROBS, A.DESCRIBE_NAMES))}, max(value) AS max
FROM {_unpivot('panel', _NUMERIC)} GROUP BY variable""",
       "mean std min p1 p5 p25 p50 p75 p95 p99 p999 max")
def describe(spark, folder):
    return A.describe(panel(spark, folder))


@query("a2_negative_audit", _stack(
    f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} < 0) AS negative_count, count(*) FILTER (WHERE {c} < 0)::DOUBLE / count(*) * 100 "
    f"AS percentage, CAST(min({c}) FILTER (WHERE {c} < 0) AS DOUBLE) AS minimum, "
    f"coalesce(string_agg(DISTINCT CASE WHEN {c} < 0 THEN city END, ', ' ORDER BY CASE WHEN {c} < 0 THEN city END), '') AS cities FROM dirty" for c in POLLUTANTS),
       "percentage minimum")
def negative_audit(spark, folder):
    return A.negative_audit(dirty(spark, folder))


@query("a3_extreme_audit", f"""
WITH long AS (SELECT * FROM {_unpivot('panel', POLLUTANTS)})
SELECT variable, {_MEAN.format(v='value')} AS mean, quantile_cont(value::DOUBLE, 0.95) AS p95, quantile_cont(value::DOUBLE, 0.99) AS p99,
  quantile_cont(value::DOUBLE, 0.999) AS p999, max(value) AS max,
  first(city ORDER BY value DESC, city, timestamp) AS max_city, first(timestamp ORDER BY value DESC, city, timestamp) AS max_timestamp
FROM long GROUP BY variable""", "mean p95 p99 p999 max")
def extreme_audit(spark, folder):
    return A.extreme_audit(panel(spark, folder))


_A4 = [f"{c}_{s}" for c in POLLUTANTS for s in ("mean", "std", "min", "max")]


@query("a4_city_statistics", "SELECT city, " + ", ".join(
    f"{_MEAN.format(v=c)} AS {c}_mean, stddev_samp({c}::DOUBLE) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max"
    for c in POLLUTANTS) + " FROM panel GROUP BY city", " ".join(_A4))
def city_statistics(spark, folder):
    return A.city_statistics(panel(spark, folder))


@query("a5_coverage", """
SELECT count(*) AS rows, count(DISTINCT city) AS cities, min(timestamp) AS start, max(timestamp) AS "end",
  count(*) FILTER (WHERE pm2_5 IS NULL)::BIGINT AS missing_cells,
  (count(*) - count(DISTINCT city || timestamp::VARCHAR))::BIGINT AS duplicates FROM dirty""")
def coverage(spark, folder):
    return A.coverage(dirty(spark, folder))


def _pair_sql(a: str, b: str) -> str:
    n = f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"

    def s(x):
        return f"CAST(sum({x}) AS DOUBLE)"

    vx = f"({n}::DOUBLE * {s(f'{a}*{a}')} - {s(a)} * {s(a)})"
    vy = f"({n}::DOUBLE * {s(f'{b}*{b}')} - {s(b)} * {s(b)})"
    return f"""{n} AS matched_rows,
  CASE WHEN {vx} > 0 AND {vy} > 0 THEN ({n}::DOUBLE * {s(f'{a}*{b}')} - {s(a)} * {s(b)}) / (sqrt({vx}) * sqrt({vy})) END AS correlation,
  {s(f'abs({a}-{b})')} / nullif({n}, 0) AS mae"""


_MATCH = """count(*) FILTER (WHERE abs(a::DOUBLE - b::DOUBLE) <= 1e-12)::DOUBLE / count(*) * 100 AS exact_match_pct,
  count(*) FILTER (WHERE abs(a::DOUBLE - b::DOUBLE) <= 0.05::DOUBLE + 1e-5::DOUBLE * abs(b::DOUBLE))::DOUBLE / count(*) * 100 AS near_match_pct"""

_SIMILARITY = f"""
WITH long AS (SELECT city, timestamp, variable, CAST(value AS DECIMAL(18,2)) AS value FROM {_unpivot('panel', POLLUTANTS)}),
paired AS (SELECT x.city AS city_a, y.city AS city_b, x.variable AS pollutant, x.value AS a, y.value AS b
  FROM long x JOIN long y ON x.timestamp = y.timestamp AND x.variable = y.variable AND x.city < y.city)
SELECT city_a, city_b, pollutant, {_pair_sql('a', 'b')}, {_MATCH} FROM paired GROUP BY city_a, city_b, pollutant"""


@query("j3_a6_city_similarity", _SIMILARITY, "correlation mae exact_match_pct near_match_pct")
def similarity(spark, folder):
    return A.city_similarity(panel(spark, folder))


@query("a7_suspicious_pairs", f"SELECT * FROM ({_SIMILARITY}) WHERE correlation >= 0.05 OR near_match_pct >= 5.0",
       "correlation mae exact_match_pct near_match_pct")
def suspicious(spark, folder):
    """The report's rule with lower limits, since the given series are unrelated."""
    s = A.city_similarity(panel(spark, folder))
    return A.suspicious_pairs(s, 0.05, 5.0)


@query("a7_named_pair", f"SELECT * FROM ({_SIMILARITY}) WHERE city_a = 'click' AND city_b = 'view'",
       "correlation mae exact_match_pct near_match_pct")
def named_pair(spark, folder):
    return A.named_pair(A.city_similarity(panel(spark, folder)), "view", "click")


_HALF = "SELECT event_type AS city, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS timestamp, CAST(min(value) AS DECIMAL(18,2)) AS pm2_5, CAST(max(value) AS DECIMAL(18,2)) AS pm10, CAST(sum(value::DECIMAL(18,2)) AS DECIMAL(18,2)) AS carbon_monoxide FROM events WHERE event_id % 2 = {r} GROUP BY ALL"
_VARS = ["pm2_5", "pm10", "carbon_monoxide"]


@query("j4_source_overlap", f"WITH x AS ({_HALF.format(r=0)}), y AS ({_HALF.format(r=1)}), j AS (SELECT city, timestamp, "
       + ", ".join(f"x.{c} AS a_{c}, y.{c} AS b_{c}" for c in _VARS) + " FROM x JOIN y USING (city, timestamp)) " + _stack(
           f"SELECT '{c}' AS variable, {_pair_sql('a_' + c, 'b_' + c)}, CAST(sum(a_{c}) AS DOUBLE) / count(*) AS existing_mean, "
           f"CAST(sum(b_{c}) AS DOUBLE) / count(*) AS new_mean FROM j" for c in _VARS), "correlation mae existing_mean new_mean")
def overlap(spark, folder):
    """The two halves of the event log (together the whole of it) as two sources of one series."""
    ev = events(spark, folder)
    a = P.sparse_panel(ev.where(F.col("event_id") % 2 == 0))
    b = P.sparse_panel(ev.where(F.col("event_id") % 2 == 1))
    return A.source_overlap(a, b, _VARS)


def _summary_sql(by, expr):
    return f"""
SELECT {expr} AS {by}, count(aqi_current) AS rows, round(avg(aqi_current), 2) AS mean, round(median(aqi_current), 2) AS median,
  round({_STD.format(v='aqi_current::BIGINT')}, 2) AS std, min(aqi_current)::DOUBLE AS minimum, max(aqi_current)::DOUBLE AS maximum
FROM named WHERE aqi_current IS NOT NULL GROUP BY 1"""


@query("a8_aqi_by_year", _summary_sql("year", "date_part('year', timestamp)::INT"), "mean median std")
def by_year(spark, folder):
    return A.aqi_summary(aqi_panel(spark, folder), "year")


@query("a8_aqi_by_city", _summary_sql("city", "city"), "mean median std")
def by_city(spark, folder):
    return A.aqi_summary(aqi_panel(spark, folder), "city")


@query("a8_aqi_by_month", _summary_sql("month", "date_part('month', timestamp)::INT"), "mean median std")
def by_month(spark, folder):
    return A.aqi_summary(aqi_panel(spark, folder), "month")


def _table_sql(by, expr):
    n = {c: c.lower().replace(" ", "_") for c in CATEGORY_ORDER}
    f = {c: f"count(*) FILTER (WHERE aqi_category = '{c}')" for c in CATEGORY_ORDER}
    cols = ", ".join(f"{f[c]} AS {n[c]}_rows, round({f[c]}::DOUBLE / count(*) * 100, 2) AS {n[c]}_pct" for c in CATEGORY_ORDER)
    return f"SELECT {expr} AS {by}, {cols} FROM named WHERE aqi_category IS NOT NULL GROUP BY 1"


@query("a9_category_by_year", _table_sql("year", "date_part('year', timestamp)::INT"))
def category_by_year(spark, folder):
    return A.category_table(aqi_panel(spark, folder), "year")


@query("a9_category_by_month", _table_sql("month", "date_part('month', timestamp)::INT"))
def category_by_month(spark, folder):
    return A.category_table(aqi_panel(spark, folder), "month")


def _share_sql(c, places):
    return f"""SELECT {c}, count(*) AS rows, round(count(*)::DOUBLE / sum(count(*)) OVER () * 100, {places}) AS percentage
FROM named WHERE {c} IS NOT NULL GROUP BY {c}"""


@query("a10_dominant_pollutant", _share_sql("dominant_pollutant", 2), "percentage")
def dominant(spark, folder):
    return A.value_shares(aqi_panel(spark, folder), "dominant_pollutant")


@query("a11_category_shares", _share_sql("aqi_category", 3), "percentage")
def shares(spark, folder):
    return A.value_shares(aqi_panel(spark, folder), "aqi_category", 3)


SPLIT_SQL = """
cuts AS (SELECT max(timestamp) FILTER (WHERE i = floor(n * 0.70::DOUBLE)) AS b1, max(timestamp) FILTER (WHERE i = floor(n * (0.70::DOUBLE + 0.15::DOUBLE))) AS b2
  FROM (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS i, count(*) OVER () AS n
    FROM (SELECT DISTINCT timestamp FROM targets))),
split AS (SELECT * FROM (SELECT t.*, CASE WHEN timestamp < b1 - INTERVAL 72 HOUR THEN 'train'
    WHEN timestamp >= b1 AND timestamp < b2 - INTERVAL 72 HOUR THEN 'validation' WHEN timestamp >= b2 THEN 'test' END AS split
  FROM targets t, cuts) WHERE split IS NOT NULL),
split_long AS (SELECT split, '24h' AS horizon, target_aqi_24h AS value FROM split UNION ALL
  SELECT split, '48h', target_aqi_48h FROM split UNION ALL SELECT split, '72h', target_aqi_72h FROM split)"""


def split_panel(spark, folder):
    return purged_split(target_panel(spark, folder), validate=False)


@query("a12_target_summary", f"""WITH {SPLIT_SQL}
SELECT split, horizon, count(value) AS count, avg(value) AS mean, median(value) AS median, {_STD.format(v='value::BIGINT')} AS std,
  min(value) AS min, quantile_cont(value::DOUBLE, 0.25) AS q25, quantile_cont(value::DOUBLE, 0.75) AS q75, max(value) AS max
FROM split_long GROUP BY split, horizon""", "mean median std min q25 q75 max")
def target_summary(spark, folder):
    return A.target_summary(split_panel(spark, folder))


_CATEGORIES = f"""
SELECT s.split, s.horizon, c.category, count(l.value) AS count, coalesce(100.0 * count(l.value) / nullif(s.n, 0), 0) AS percentage
FROM (SELECT split, horizon, count(value) AS n FROM split_long GROUP BY split, horizon) s
CROSS JOIN (SELECT unnest([{', '.join(f"'{c}'" for c in SHORT_CATEGORY_ORDER)}]) AS category) c
LEFT JOIN split_long l ON l.split = s.split AND l.horizon = s.horizon AND {S.short_category('l.value')} = c.category
GROUP BY s.split, s.horizon, c.category, s.n"""


@query("a13_target_categories", f"WITH {SPLIT_SQL} {_CATEGORIES}", "percentage")
def target_categories(spark, folder):
    return A.target_categories(split_panel(spark, folder))


@query("a14_category_by_split", f"""WITH {SPLIT_SQL}, shares AS ({_CATEGORIES})
SELECT horizon, category, max(percentage) FILTER (WHERE split = 'train') AS train,
  max(percentage) FILTER (WHERE split = 'validation') AS validation, max(percentage) FILTER (WHERE split = 'test') AS test,
  (CASE category {' '.join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(SHORT_CATEGORY_ORDER, 1))} END)::INT AS position
FROM shares GROUP BY horizon, category""", "train validation test")
def category_by_split(spark, folder):
    return A.category_by_split(A.target_categories(split_panel(spark, folder)), ["train", "validation", "test"])


@query("a15_rows_by_city", """SELECT city, count(*) AS rows, min(timestamp) AS start, max(timestamp) AS "end" FROM sparse GROUP BY city""")
def rows_by_city(spark, folder):
    return A.rows_by_city(sparse(spark, folder))


@query("a15_rows_by_year", """
SELECT date_part('year', timestamp)::INT AS year, count(*) AS rows, count(DISTINCT city) AS cities FROM sparse GROUP BY 1""")
def rows_by_year(spark, folder):
    return A.rows_by_year(sparse(spark, folder))


_ALL = "target_aqi_24h IS NOT NULL AND target_aqi_48h IS NOT NULL AND target_aqi_72h IS NOT NULL"


@query("a16_target_completeness", f"""
SELECT count(aqi_current) AS rows_with_current_aqi, count(*) FILTER (WHERE {_ALL}) AS rows_with_all_targets,
  count(*) FILTER (WHERE {_ALL} AND aqi_current IS NOT NULL) AS complete_rows,
  {', '.join(f"count(*) FILTER (WHERE {t} IS NULL) AS missing_{t[11:]}" for t in TARGETS)} FROM targets""")
def completeness(spark, folder):
    return A.target_completeness(target_panel(spark, folder))


@query("a17_split_description", f"""WITH {SPLIT_SQL}
SELECT split, count(*) AS rows, count(DISTINCT city) AS cities, min(timestamp) AS start, max(timestamp) AS "end",
  {', '.join(f"avg({t}) AS mean_{t.replace('_aqi', '')}" for t in TARGETS)} FROM split GROUP BY split""",
       "mean_target_24h mean_target_48h mean_target_72h")
def split_description(spark, folder):
    return A.split_description(split_panel(spark, folder), ["split"])


_P18 = {"p1": .01, "p5": .05, "p25": .25, "p50": .5, "p75": .75, "p90": .9, "p95": .95, "p99": .99}


@query("a18_aqi_distribution", f"""
SELECT count(aqi_current) AS count, round(avg(aqi_current), 3) AS mean, round({_STD.format(v='aqi_current::BIGINT')}, 3) AS std,
  min(aqi_current) AS min, {', '.join(f'round(quantile_cont(aqi_current::DOUBLE, {p}), 3) AS {n}' for n, p in _P18.items())},
  max(aqi_current) AS max FROM named""", "mean std min max p1 p5 p25 p50 p75 p90 p95 p99")
def distribution(spark, folder):
    return A.aqi_distribution(aqi_panel(spark, folder))
