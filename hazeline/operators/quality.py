"""Data-quality checks. Each is one aggregate; nothing but the report leaves the cluster."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

from hazeline.functions.aqi import nan_to_null
from hazeline.functions.text import has_zone
from hazeline.operators.grid import continuity
from hazeline.schema import (
    CANONICAL_COLUMNS,
    FEATURES,
    HISTORY_COLUMNS,
    NON_NEGATIVE,
    POLLUTANTS_WITH_DUST,
    RANGE_RULES,
    WEATHER,
    missing_columns,
    one_row,
    require_columns,
)


def is_missing(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def missing_cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """V2: missing cells per column."""
    names = columns or df.columns
    wide = df.agg(*[F.count_if(is_missing(df, c)).alias(c) for c in names])
    return wide.unpivot([], names, "variable", "missing")


def missing_total(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """V2: all missing cells."""
    names = columns or df.columns
    per_row = reduce(lambda a, b: a + b, [is_missing(df, c).cast("int") for c in names])
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0)).cast("long").alias("missing_values"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """V4: rows beyond the first of each key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """V3: rows beyond the first of each identical row."""
    return duplicate_keys(df, df.columns).withColumnRenamed("duplicates", "duplicate_rows")


def require_unique(df: DataFrame, keys: list[str], what: str = "input") -> DataFrame:
    n = duplicate_keys(df, keys).first()["duplicates"]
    if n:
        raise ValueError(f"{what} contains {n} duplicate {'/'.join(keys)} rows.")
    return df


def timestamp_text(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """V5, V6: texts that are no timestamp, and whether all of them carry a zone."""
    parsed = F.try_to_timestamp(F.col(column))
    return df.agg(
        F.count_if(parsed.isNull()).alias("invalid_timestamps"),
        F.coalesce(F.bool_and(has_zone(F.col(column))), F.lit(False)).alias("timezone_present"),
    )


def balance(df: DataFrame) -> DataFrame:
    """V8: do all cities have the same number of rows, and which?"""
    per_city = df.groupBy("city").agg(F.count("*").alias("n"))
    same = F.min("n") == F.max("n")
    return per_city.agg(
        F.count("*").alias("city_count"),
        F.coalesce(same, F.lit(False)).alias("balanced_cities"),
        F.when(same, F.min("n")).alias("expected_rows_per_city"),
    )


def out_of_range(name: str) -> Column:
    """A value that is missing, no number, or outside its range."""
    low, high = RANGE_RULES[name]
    v = nan_to_null(F.col(name).try_cast("double"))
    tests = [v.isNull()]
    if low is not None:
        tests.append(v < low)
    if high is not None:
        tests.append(v > high)
    return F.coalesce(_any(tests), F.lit(True))


def range_violations(df: DataFrame) -> DataFrame:
    """V9: invalid values per ruled column that is present."""
    names = [c for c in RANGE_RULES if c in df.columns]
    return df.agg(*[F.count_if(out_of_range(c)).alias(c) for c in names]).unpivot([], names, "variable", "invalid")


def weather_variability(df: DataFrame) -> DataFrame:
    """Per weather column, does any city-day hold two different values?

    Two distinct values exist exactly when the minimum and maximum differ, which needs no distinct counting.
    """
    names = [c for c in WEATHER if c in df.columns]
    day = df.where(F.col("timestamp").isNotNull()).groupBy("city", F.to_date("timestamp").alias("day")).agg(
        *[(F.min(c) < F.max(c)).alias(c) for c in names]
    )
    return day.agg(*[F.coalesce(F.bool_or(F.col(c)), F.lit(False)).alias(c) for c in names]).unpivot(
        [], names, "variable", "varies"
    )


def variability_passed(df: DataFrame) -> DataFrame:
    """Precipitation may stay constant; every other weather column must vary."""
    dry = weather_variability(df).where(F.col("variable") != "precipitation")
    return dry.agg(F.coalesce(F.bool_and("varies"), F.lit(True)).alias("weather_variability_valid"))


# Report texts.
WARN_GAPS = "One or more cities contain non-hourly timestamp gaps."
WARN_BALANCE = "Cities contain different numbers of observations."
WARN_RANGE = "One or more numeric columns contain values outside the configured validation ranges."
WARN_WEATHER = "Weather variables show suspiciously low temporal variability."
WARN_ZONE = "Timestamp column does not contain timezone information."
WARN_AQI = "Numeric AQI target is not present and must be derived."
WARN_CATEGORY = "AQI category column is not present."


def validation_report(df: DataFrame, dataset_path: str = "") -> DataFrame:
    """One row with all counts, warnings, errors and the status. ``timestamp`` is the raw text."""
    absent = missing_columns(df, CANONICAL_COLUMNS)
    ruled = [c for c in RANGE_RULES if c in df.columns]
    parsed = df.withColumn("timestamp", F.try_to_timestamp("timestamp")) if "timestamp" in df.columns else df
    keyed = {"city", "timestamp"} <= set(df.columns)
    per_row_missing = reduce(lambda a, b: a + b, [is_missing(df, c).cast("int") for c in df.columns])
    parts = [
        df.agg(
            F.count("*").alias("row_count"),
            F.coalesce(F.sum(per_row_missing), F.lit(0)).cast("long").alias("missing_values"),
            F.struct(*[F.count_if(out_of_range(c)).alias(c) for c in ruled]).alias("invalid_counts"),
        ),
        duplicate_rows(df),
    ]
    if "timestamp" in df.columns:
        parts.append(timestamp_text(df))
    if keyed:
        known = parsed.where(F.col("timestamp").isNotNull())
        parts += [
            balance(parsed),
            continuity(known).agg(F.bool_and("continuous").alias("hourly_continuity")),
            variability_passed(parsed),
        ]
    out = one_row(*parts)
    fallback = {"invalid_timestamps": F.lit(0).cast("long"), "timezone_present": F.lit(False),
                "city_count": F.lit(0).cast("long"), "balanced_cities": F.lit(False),
                "expected_rows_per_city": F.lit(None).cast("long"), "hourly_continuity": F.lit(False),
                "weather_variability_valid": F.lit(False)}
    for name, value in fallback.items():
        if name not in out.columns:
            out = out.withColumn(name, value)
    parsed_all = (F.col("invalid_timestamps") == 0) & F.lit("timestamp" in df.columns)
    usable = parsed_all & F.lit(keyed)
    invalid = F.map_filter(
        F.create_map(*[x for c in ruled for x in (F.lit(c), F.col(f"invalid_counts.{c}"))]), lambda k, v: v > 0
    )
    out = out.withColumns(
        {
            "dataset_path": F.lit(dataset_path),
            "column_count": F.lit(len(df.columns)),
            "hourly_continuity": usable & F.col("hourly_continuity"),
            "balanced_cities": usable & F.col("balanced_cities"),
            "expected_rows_per_city": F.when(usable, F.col("expected_rows_per_city")),
            "timezone_present": parsed_all & F.col("timezone_present"),
            "numeric_aqi_present": F.lit("aqi" in df.columns),
            "aqi_category_present": F.lit("aqi_category" in df.columns),
            "required_columns_present": F.lit(not absent),
            "missing_required_columns": F.array(*[F.lit(c) for c in absent]).cast("array<string>"),
            "invalid_numeric_ranges": invalid,
        }
    )

    def when(condition, text):
        return F.when(condition, text if isinstance(text, Column) else F.lit(text))

    warnings = F.array_compact(
        F.array(
            when(F.col("missing_values") > 0,
                 F.format_string("Dataset contains %d missing values.", F.col("missing_values"))),
            when(F.col("duplicate_rows") > 0,
                 F.format_string("Dataset contains %d duplicate rows.", F.col("duplicate_rows"))),
            when(parsed_all & ~F.col("timezone_present"), WARN_ZONE),
            when(usable & ~F.col("hourly_continuity"), WARN_GAPS),
            when(usable & ~F.col("balanced_cities"), WARN_BALANCE),
            when(F.size("invalid_numeric_ranges") > 0, WARN_RANGE),
            when(~F.col("weather_variability_valid"), WARN_WEATHER),
            when(~F.col("numeric_aqi_present"), WARN_AQI),
            when(~F.col("aqi_category_present"), WARN_CATEGORY),
        )
    )
    errors = F.array_compact(
        F.array(
            when(F.lit(bool(absent)), "Missing required columns: " + ", ".join(absent)),
            when(F.col("invalid_timestamps") > 0,
                 F.format_string("%d timestamps could not be parsed.", F.col("invalid_timestamps"))),
        )
    )
    out = out.withColumns({"warnings": warnings, "errors": errors})
    status = F.when(F.size("errors") > 0, "FAIL").when(F.size("warnings") > 0, "REVIEW").otherwise("PASS")
    return out.withColumn("status", status).select(
        "dataset_path", "row_count", "column_count", "city_count", "missing_values", "duplicate_rows",
        "hourly_continuity", "balanced_cities", "expected_rows_per_city", "timezone_present",
        "weather_variability_valid", "numeric_aqi_present", "aqi_category_present", "required_columns_present",
        "missing_required_columns", "invalid_numeric_ranges", "warnings", "errors", "status",
    )


def negative_counts(df: DataFrame, columns: list[str] = NON_NEGATIVE) -> DataFrame:
    """V12."""
    return df.agg(*[F.count_if(F.col(c) < 0).alias(c) for c in columns]).unpivot([], columns, "variable", "negative")


def require_non_negative(df: DataFrame, columns: list[str] = NON_NEGATIVE) -> DataFrame:
    bad = [r["variable"] for r in negative_counts(df, columns).where(F.col("negative") > 0).collect()]
    if bad:
        raise ValueError(f"negative values in non-negative fields: {sorted(bad)}")
    return df


def minimum_history(df: DataFrame, minimum: int, counted: Column | None = None) -> DataFrame:
    """Rows (or rows meeting ``counted``) per city against a minimum: 97 raw hours, 73 hours with AQI."""
    n = F.count("*") if counted is None else F.count_if(counted)
    return df.groupBy("city").agg(n.alias("rows")).withColumn("enough", F.col("rows") >= minimum)


def feature_health(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Missing and infinite cells per feature."""
    require_columns(df, columns, "feature table")
    wide = df.agg(
        *[
            F.struct(
                F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias("missing"),
                F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias("infinite"),
            ).alias(c)
            for c in columns
        ]
    )
    long = wide.unpivot([], columns, "feature", "_s")
    return long.select("feature", "_s.missing", "_s.infinite")


def healthy(columns: list[str] = FEATURES) -> Column:
    """Row predicate: every feature present and finite."""
    d = [F.col(c).cast("double") for c in columns]
    bad = _any([c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in d])
    return ~F.coalesce(bad, F.lit(True))


def dataset_contract(df: DataFrame, rows=None, cities=None, start=None, end=None, ts: str = "timestamp") -> DataFrame:
    """Found against expected; an expectation of None is not checked."""
    found = df.agg(
        F.count("*").alias("rows"), F.count_distinct("city").alias("cities"), F.min(ts).alias("start"),
        F.max(ts).alias("end"),
    )
    kind = df.schema[ts].dataType
    checks = [("rows", rows, "long"), ("cities", cities, "long"), ("start", start, kind), ("end", end, kind)]
    ok = reduce(
        lambda a, b: a & b,
        [F.col(n) == F.lit(v).cast(t) for n, v, t in checks if v is not None],
        F.lit(True),
    )
    return found.withColumn("passed", ok)


def clip_negatives(df: DataFrame, columns: list[str] = POLLUTANTS_WITH_DUST) -> DataFrame:
    """Negative pollutant values become zero."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns(
        {c: F.when(F.col(c) < 0, F.lit(0).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in present}
    )


def clip_report(df: DataFrame, columns: list[str] = POLLUTANTS_WITH_DUST) -> DataFrame:
    """What ``clip_negatives`` changes, per pollutant."""
    present = [c for c in columns if c in df.columns]
    wide = df.agg(
        *[
            F.struct(
                F.count_if(F.col(c) < 0).alias("values_clipped"),
                F.min(F.when(F.col(c) < 0, F.col(c).cast("double"))).alias("minimum_before"),
                F.lit(0.0).alias("replacement"),
            ).alias(c)
            for c in present
        ]
    )
    return wide.unpivot([], present, "variable", "_s").select("variable", "_s.*")


def exclude_cities(df: DataFrame, names: list[str]) -> DataFrame:
    """V17."""
    return df.where(~F.col("city").isin(*names)) if names else df


def canonical(df: DataFrame, columns: list[str] = CANONICAL_COLUMNS) -> DataFrame:
    """Checked columns in their fixed order; sorting is left to the sink."""
    return require_columns(df, columns, "canonical input").select(*columns)


def row_conservation(before: DataFrame, after: DataFrame, excluded: list[str]) -> DataFrame:
    """Rows removed must be exactly those of the excluded cities."""
    a = before.agg(
        F.count("*").alias("input_rows"), F.count_if(F.col("city").isin(*excluded)).alias("excluded_rows")
    )
    out = one_row(a, after.agg(F.count("*").alias("output_rows")))
    return out.withColumn("passed", F.col("input_rows") - F.col("excluded_rows") == F.col("output_rows"))


def history_health(df: DataFrame, minimum: int = 97) -> DataFrame:
    """V1, V2, V4, V7, V12, V13 for a live history: one row per city with the reasons it would be refused."""
    require_columns(df, HISTORY_COLUMNS, "history")
    cells = df.groupBy("city").agg(
        F.count("*").alias("rows"),
        F.count_if(_any([is_missing(df, c) for c in HISTORY_COLUMNS])).alias("rows_with_missing"),
        F.count_if(_any([F.col(c) < 0 for c in NON_NEGATIVE])).alias("rows_with_negative"),
    )
    grid = continuity(df).select("city", "continuous", (F.col("rows") - F.col("distinct_hours")).alias("repeated"))
    out = cells.join(grid, "city")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("rows") < minimum, F.lit("too_short")),
            F.when(F.col("rows_with_missing") > 0, F.lit("missing_values")),
            F.when(F.col("repeated") > 0, F.lit("duplicate_timestamps")),
            F.when(~F.col("continuous"), F.lit("not_hourly")),
            F.when(F.col("rows_with_negative") > 0, F.lit("negative_values")),
        )
    )
    return out.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0)
