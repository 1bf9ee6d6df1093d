"""Distribution reports and source comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.functions import aqi
from hazeline.functions.exact import corr_of, exact, exact_avg, exact_std, is_close, mean_of
from hazeline.operators.quality import duplicate_keys, is_missing
from hazeline.operators.quantiles import bounded_quantiles, exact_quantiles
from hazeline.schema import (
    CATEGORY_ORDER,
    HORIZONS,
    KEYS,
    POLLUTANTS,
    SHORT_CATEGORY_ORDER,
    TARGETS,
    WEATHER,
    one_row,
)

AUDIT_SCALE = 8
DESCRIBE_PROBS = [0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99, 0.999]
DESCRIBE_NAMES = ["p1", "p5", "p25", "p50", "p75", "p95", "p99", "p999"]


def _exact_long(df: DataFrame, columns: list[str], ids: list[str] = ()) -> DataFrame:
    """(ids, variable, value) with exact values."""
    typed = df.select(*ids, *[exact(F.col(c), AUDIT_SCALE).alias(c) for c in columns])
    return typed.unpivot(list(ids), columns, "variable", "value").where(F.col("value").isNotNull())


def _named(column: str, names: list[str]) -> list:
    return [F.col(column)[i].alias(n) for i, n in enumerate(names)]


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A1: count, mean, spread, extremes and percentiles per numeric column."""
    names = columns or [c for c in ["latitude", "longitude", *POLLUTANTS, "dust", *WEATHER] if c in df.columns]
    long = _exact_long(df, names)
    moments = long.groupBy("variable").agg(
        F.count("value").alias("count"),
        exact_avg(F.col("value")).alias("mean"),
        exact_std(F.col("value")).alias("std"),
        F.min("value").cast("double").alias("min"),
        F.max("value").cast("double").alias("max"),
    )
    q = exact_quantiles(long, ["variable"], "value", DESCRIBE_PROBS)
    return moments.join(q, "variable").select(
        "variable", "count", "mean", "std", "min", *_named("quantiles", DESCRIBE_NAMES), "max"
    )


def negative_audit(df: DataFrame, columns: list[str] = POLLUTANTS) -> DataFrame:
    """A2: negative values per pollutant with the cities they come from."""
    per_city = df.groupBy("city").agg(
        F.count("*").alias("_rows"),
        *[
            F.struct(
                F.count_if(F.col(c) < 0).alias("n"), F.min(F.when(F.col(c) < 0, F.col(c).cast("double"))).alias("least")
            ).alias(c)
            for c in columns
        ],
    )
    long = per_city.unpivot(["city", "_rows"], columns, "variable", "_s")
    return long.groupBy("variable").agg(
        F.sum("_s.n").alias("negative_count"),
        (F.sum("_s.n") / F.sum("_rows") * 100).alias("percentage"),
        F.min("_s.least").alias("minimum"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("_s.n") > 0, F.col("city")))), ", ").alias("cities"),
    )


def extreme_audit(df: DataFrame, columns: list[str] = POLLUTANTS) -> DataFrame:
    """A3: upper tail per pollutant and where its maximum lies (first city, then first hour, on a tie)."""
    long = _exact_long(df, columns, KEYS)
    top = F.min(F.struct((-F.col("value")).alias("neg"), "city", "timestamp"))
    moments = long.groupBy("variable").agg(exact_avg(F.col("value")).alias("mean"), top.alias("_top"))
    q = exact_quantiles(long, ["variable"], "value", [0.95, 0.99, 0.999])
    return moments.join(q, "variable").select(
        "variable",
        "mean",
        *_named("quantiles", ["p95", "p99", "p999"]),
        (-F.col("_top.neg")).cast("double").alias("max"),
        F.col("_top.city").alias("max_city"),
        F.col("_top.timestamp").alias("max_timestamp"),
    )


def city_statistics(df: DataFrame, columns: list[str] = POLLUTANTS) -> DataFrame:
    """A4: mean, spread, minimum and maximum per city and pollutant, flattened."""
    aggs = []
    for c in columns:
        v = exact(F.col(c), AUDIT_SCALE)
        aggs += [exact_avg(v).alias(f"{c}_mean"), exact_std(v).alias(f"{c}_std"),
                 F.min(v).cast("double").alias(f"{c}_min"), F.max(v).cast("double").alias(f"{c}_max")]
    return df.groupBy("city").agg(*aggs)


def coverage(df: DataFrame) -> DataFrame:
    """A5: rows, cities, range, duplicate keys and missing cells of a panel."""
    per_row = reduce(lambda a, b: a + b, [is_missing(df, c).cast("int") for c in df.columns])
    counts = df.agg(
        F.count("*").alias("rows"),
        F.count_distinct("city").alias("cities"),
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
        F.sum(per_row).alias("missing_cells"),
    )
    return one_row(counts, duplicate_keys(df, KEYS))


# J3, J4, A6, A7 ---------------------------------------------------------------------------------------------------

PAIR_METRICS = ["matched_rows", "correlation", "mae", "exact_match_pct", "near_match_pct"]


def _pair_metrics(a, b):
    """A6 as one struct of aggregates over exact columns a, b; rows where either side is missing do not count."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    n = F.count(x)
    return F.struct(
        n.alias("matched_rows"),
        corr_of(n, F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)).alias("correlation"),
        mean_of(F.sum(F.abs(x - y)), n).alias("mae"),
        (F.try_divide(F.count_if(both & is_close(x, y, 0.0, 1e-12)), n) * 100).alias("exact_match_pct"),
        (F.try_divide(F.count_if(both & is_close(x, y, 1e-5, 0.05)), n) * 100).alias("near_match_pct"),
    )


def city_pairs(df: DataFrame) -> DataFrame:
    """All unordered pairs of the cities found: each name with the names behind it in the sorted list of all."""
    names = df.where("city IS NOT NULL").agg(F.array_sort(F.collect_set("city")).alias("names"))
    firsts = names.select("names", F.posexplode("names").alias("i", "city_a"))
    return firsts.select("city_a", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("city_b"))


def city_similarity(df: DataFrame, pairs: DataFrame | None = None, columns: list[str] = POLLUTANTS) -> DataFrame:
    """J3 + A6: metrics of each listed pair and pollutant over equal hours.

    The pair list drives an equi-join on (city, hour): the key is fine enough that no city or hour is a hot group, and
    the metrics combine in the join's own tasks before the shuffle.
    """
    pairs = pairs if pairs is not None else city_pairs(df)
    values = df.select(*KEYS, *[exact(F.col(c)).alias(c) for c in columns])
    left = values.withColumnRenamed("city", "city_a").join(pairs, "city_a")
    left = left.select("city_a", "city_b", "timestamp", *[F.col(c).alias(f"a_{c}") for c in columns])
    right = values.withColumnRenamed("city", "city_b")
    wide = left.join(right, ["city_b", "timestamp"]).groupBy("city_a", "city_b").agg(
        *[_pair_metrics(F.col(f"a_{c}"), F.col(c)).alias(c) for c in columns]
    )
    found = wide.unpivot(["city_a", "city_b"], columns, "pollutant", "_m").select(
        "city_a", "city_b", "pollutant", "_m.*"
    )
    # A pair without a common hour still gets its rows, with zero matches.
    every = pairs.select("*", F.explode(F.array(*map(F.lit, columns))).alias("pollutant"))
    return every.join(found, ["city_a", "city_b", "pollutant"], "left").fillna(0, subset=["matched_rows"])


def suspicious_pairs(similarity: DataFrame, correlation: float = 0.999, near_pct: float = 99.0) -> DataFrame:
    """Near-duplicate series."""
    return similarity.where((F.col("correlation") >= correlation) | (F.col("near_match_pct") >= near_pct))


def named_pair(similarity: DataFrame, a: str, b: str) -> DataFrame:
    """The rows of one pair of cities, in either order."""
    return similarity.where(F.col("city_a").isin(a, b) & F.col("city_b").isin(a, b))


def source_overlap(existing: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Agreement of two sources per variable over common (city, hour)."""
    a = existing.select(*KEYS, *[exact(F.col(c)).alias(f"a_{c}") for c in columns])
    b = new.select(*KEYS, *[exact(F.col(c)).alias(f"b_{c}") for c in columns])
    aggs = []
    for c in columns:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        both = x.isNotNull() & y.isNotNull()
        aggs.append(
            F.struct(
                _pair_metrics(x, y).alias("m"),
                exact_avg(F.when(both, x)).alias("existing_mean"),
                exact_avg(F.when(both, y)).alias("new_mean"),
            ).alias(c)
        )
    return a.join(b, KEYS).agg(*aggs).unpivot([], columns, "variable", "_s").select(
        "variable",
        F.col("_s.m.matched_rows").alias("matched_rows"),
        F.col("_s.m.correlation").alias("correlation"),
        F.col("_s.m.mae").alias("mae"),
        F.col("_s.existing_mean").alias("existing_mean"),
        F.col("_s.new_mean").alias("new_mean"),
    )


# Index distributions ----------------------------------------------------------------------------------------------


def _moments(c) -> list:
    x = c.cast("long")
    return [
        F.count(x).alias("rows"),
        exact_avg(x).alias("mean"),
        exact_std(x).alias("std"),
        F.min(x).cast("double").alias("minimum"),
        F.max(x).cast("double").alias("maximum"),
    ]


def aqi_summary(df: DataFrame, by: str) -> DataFrame:
    """By ``year``, ``month`` or ``city``, rounded to two places."""
    rows = _with_period(df.where(F.col("aqi_current").isNotNull()), by)
    out = rows.groupBy(by).agg(*_moments(F.col("aqi_current")))
    out = out.join(bounded_quantiles(rows, [by], "aqi_current", [0.5]), by)
    shown = {"mean": F.col("mean"), "median": F.col("quantiles")[0], "std": F.col("std")}
    return out.select(by, "rows", *[F.round(c, 2).alias(n) for n, c in shown.items()], "minimum", "maximum")


def _with_period(df: DataFrame, by: str) -> DataFrame:
    if by == "year":
        return df.withColumn("year", F.year("timestamp"))
    if by == "month":
        return df.withColumn("month", F.month("timestamp"))
    return df


def category_table(df: DataFrame, by: str) -> DataFrame:
    """Counts and row percentages per period and category; one pass, no pivot job."""
    rows = _with_period(df.where(F.col("aqi_category").isNotNull()), by)
    name = {c: c.lower().replace(" ", "_") for c in CATEGORY_ORDER}
    counts = rows.groupBy(by).agg(
        F.count("*").alias("_n"), *[F.count_if(F.col("aqi_category") == c).alias(f"{name[c]}_rows") for c in CATEGORY_ORDER]
    )
    share = [F.round(F.col(f"{name[c]}_rows") / F.col("_n") * 100, 2).alias(f"{name[c]}_pct") for c in CATEGORY_ORDER]
    return counts.select(by, *[f"{name[c]}_rows" for c in CATEGORY_ORDER], *share)


def value_shares(df: DataFrame, column: str, places: int = 2) -> DataFrame:
    """Rows and share of each value among the known ones."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows").alias("_total")).withColumn("_k", F.lit(1))
    out = counts.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k")
    return out.select(column, "rows", F.round(F.col("rows") / F.col("_total") * 100, places).alias("percentage"))


def _targets_long(df: DataFrame, group: str) -> DataFrame:
    long = df.select(group, *[F.col(t).cast("long").alias(f"{h}h") for t, h in zip(TARGETS, HORIZONS)])
    return long.unpivot([group], [f"{h}h" for h in HORIZONS], "horizon", "value")


def target_summary(df: DataFrame, group: str = "split") -> DataFrame:
    """Distribution of each target per split."""
    long = _targets_long(df, group)
    x = F.col("value")
    moments = long.groupBy(group, "horizon").agg(
        F.count(x).alias("count"), exact_avg(x).alias("mean"), exact_std(x).alias("std"),
        F.min(x).cast("double").alias("min"), F.max(x).cast("double").alias("max"),
    )
    q = bounded_quantiles(long, [group, "horizon"], "value", [0.25, 0.5, 0.75])
    return moments.join(q, [group, "horizon"]).select(
        group, "horizon", "count", "mean", F.col("quantiles")[1].alias("median"), "std", "min",
        F.col("quantiles")[0].alias("q25"), F.col("quantiles")[2].alias("q75"), "max",
    )


def target_categories(df: DataFrame, group: str = "split") -> DataFrame:
    """Every category per split and horizon, zeros included: counted side by side, then stacked."""
    long = _targets_long(df, group).withColumn("category", aqi.short_category(F.col("value")))
    wide = long.groupBy(group, "horizon").agg(
        F.count("value").alias("_n"), *[F.count_if(F.col("category") == c).alias(c) for c in SHORT_CATEGORY_ORDER]
    )
    out = wide.unpivot([group, "horizon", "_n"], SHORT_CATEGORY_ORDER, "category", "count")
    share = F.coalesce(F.try_divide(F.lit(100.0) * F.col("count"), F.col("_n")), F.lit(0.0))
    return out.select(group, "horizon", "category", "count", share.alias("percentage"))


def category_by_split(categories: DataFrame, splits: list[str], group: str = "split") -> DataFrame:
    """Percentages with one column per split and the fixed category order."""
    order = F.array_position(F.array(*map(F.lit, SHORT_CATEGORY_ORDER)), F.col("category"))
    aggs = [F.max(F.when(F.col(group) == s, F.col("percentage"))).alias(s) for s in splits]
    return categories.groupBy("horizon", "category").agg(*aggs).withColumn("position", order.cast("int"))


def rows_by_city(df: DataFrame) -> DataFrame:
    """A15."""
    return df.groupBy("city").agg(
        F.count("*").alias("rows"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end")
    )


def rows_by_year(df: DataFrame) -> DataFrame:
    """A15."""
    return df.groupBy(F.year("timestamp").alias("year")).agg(
        F.count("*").alias("rows"), F.count_distinct("city").alias("cities")
    )


def target_completeness(df: DataFrame) -> DataFrame:
    """Missing targets per horizon and rows that are complete."""
    known = F.col("aqi_current").isNotNull()
    targets = reduce(lambda a, b: a & b, [F.col(t).isNotNull() for t in TARGETS])
    return df.agg(
        F.count_if(known).alias("rows_with_current_aqi"),
        F.count_if(targets).alias("rows_with_all_targets"),
        F.count_if(known & targets).alias("complete_rows"),
        *[F.count_if(F.col(t).isNull()).alias(f"missing_{h}h") for t, h in zip(TARGETS, HORIZONS)],
    )


def split_description(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows, cities, range and mean targets per split."""
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_distinct("city").alias("cities"),
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
        *[exact_avg(F.col(t).cast("long")).alias(f"mean_target_{h}h") for t, h in zip(TARGETS, HORIZONS)],
    )


def aqi_distribution(df: DataFrame) -> DataFrame:
    """The whole panel's index, rounded to three places."""
    probs = [0.01, 0.05, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]
    names = ["p1", "p5", "p25", "p50", "p75", "p90", "p95", "p99"]
    moments = df.agg(*_moments(F.col("aqi_current")))
    q = bounded_quantiles(df, [], "aqi_current", probs)
    out = one_row(moments, q)
    return out.select(
        F.col("rows").alias("count"),
        F.round("mean", 3).alias("mean"),
        F.round("std", 3).alias("std"),
        F.col("minimum").alias("min"),
        *[F.round(F.col("quantiles")[i], 3).alias(n) for i, n in enumerate(names)],
        F.col("maximum").alias("max"),
    )
