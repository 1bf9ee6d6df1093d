"""Top rows, de-duplication, samples, checked joins, point-in-time join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.operators.quality import require_unique
from hazeline.schema import KEYS, epoch_hours

SALTS = 32


def newest_n(df: DataFrame, keys: list[str], order: list[Column], n: int, salts: int = SALTS) -> DataFrame:
    """K1: the first ``n`` rows per key in ``order`` (which must be total).

    Ranked first within a salted part of each key, then over the survivors, so a hot key is spread over ``salts`` tasks
    and its last task sees at most ``salts * n`` rows.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    part = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
    whole = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = salted.withColumn("_rank", part).where(F.col("_rank") <= n)
    return kept.withColumn("_rank", whole).where(F.col("_rank") <= n).drop("_rank", "_salt")


def newest_hours(df: DataFrame, n: int) -> DataFrame:
    """K1 on the panel: the newest ``n`` hours per city (24, 48, 72, 168; 168 kept; 120 at bootstrap)."""
    return newest_n(df, ["city"], [F.col("timestamp").desc()], n)


def dedupe(df: DataFrame, keys: list[str], order: list[Column], keep: str = "last") -> DataFrame:
    """K2: one row per key, the last or first in ``order``.

    A maximum over (order, row) combines before the shuffle; copies of a hot key never meet in one task.
    """
    if keep not in ("last", "first"):
        raise ValueError("keep must be 'last' or 'first'")
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def completed_hours(df: DataFrame, as_of) -> DataFrame:
    """K3: hours before the hour of ``as_of``."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return df.where(F.col("timestamp") < F.date_trunc("hour", now))


def build_master(frames: list[DataFrame], validate: bool = True) -> DataFrame:
    """K4: union of city panels with a unique (city, timestamp)."""
    master = reduce(lambda a, b: a.unionByName(b), frames)
    return require_unique(master, KEYS, "Master dataset") if validate else master


def _draw(*parts: Column) -> Column:
    """Reproducible pseudo-random order from integers, with the same arithmetic in any SQL engine."""
    x = F.lit(42).cast("long")
    for p in parts:
        x = F.pmod((x + p.cast("long")) * F.lit(48271), F.lit(2147483647).cast("long"))
    for _ in range(2):
        x = F.pmod(x * F.lit(48271), F.lit(2147483647).cast("long"))
    return x


def sample_per_city(df: DataFrame, n: int = 10) -> DataFrame:
    """K5: fixed-size reproducible sample of hours per city."""
    drawn = df.withColumn("_draw", _draw(epoch_hours(F.col("timestamp"))))
    return newest_n(drawn, ["city"], [F.col("_draw"), F.col("timestamp")], n).drop("_draw")


def sample_rows(df: DataFrame, n: int = 2000) -> DataFrame:
    """K6: fixed-size reproducible sample of the whole panel."""
    drawn = df.withColumn("_draw", _draw(epoch_hours(F.col("timestamp")), F.ascii("city")))
    return drawn.orderBy("_draw", "timestamp", "city").limit(n).drop("_draw")


def key_differences(a: DataFrame, b: DataFrame, key: str = "city") -> DataFrame:
    """K7: values that only one side has; empty means the sets are equal."""
    both = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    seen = both.groupBy(key).agg(F.max("_a").alias("in_left"), F.max("_b").alias("in_right"))
    return seen.where(F.col("in_left") != F.col("in_right"))


def sorted_output(df: DataFrame, *columns) -> DataFrame:
    """K8: total order for a sink; a range-partitioned sort, so no single task receives all rows."""
    return df.orderBy(*columns)


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str] = KEYS, validate: bool = True) -> DataFrame:
    """Inner join after checking that both sides are unique on the key."""
    if validate:
        require_unique(left, keys, "left side")
        require_unique(right, keys, "right side")
    return left.join(right, keys)


def overlap_count(a: DataFrame, b: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Keys of ``a`` that also occur in ``b``."""
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_semi").agg(F.count("*").alias("overlap"))


def common_keys(validation: DataFrame, other: DataFrame, target: str, keys: list[str] = KEYS) -> DataFrame:
    """Validation rows that another model also predicted; ``other`` has ``y_true`` and ``y_pred``."""
    theirs = other.select(*keys, F.col("y_true").alias("other_y_true"), F.col("y_pred").alias("other_prediction"))
    return validation.join(theirs, keys)


def agreement(common: DataFrame, target: str, expected_rows: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Rows, cities and largest target difference of the common rows, and whether they may be compared."""
    diff = F.max(F.abs(F.col(target).cast("double") - F.col("other_y_true").cast("double")))
    ok = F.coalesce(F.col("max_target_difference") <= tolerance, F.lit(False))
    if expected_rows is not None:
        ok = ok & (F.col("rows") == expected_rows)
    return common.agg(
        F.count("*").alias("rows"), F.count_distinct("city").alias("cities"), diff.alias("max_target_difference")
    ).withColumn("passed", ok)


# Point-in-time join -----------------------------------------------------------------------------------------------


def _last_before(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Per (key, bucket) that is asked about, the newest feature row of any earlier bucket, as a row of the asked bucket.

    ``rows`` combine to one row per (key, bucket) before the shuffle; the pass over buckets sees no other rows.
    """
    last = rows.groupBy("_key", "_bucket").agg(F.max_by(F.struct("_at", "_version", "_row"), F.struct("_at", "_version")).alias("_last"))
    wanted = asked.select("_key", "_bucket").distinct().withColumn("_asked", F.lit(True))
    slots = last.join(wanted, ["_key", "_bucket"], "full")
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier))
    return carried.where(F.col("_asked") & F.col("_carried").isNotNull()).select("_key", "_bucket", "_carried.*")


def asof_join(
    lookups: DataFrame,
    features: DataFrame,
    key: str = "city_id",
    ts: str = "event_timestamp",
    created: str | None = None,
    ttl_hours: int = 168,
    bucket_hours: int = 24,
) -> DataFrame:
    """For each look-up the newest feature row not later than it and not older than the TTL, else NULLs.

    Feature rows and the distinct (key, time) that are asked about form one union; inside a (key, bucket of hours) the last
    feature row is carried forward, and each bucket starts with the row carried over from the buckets before it. The work
    grows with the rows, however many of them share a bucket. Look-ups of one (key, time) are asked once and take their answer
    in an ordinary join, whose skew adaptive execution splits. Look-ups or feature rows without a key or time match nothing.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    place = {"_key": F.col(key), "_at": micros, "_bucket": F.floor(micros / (bucket_hours * 3_600_000_000))}
    names = [c for c in features.columns if c not in (key, ts)]
    version = F.col(created) if created else F.lit(None).cast("timestamp")
    known = features.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        *[c.alias(n) for n, c in place.items()], version.alias("_version"),
        F.struct(F.col(ts).alias("feature_timestamp"), *names).alias("_row"),
    )
    asked = lookups.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(*[c.alias(n) for n, c in place.items()]).distinct()
    union = known.withColumn("_asks", F.lit(0)).unionByName(
        _last_before(known, asked).withColumn("_asks", F.lit(0))
    ).unionByName(asked.withColumn("_asks", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy("_key", "_bucket").orderBy("_at", "_asks", "_version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answers = union.withColumn("_found", F.last("_row", ignorenulls=True).over(upto)).where("_asks = 1")
    age = F.col("_at") - F.unix_micros(F.col("_found.feature_timestamp").cast("timestamp"))
    answers = answers.where(age <= ttl_hours * 3_600_000_000).select("_key", F.col("_at").alias("_found_at"), "_found")
    left = lookups.withColumn("_at", micros)
    same = (F.col(f"l.{key}") == F.col("a._key")) & (F.col("l._at") == F.col("a._found_at"))
    return left.alias("l").join(answers.alias("a"), same, "left").select(
        *[F.col(f"l.{c}") for c in lookups.columns], *[F.col(f"a._found.{c}") for c in ("feature_timestamp", *names)]
    )


def attach_targets(retrieved: DataFrame, targets: DataFrame, names: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Left join of targets onto retrieved features."""
    return retrieved.join(targets.select(*keys, *names), keys, "left")


def unattached(joined: DataFrame, names: list[str]) -> DataFrame:
    """Rows left without a target."""
    return joined.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in names])


def same_hour(weather: DataFrame, pollution: DataFrame, ts_weather: str = "weather_at", ts_pollution: str = "pollution_at"):
    """H2: pairs of readings of a city, with whether both fall in one UTC hour."""
    joined = weather.join(pollution, "city")
    return joined.withColumn(
        "same_hour", F.date_trunc("hour", F.col(ts_weather)) == F.date_trunc("hour", F.col(ts_pollution))
    )


