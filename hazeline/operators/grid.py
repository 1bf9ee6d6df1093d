"""The hourly grid: time blocks with a halo, continuity checks, spine.

A window over a whole station puts all its rows into one task. On an hourly grid every look-back and look-ahead is
bounded, so rows are windowed per ``(city, block of hours)`` instead; each block also receives the neighbouring rows
its edges need (the halo), which are dropped afterwards. The answer is that of the plain window, with parallelism that
grows with the length of the history rather than with the number of stations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.schema import KEYS, epoch_hours, epoch_seconds, hours, is_ntz

BLOCK_HOURS = 2160
BLOCK = "_block"
HOME = "_home_block"


def with_halo(
    df: DataFrame, lookback: int = 0, lookahead: int = 0, block_hours: int = BLOCK_HOURS, ts: str = "timestamp"
) -> DataFrame:
    """Copy each row into every block that needs it.

    A row at hour h is read by rows in [h - lookahead, h + lookback].
    """
    h = epoch_hours(F.col(ts))
    first = F.floor((h - lookahead) / block_hours)
    last = F.floor((h + lookback) / block_hours)
    return df.withColumn(HOME, F.floor(h / block_hours)).withColumn(BLOCK, F.explode(F.sequence(first, last)))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(F.col(BLOCK) == F.col(HOME)).drop(BLOCK, HOME)


def block_window(key: str = "city", ts: str = "timestamp"):
    return Window.partitionBy(key, BLOCK).orderBy(ts)


def at_hour(value, n: int, window, ts: str = "timestamp"):
    """The value ``n`` hours before (after, if negative). NULL if the row that many steps away is of another hour: a gap lies between."""
    step = F.lag if n >= 0 else F.lead
    return F.when(step(ts, abs(n)).over(window) == F.col(ts) - hours(n), step(value, abs(n)).over(window))


def full_window(value, n: int, window, agg, ts: str = "timestamp"):
    """``agg`` over the last ``n`` hours, NULL until all ``n`` values are present without a gap."""
    frame = window.rowsBetween(-(n - 1), 0)
    whole = F.min(ts).over(frame) == F.col(ts) - hours(n - 1)
    return F.when((F.count(value).over(frame) == n) & whole, agg(frame))


def previous_row(df: DataFrame, keys: list[str], ts: str = "timestamp", block_hours: int = BLOCK_HOURS) -> DataFrame:
    """Adds ``previous``: the time of the preceding row per key, however far back it lies.

    Within a block it is an ordinary ``lag``. The first row of a block takes the last time of the nearest earlier block,
    found from one (min, max) row per block, so no task ever holds a whole key.
    """
    blocked = df.withColumn(BLOCK, F.floor(epoch_hours(F.col(ts)) / block_hours))
    inside = Window.partitionBy(*keys, BLOCK).orderBy(ts)
    edges = blocked.groupBy(*keys, BLOCK).agg(F.max(ts).alias("_last"))
    edges = edges.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy(BLOCK))).drop("_last")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in [*keys, BLOCK]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    rows = blocked.withColumn("_lag", F.lag(ts).over(inside))
    return (
        rows.alias("r")
        .join(edges.alias("e"), on, "left")
        .select(*[F.col(f"r.{c}") for c in df.columns], F.coalesce(F.col("r._lag"), F.col("e._carry")).alias("previous"))
    )


def gaps(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """V7: every step between consecutive rows of a city that is not exactly one hour (zero for a repeated hour)."""
    step = epoch_seconds(F.col(ts)) - epoch_seconds(F.col("previous"))
    return (
        previous_row(df.select("city", ts), ["city"], ts)
        .where(F.col("previous").isNotNull() & (step != 3600))
        .select("city", "previous", F.col(ts).alias("current"), (step / F.lit(3600.0)).alias("gap_hours"))
    )


def first_gaps(df: DataFrame, limit: int = 5) -> DataFrame:
    """The first few gaps per city, as the error report lists them."""
    rank = F.row_number().over(Window.partitionBy("city").orderBy("current", "previous"))
    return gaps(df).withColumn("gap_number", rank).where(F.col("gap_number") <= limit)


def gap_counts(df: DataFrame, ts: str = "timestamp", block_hours: int = 24) -> DataFrame:
    """Cities with at least one non-hourly step.

    Rows of one time are counted before the shuffle, each repetition being a step of its own; what is ordered are the distinct
    times of a block, and one row per block where blocks meet.
    """
    times = df.where(F.col(ts).isNotNull()).groupBy("city", ts).agg(F.count("*").alias("_n"))
    step = epoch_seconds(F.col(ts)) - epoch_seconds(F.col("previous"))
    found = previous_row(times, ["city"], ts, block_hours).groupBy("city").agg(
        (F.sum(F.col("_n") - 1) + F.count_if(F.col("previous").isNotNull() & (step != 3600))).alias("non_hourly_gaps")
    )
    return found.where("non_hourly_gaps > 0")


def continuity(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """One row per city: does it hold exactly one row for every hour between its first and its last?

    Counting needs no sort and combines before the shuffle, so it is the form used as a gate.
    """
    t = F.col(ts)
    per_hour = df.groupBy("city", t.alias("_t")).agg(F.count("*").alias("_n"))
    span = (epoch_seconds(F.max("_t")) - epoch_seconds(F.min("_t"))) / F.lit(3600.0) + 1
    offset = F.pmod(epoch_seconds(F.col("_t")), F.lit(3600))
    return per_hour.groupBy("city").agg(
        F.sum("_n").alias("rows"),
        F.count("*").alias("distinct_hours"),
        F.min("_t").alias("start"),
        F.max("_t").alias("end"),
        (
            (F.count("*") == F.sum("_n"))
            & (span == F.count("*"))
            & (F.min(offset) == F.max(offset))
        ).alias("continuous"),
    )


def require_continuous(df: DataFrame) -> DataFrame:
    """Gaps are an error, not a fill."""
    broken = [r["city"] for r in continuity(df).where(~F.col("continuous")).select("city").limit(20).collect()]
    if broken:
        raise ValueError(f"Input data must contain continuous hourly observations for every city: {broken}")
    return df


def quarantine_gaps(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(continuous cities, the other rows), so that one bad city does not stop the job."""
    bad = continuity(df).where(~F.col("continuous")).select("city")
    return df.join(bad, "city", "left_anti"), df.join(bad, "city", "left_semi")


def spine(df: DataFrame, ts: str = "timestamp", key: str = "city") -> DataFrame:
    """Every hour of every day that a city's data touches: (city, timestamp)."""
    naive = is_ntz(df, ts)
    bounds = df.groupBy(key).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    start, end = F.date_trunc("day", F.col("_a")), F.date_trunc("day", F.col("_b")) + hours(23)
    hour = F.explode(F.sequence(start, end, F.expr("INTERVAL 1 HOUR"))).alias("_h")
    out = bounds.select(key, hour)
    return out.select(F.col(key), (F.col("_h").cast("timestamp_ntz") if naive else F.col("_h")).alias("timestamp"))


def missing_hours(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Hours of the spine that hold no row."""
    return spine(df, ts).join(df.select("city", F.col(ts).alias("timestamp")).distinct(), KEYS, "left_anti")


def hours_behind(history: DataFrame, readings: DataFrame) -> DataFrame:
    """Whole hours between the newest stored hour and the newest reading, per city."""
    stored = history.groupBy("city").agg(F.max("timestamp").alias("latest_history"))
    fresh = readings.groupBy("city").agg(F.max("timestamp").alias("reading"))
    gap = epoch_hours(F.col("reading")) - epoch_hours(F.col("latest_history"))
    return fresh.join(stored, "city", "left").withColumn("gap_hours", gap.cast("long"))
