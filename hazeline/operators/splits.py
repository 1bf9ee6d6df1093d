"""Time-aware splits."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.operators.quality import is_missing
from hazeline.schema import FEATURES, KEYS, TARGETS, epoch_seconds, missing_columns, require_columns

PURGE_HOURS = 72

# Fixed values: (fold, train start, train end, evaluation start, evaluation end), inclusive, UTC.
WALK_FORWARD = [
    ("fold_1", "2022-08-07 23:00:00", "2023-06-30 23:00:00", "2023-07-04 00:00:00", "2023-12-31 23:00:00"),
    ("fold_2", "2022-08-07 23:00:00", "2024-06-30 23:00:00", "2024-07-04 00:00:00", "2024-12-31 23:00:00"),
    ("fold_3", "2022-08-07 23:00:00", "2025-06-30 23:00:00", "2025-07-04 00:00:00", "2025-12-31 23:00:00"),
    ("final", "2022-08-07 23:00:00", "2025-12-31 23:00:00", "2026-01-04 00:00:00", "2026-08-25 23:00:00"),
]


def cut_timestamps(df: DataFrame, fractions: list[float]) -> list[datetime]:
    """The timestamp at position floor(n * fraction) among the n distinct timestamps.

    Distinct times are counted per day, the days holding the positions are found among the day counts, and only those
    days are ordered; no task orders the whole history. The few cut points go to the driver because they become filters.
    """
    times = df.select("timestamp").distinct().withColumn("_day", F.to_date("timestamp"))
    # One row per calendar day: a bounded table, ordered in one task.
    by_day = Window.orderBy("_day")
    upto = F.sum("_n").over(by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("_n").over(by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    days = times.groupBy("_day").agg(F.count("*").alias("_n")).select(
        "_day", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"), total.alias("_total"))
    positions = F.array(*[
        F.struct(F.lit(i).alias("i"), F.floor(F.col("_total") * F.lit(float(f))).alias("at"))
        for i, f in enumerate(fractions)
    ])
    here = F.filter(positions, lambda p: (p["at"] >= F.col("_before")) & (p["at"] < F.col("_upto")))
    wanted = days.select("_day", "_before", F.explode(here).alias("_p"))
    rank = F.row_number().over(Window.partitionBy("_p.i").orderBy("timestamp"))
    found = times.join(F.broadcast(wanted), "_day").withColumn("_r", rank)
    hits = found.where(F.col("_r") == F.col("_p.at") - F.col("_before") + 1).select("_p.i", "timestamp").collect()
    if len(hits) != len(fractions):
        raise ValueError("Input dataframe cannot be empty.")
    return [r["timestamp"] for r in sorted(hits, key=lambda r: r["i"])]


def purged_split(
    df: DataFrame,
    train_ratio: float = 0.70,
    validation_ratio: float = 0.15,
    purge_hours: int = PURGE_HOURS,
    excluded_cities: tuple[str, ...] = (),
    validate: bool = True,
) -> DataFrame:
    """Adds ``split`` (train, validation, test); rows inside a purge gap are left out."""
    if not 0 < train_ratio < 1 or not 0 < validation_ratio < 1:
        raise ValueError("ratios must be between 0 and 1.")
    if train_ratio + validation_ratio >= 1:
        raise ValueError("train_ratio + validation_ratio must be less than 1.")
    if purge_hours < 0:
        raise ValueError("purge_hours cannot be negative.")
    require_columns(df, [*KEYS, *TARGETS], "split input")
    rows = df.where(~F.col("city").isin(*excluded_cities)) if excluded_cities else df
    train_cut, validation_cut = cut_timestamps(rows, [train_ratio, train_ratio + validation_ratio])
    purge = timedelta(hours=purge_hours)
    kind = df.schema["timestamp"].dataType

    def at(value):
        return F.lit(value).cast(kind)

    t = F.col("timestamp")
    label = (
        F.when(t < at(train_cut - purge), "train")
        .when((t >= at(train_cut)) & (t < at(validation_cut - purge)), "validation")
        .when(t >= at(validation_cut), "test")
    )
    out = rows.withColumn("split", label).where(F.col("split").isNotNull())
    if validate:
        present = {r["split"] for r in out.select("split").distinct().collect()}
        for name in ("train", "validation", "test"):
            if name not in present:
                raise ValueError(f"{name.capitalize()} split is empty.")
    return out


def split_summary(df: DataFrame, purge_hours: int = PURGE_HOURS, excluded: tuple[str, ...] = ()) -> DataFrame:
    """P2."""
    return df.groupBy("split").agg(
        F.count("*").alias("rows"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end")
    ).withColumns({"purge_hours": F.lit(purge_hours), "excluded_cities": F.lit(", ".join(excluded))})


def walk_forward(df: DataFrame, folds: list[tuple] = WALK_FORWARD) -> DataFrame:
    """One row per (row, fold, role); bounds are inclusive, and folds are a column, not copies on disk.

    The handful of periods is a literal array filtered per row, so no join is involved.
    """
    kind = df.schema["timestamp"].dataType
    periods = []
    for name, a, b, c, d in folds:
        for role, start, end in (("train", a, b), ("test" if name == "final" else "validation", c, d)):
            periods.append(
                F.struct(
                    F.lit(name).alias("fold"), F.lit(role).alias("role"),
                    F.lit(start).cast(kind).alias("a"), F.lit(end).cast(kind).alias("b"),
                )
            )
    mine = F.filter(F.array(*periods), lambda p: F.col("timestamp").between(p["a"], p["b"]))
    return df.withColumn("_p", F.explode(mine)).select(
        *df.columns, F.col("_p.fold").alias("fold"), F.col("_p.role").alias("role")
    )


def expanding_folds(boundaries: list[datetime], start: datetime, end: datetime, purge_hours: int = PURGE_HOURS):
    """Fold table with one evaluation period per boundary, for data other than the fixed history."""
    ends = [*[b - timedelta(hours=1) for b in boundaries[1:]], end]
    gap = timedelta(hours=purge_hours + 1)
    return [
        (f"fold_{i}", str(start), str(b - gap), str(b), str(e)) for i, (b, e) in enumerate(zip(boundaries, ends), 1)
    ]


def purge_gaps(df: DataFrame, minimum_hours: int = PURGE_HOURS, strict: bool = False) -> DataFrame:
    """Hours between the end of training and the start of evaluation per fold."""
    trained = F.max(F.when(F.col("role") == "train", F.col("timestamp")))
    tested = F.min(F.when(F.col("role") != "train", F.col("timestamp")))
    out = df.groupBy("fold").agg(trained.alias("train_end"), tested.alias("evaluation_start"))
    gap = ((epoch_seconds(F.col("evaluation_start")) - epoch_seconds(F.col("train_end"))) / F.lit(3600.0))
    ok = gap > minimum_hours if strict else gap >= minimum_hours
    return out.withColumn("gap_hours", gap).withColumn("passed", F.coalesce(ok, F.lit(False)))


def split_bundle(
    train: DataFrame, evaluation: DataFrame, features: list[str] = FEATURES, cities: int | None = None,
    minimum_gap_hours: int = PURGE_HOURS,
) -> DataFrame:
    """P5: everything a training run requires of its two splits, in one row."""
    absent = sorted(set(missing_columns(train, features)) | set(missing_columns(evaluation, features)))
    if absent:
        raise ValueError(f"split is missing features: {', '.join(absent)}")

    def tagged(df, side):
        cells = sum([is_missing(df, c).cast("int") for c in features], F.lit(0))
        targets = sum([is_missing(df, c).cast("int") for c in TARGETS], F.lit(0))
        return df.select(*KEYS, cells.alias("_f"), targets.alias("_t"), F.lit(side).alias("_side"))

    # One pass: rows per key and side, then per city, then the totals.
    sides = {"train": 0, "evaluation": 1}
    both = tagged(train, 0).unionByName(tagged(evaluation, 1))
    per_key = both.groupBy(*KEYS).agg(
        *[
            F.struct(
                F.count_if(F.col("_side") == i).alias("n"),
                F.coalesce(F.sum(F.when(F.col("_side") == i, F.col("_f"))), F.lit(0)).alias("f"),
                F.coalesce(F.sum(F.when(F.col("_side") == i, F.col("_t"))), F.lit(0)).alias("t"),
            ).alias(p)
            for p, i in sides.items()
        ]
    )
    per_city = per_key.groupBy("city").agg(
        *[
            F.struct(
                F.sum(f"{p}.n").alias("n"), F.sum(f"{p}.f").alias("f"), F.sum(f"{p}.t").alias("t"),
                F.sum(F.greatest(F.col(f"{p}.n") - 1, F.lit(0))).alias("repeats"),
                F.min(F.when(F.col(f"{p}.n") > 0, F.col("timestamp"))).alias("start"),
                F.max(F.when(F.col(f"{p}.n") > 0, F.col("timestamp"))).alias("end"),
            ).alias(p)
            for p in sides
        ],
        F.count_if((F.col("train.n") > 0) & (F.col("evaluation.n") > 0)).alias("overlap"),
    )
    totals = []
    for p in sides:
        totals += [
            F.sum(f"{p}.n").alias(f"{p}_rows"),
            F.count_if(F.col(f"{p}.n") > 0).alias(f"{p}_cities"),
            F.min(f"{p}.start").alias(f"{p}_start"),
            F.max(f"{p}.end").alias(f"{p}_end"),
            F.sum(f"{p}.f").alias(f"{p}_missing_features"),
            F.sum(f"{p}.t").alias(f"{p}_missing_targets"),
            F.sum(f"{p}.repeats").alias(f"{p}_duplicates"),
        ]
    one_sided = (F.col("train.n") > 0) != (F.col("evaluation.n") > 0)
    out = per_city.agg(*totals, F.count_if(one_sided).alias("city_differences"), F.sum("overlap").alias("overlap"))
    gap = (epoch_seconds(F.col("evaluation_start")) - epoch_seconds(F.col("train_end"))) / F.lit(3600.0)
    out = out.withColumn("gap_hours", gap)
    ok = (F.col("train_rows") > 0) & (F.col("evaluation_rows") > 0) & (F.col("gap_hours") >= minimum_gap_hours)
    for c in ("train_missing_features", "evaluation_missing_features", "train_missing_targets",
              "evaluation_missing_targets", "train_duplicates", "evaluation_duplicates", "city_differences", "overlap"):
        ok = ok & (F.col(c) == 0)
    if cities is not None:
        ok = ok & (F.col("train_cities") == cities)
    return out.withColumn("passed", F.coalesce(ok, F.lit(False)))
