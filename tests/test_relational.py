from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from fixtures import target_panel
from pyspark.sql import functions as F

from hazeline.operators import quantiles as Qt
from hazeline.operators import relational as R
from hazeline.operators import splits as P
from hazeline.operators.targets import build_targets


def test_newest_n_with_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("key"), "id")
    got = R.newest_n(df, ["key"], [F.col("id").desc()], 7)
    per_key = {}
    for r in df.collect():
        per_key.setdefault(r["key"], []).append(r["id"])
    assert {(r["key"], r["id"]) for r in got.collect()} == {(k, i) for k, v in per_key.items() for i in sorted(v)[-7:]}


def test_dedupe_keeps_last_or_first(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 5, 50)], "k string, t int, v int")
    assert {tuple(r) for r in R.dedupe(df, ["k"], [F.col("t")]).collect()} == {("a", 2, 20), ("b", 5, 50)}
    assert {tuple(r) for r in R.dedupe(df, ["k"], [F.col("t")], "first").collect()} == {("a", 1, 10), ("b", 5, 50)}


def test_one_to_one_rejects_repeats(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1)], "city string, timestamp int")
    with pytest.raises(ValueError, match="duplicate"):
        R.one_to_one(a, a)


@pytest.mark.parametrize("ttl, bucket", [(1, 1), (5, 24), (168, 3), (400, 24)])
def test_asof_join_against_brute_force(spark, ttl, bucket):
    rng, start = random.Random(ttl), datetime(2024, 1, 1)
    feats = [(rng.choice("ab"), start + timedelta(minutes=rng.randrange(0, 40 * 1440, 97)), i) for i in range(120)]
    feats += [(c, t, i + 1000) for c, t, i in feats[:10]]  # the same time delivered again: the later one counts
    looks = [(i, rng.choice("abc"), start + timedelta(minutes=rng.randrange(-500, 45 * 1440))) for i in range(300)]
    f = spark.createDataFrame(feats, "city_id string, event_timestamp timestamp, created int").withColumn("v", F.col("created"))
    got = R.asof_join(spark.createDataFrame(looks, "id int, city_id string, event_timestamp timestamp"), f,
                      created="created", ttl_hours=ttl, bucket_hours=bucket).collect()
    want = {}
    for i, c, t in looks:
        alive = [(ft, v) for fc, ft, v in feats if fc == c and ft <= t <= ft + timedelta(hours=ttl)]
        want[i] = max(alive)[1] if alive else None
    assert {r["id"]: r["v"] for r in got} == want and len(got) == len(looks)


def test_asof_join_many_features_in_a_bucket(spark):
    """Sixty feature rows an hour, repeated look-ups of one time, and keys or times that are missing."""
    start = datetime(2024, 1, 1)
    feats = [(k, start + timedelta(seconds=60 * i), i) for k in ("a", "b") for i in range(600)] + [(None, start, -1), ("a", None, -2)]
    looks = [(i, "ab"[i % 2], start + timedelta(seconds=30 * (i % 1300) + 15)) for i in range(4000)] + [(-1, None, start), (-2, "a", None)]
    f = spark.createDataFrame(feats, "city_id string, event_timestamp timestamp, v int")
    rows = R.asof_join(spark.createDataFrame(looks, "id int, city_id string, event_timestamp timestamp"), f, ttl_hours=1, bucket_hours=1).collect()
    assert len(rows) == len(looks)
    for r in rows:
        seconds = 30 * (r["id"] % 1300) + 15
        newest = min(seconds // 60, 599)
        assert r["v"] == (newest if r["id"] >= 0 and seconds - 60 * newest <= 3600 else None)


def test_exact_quantiles_order_small_parts_only(spark):
    """No window partition of the ranking holds more than a cell of its interval."""
    df = spark.range(400_000).select(F.lit("x").alias("k"), (F.col("id") * 7919 % 400_009).cast("double").alias("v"))
    got = Qt.exact_quantiles(df, ["k"], "v", [0.5, 0.9])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_cell" in line for line in windows)
    values = np.sort(np.arange(400_000) * 7919 % 400_009)
    assert got.first()["quantiles"] == pytest.approx(np.quantile(values, [0.5, 0.9]).tolist(), abs=1e-9)


@pytest.mark.parametrize("sizes", [(1, 2), (3, 10), (900, 1201), (60_000, 100)])
def test_exact_quantiles(spark, sizes):
    """One way of locating the ranks at every size, with many ties in one group."""
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=sizes[0]).round(2).tolist(), "b": [3.0] * (sizes[1] // 2) + rng.exponential(size=sizes[1]).tolist()}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.95, 0.999, 1.0]
    got = {r["k"]: r["quantiles"] for r in Qt.exact_quantiles(df, ["k"], "v", probs).collect()}
    for k, vs in values.items():
        assert got[k] == pytest.approx(np.quantile(vs, probs).tolist(), abs=1e-12)


def test_bounded_quantiles(spark):
    df = spark.range(1, 101).select(F.lit("x").alias("k"), (F.col("id") % 10).alias("v"))
    assert Qt.bounded_quantiles(df, ["k"], "v", [0.5]).first()["quantiles"] == [4.5]


def _split_panel(spark):
    return build_targets(target_panel(spark, 800)).where(F.col("target_aqi_72h").isNotNull() & F.col("aqi_current").isNotNull())


def test_purged_split(spark):
    rows = _split_panel(spark)
    out = P.purged_split(rows, excluded_cities=("Lahore",))
    s = {r["split"]: r for r in P.split_summary(out).collect()}
    assert s["train"]["end"] < s["validation"]["start"] < s["validation"]["end"] < s["test"]["start"]
    assert s["validation"]["start"] - s["train"]["end"] >= timedelta(hours=72)
    assert s["test"]["start"] - s["validation"]["end"] >= timedelta(hours=72)
    assert {r["city"] for r in out.select("city").distinct().collect()} == {"Islamabad"}
    times = sorted({r["timestamp"] for r in rows.select("timestamp").distinct().collect()})
    cut = P.cut_timestamps(rows, [0.7, 0.85])
    assert cut == [times[int(len(times) * 0.7)], times[int(len(times) * 0.85)]]


def test_split_bundle_finds_a_leak(spark):
    out = P.purged_split(_split_panel(spark))
    train, test = out.where("split = 'train'"), out.where("split = 'test'")
    assert P.split_bundle(train, test, ["pm2_5"], cities=2).first()["passed"] is True
    leaky = P.split_bundle(train, test.drop("split").unionByName(train.drop("split").limit(1)).withColumn("split", F.lit("t")), ["pm2_5"]).first()
    assert leaky["passed"] is False and leaky["overlap"] == 1


def test_walk_forward_history_folds(spark):
    hours = spark.sql("SELECT 'x' AS city, explode(sequence(timestamp'2022-08-07 23:00:00', timestamp'2026-08-25 23:00:00', interval 1 hour)) AS timestamp")
    gaps = P.purge_gaps(P.walk_forward(hours)).collect()
    assert len(gaps) == 4 and all(r["gap_hours"] == 73 and r["passed"] for r in gaps)
