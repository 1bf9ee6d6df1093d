"""Time the headline queries: ``BENCH_SF_DIR``, ``BENCH_CPUS`` and ``BENCH_QUERIES`` (comma list or ``all``) choose what runs."""

from __future__ import annotations

import json
import os
import time

from hazeline import build_session
from hazeline.catalog import QUERIES

HEADLINE = [
    "aqi_with_targets", "w1_trailing_means", "w2_current_aqi", "w9_aqi_rolling_std", "w16_model_projection", "w17_complete_rows",
    "w18_newest_feature_row", "w21_target_alignment", "v7_gaps", "v7_continuity", "v9_range_violations", "v11_validation_report",
    "a1_describe", "a4_city_statistics", "j3_a6_city_similarity", "a8_aqi_by_city", "a13_target_categories",
    "k1_newest_events_per_user", "k2_dedupe_keep_last", "j6_point_in_time", "p1_purged_split", "p3_walk_forward",
    "q2_sequence_digest", "e2_accuracy", "e9_champions", "f3_latest_features", "l3_j8_evaluated", "l4_j11_performance_summary",
    "h3_recover_gap", "h4_upsert", "s5_hourly_payload", "s6_current_weather", "x2_top_contributions", "r1_history_report",
    "t2_trailing_aqi_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["aqi_with_targets"](spark, folder).write.format("noop").mode("overwrite").save()  # warm up
    spent = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
