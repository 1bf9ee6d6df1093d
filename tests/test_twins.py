"""Queries against their SQL twins on the smallest tables; ``TWINS=all`` runs every one of them."""

from __future__ import annotations

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
PICKED = ["aqi_with_targets", "d2_sub_indices", "w9_aqi_rolling_std", "w16_model_projection", "v7_gap_counts", "v11_validation_report", "a1_describe",
          "j3_a6_city_similarity", "j6_point_in_time", "k1_newest_events_per_user", "p1_purged_split", "l3_j8_evaluated", "h4_upsert",
          "s6_current_pollution", "q2_sequence_digest", "t1_hourly_readings_stream", "t2_trailing_aqi_stream", "t3_matured_forecasts_stream"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("TWINS") == "all" else PICKED


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, con, name):
    assert compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) == []


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
