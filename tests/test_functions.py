from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hazeline.functions import aqi, text
from hazeline.functions.exact import is_close


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value, index", [(9.0, 50), (35.4, 100), (55.4, 150), (125.4, 200), (225.4, 300), (325.4, 500), (500.0, 500),
                                          (35.49, 100), (0.0, 0)])
def test_pm25_edges(spark, value, index):
    assert _one(spark, aqi.pm25_index(F.lit(value))) == index


@pytest.mark.parametrize("value, index", [(54.0, 50), (154.0, 100), (254.0, 150), (354.0, 200), (424.0, 300), (604.0, 500), (154.9, 100)])
def test_pm10_edges(spark, value, index):
    assert _one(spark, aqi.pm10_index(F.lit(value))) == index


def test_overall_prefers_the_larger_and_pm25_on_a_tie(spark):
    a, b = aqi.pm25_index(F.lit(55.4)), aqi.pm10_index(F.lit(54.0))
    assert _one(spark, aqi.overall_index(a, b)) == 150
    assert _one(spark, aqi.dominant_pollutant(a, b)) == "pm2_5"
    assert _one(spark, aqi.category(aqi.overall_index(a, b))) == "Unhealthy for Sensitive Groups"
    assert _one(spark, aqi.dominant_pollutant(F.lit(50), F.lit(50))) == "pm2_5"


@pytest.mark.parametrize("index, name", [(0, "Good"), (50, "Good"), (51, "Moderate"), (100, "Moderate"), (101, "Unhealthy for Sensitive Groups"),
                                         (150, "Unhealthy for Sensitive Groups"), (151, "Unhealthy"), (200, "Unhealthy"),
                                         (201, "Very Unhealthy"), (300, "Very Unhealthy"), (301, "Hazardous"), (500, "Hazardous")])
def test_category_edges(spark, index, name):
    assert _one(spark, aqi.category(F.lit(index))) == name


def test_negative_values(spark):
    assert _one(spark, aqi.pm25_index(F.lit(-1.0))) is None
    assert _one(spark, aqi.category(F.lit(-1))) is None
    with pytest.raises(Exception, match="cannot be negative"):
        _one(spark, aqi.pm25_index(F.lit(-1.0), strict=True))
    with pytest.raises(Exception, match="cannot be negative"):
        _one(spark, aqi.category(F.lit(-1), strict=True))


def test_prediction_category_rounds_and_alert_does_not(spark):
    assert _one(spark, aqi.category_of_prediction(F.lit(50.4))) == "Good"
    assert _one(spark, aqi.alert(F.lit(50.4)))["severity"] == 1
    assert _one(spark, aqi.category_of_prediction(F.lit(50.5))) == "Good"  # half to even
    assert _one(spark, aqi.category_of_prediction(F.lit(900.0))) == "Hazardous"
    assert _one(spark, aqi.clip_prediction(F.lit(float("nan")))) is None


def test_distance(spark):
    assert _one(spark, aqi.category_distance(F.lit("Good"), F.lit("Unhealthy"))) == 3
    assert _one(spark, aqi.category_distance(F.lit("Good"), F.lit("unheard of"))) is None


def test_text_helpers(spark):
    assert _one(spark, text.normalised_city(F.lit("  RAHIM   Yar\tKhan "))) == "rahim yar khan"
    assert [_one(spark, text.parse_flag(F.lit(t))) for t in (" Yes", "0", "maybe")] == [True, False, None]
    assert _one(spark, text.has_zone(F.lit("2024-01-01T00:00:00+05:00"))) is True
    assert _one(spark, text.has_zone(F.lit("2024-01-01 00:00:00"))) is False


def test_is_close_is_asymmetric(spark):
    assert _one(spark, is_close(F.lit(100.0), F.lit(110.0), 0.095, 0.0)) is True
    assert _one(spark, is_close(F.lit(110.0), F.lit(100.0), 0.095, 0.0)) is False
