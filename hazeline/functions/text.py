"""String and time helpers shared by ingest, ledger and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_bucket(ts: Column) -> Column:
    """The UTC hour; zoned input is converted, naive input is taken as UTC."""
    return F.date_trunc("hour", ts)


def naive_hour_bucket(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def normalised_city(name: Column) -> Column:
    """Lower case, single blanks, no outer blanks."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[ -]", "_")


def parse_flag(value: Column) -> Column:
    """Three-valued boolean from text."""
    t = F.lower(F.trim(value.cast("string")))
    return F.when(t.isin("true", "1", "yes"), F.lit(True)).when(t.isin("false", "0", "no"), F.lit(False))


def has_zone(text: Column) -> Column:
    """V6: the raw timestamp text ends in Z or an offset."""
    return text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")


def horizon_hours(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "h", "").cast("int")
