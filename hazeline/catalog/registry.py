"""Registration of queries and presentation of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from hazeline.catalog.twin import PRELUDE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PLACES = 6


def present(df: DataFrame) -> DataFrame:
    """Results as both engines can state them: doubles at six places, naive UTC timestamps."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), PLACES) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register ``f(spark, folder)``. ``doubles`` lists the SQL columns to round like ``present`` does."""

    def register(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return present(f(spark, folder))

        run.__name__ = f.__name__
        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql is not None:
            rounded = ", ".join(f"round(CAST({c} AS DOUBLE), {PLACES}) + 0.0 AS {c}" for c in doubles.split())
            head = f"SELECT * REPLACE ({rounded})" if rounded else "SELECT *"
            ORACLES[name] = f"{PRELUDE}\n{head} FROM (\n{sql}\n)"
        return f

    return register
