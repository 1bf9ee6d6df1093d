"""X1-X4, Q2, Q3 against their twins on events of our own, and names that code uses but nothing defines."""

from __future__ import annotations

import builtins
import dis
import importlib
import pkgutil
import types

import duckdb
import pytest
from compare import compare
from pyspark.sql import functions as F

import __spark_entry__ as entry
import hazeline

NAMES = ["x1_global_importance", "x2_top_contributions", "x3_additivity", "x4_linear_contributions", "q2_sequence_digest", "q3_sequence_counts"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two events of each type in most of 200 hours, with repeated rows; hours without events are left to the spine."""
    path = str(tmp_path_factory.mktemp("events"))
    kinds = F.array(*map(F.lit, ["click", "purchase", "signup", "view", "error"]))
    rows = spark.range(2000).select(
        F.col("id").alias("event_id"),
        (F.lit("2024-01-03 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("id") / 10).cast("int"), mins=F.col("id") % 60)).alias("ts"),
        (F.col("id") * 7 % 31).alias("user_id"), kinds[(F.col("id") % 5).cast("int")].alias("event_type"),
        ((F.col("id") * 37 % 9000) / 100).alias("value"), F.format_string('{"k": %d}', F.col("id") * 13 % 100).alias("props"))
    rows = rows.where("event_id % 23 <> 0")
    rows.union(rows.where("event_id % 50 = 1")).coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_twin_on_own_events(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    found = entry.queries()[name](spark, folder)
    assert compare(found, con, entry.oracle_sql()[name]) == []
    assert found.count()


def _global_names(code):
    yield from (i.argval for i in dis.get_instructions(code) if i.opname in ("LOAD_GLOBAL", "LOAD_NAME"))
    for const in code.co_consts:
        if isinstance(const, types.CodeType):
            yield from _global_names(const)


def test_every_global_name_is_defined():
    """A name that only a function's body uses is looked up when the function runs, too late for an import to fail."""
    missing = []
    for m in pkgutil.walk_packages(hazeline.__path__, "hazeline."):
        module = importlib.import_module(m.name)
        for f in vars(module).values():
            if isinstance(f, types.FunctionType) and f.__module__ == m.name:
                missing += [(m.name, n) for n in _global_names(f.__code__) if n not in vars(module) and not hasattr(builtins, n)]
    assert missing == []
