"""Every operator as a runnable query over the given tables, with its SQL twin where SQL can express it."""

from hazeline.catalog import accuracy, columns, history, learning, ledger, quality, reports, tables, windows  # noqa: F401
from hazeline.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
