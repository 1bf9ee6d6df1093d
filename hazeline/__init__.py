"""Hourly air-quality analytics and forecasting on Spark DataFrames.

Every operator is a lazy function from DataFrame to DataFrame over a panel keyed by ``(city, timestamp)``.
"""

from hazeline.session import build_session, work_dir

__all__ = ["build_session", "work_dir"]
