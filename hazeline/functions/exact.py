"""Means, spreads and correlations from exact sums.

Sensor values carry a few decimals. Summing them as DECIMAL and converting once makes every result independent of how rows were
partitioned, which a floating-point sum is not. Eight decimals leave every reading as it is and exceed any sensor's resolution.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE_SCALE = 8


def exact(c: Column, scale: int = VALUE_SCALE) -> Column:
    return c.cast(f"decimal(18,{scale})")


def _d(c: Column) -> Column:
    return c.cast("double")


def mean_of(total: Column, n: Column) -> Column:
    return F.try_divide(_d(total), _d(n))


def sample_variance_parts(n: Column, total: Column, squares: Column) -> Column:
    return _d(n) * _d(squares) - _d(total) * _d(total)


def std_of(n: Column, total: Column, squares: Column, ddof: int = 1) -> Column:
    """Spread from count, sum and sum of squares; NULL when there are not more than ``ddof`` values."""
    spread = F.greatest(sample_variance_parts(n, total, squares), F.lit(0.0))
    return F.when(n > ddof, F.sqrt(spread / (_d(n) * (_d(n) - ddof))))


def corr_of(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson correlation; NULL when either side has no spread."""
    vx, vy = sample_variance_parts(n, sx, sxx), sample_variance_parts(n, sy, syy)
    return F.when((vx > 0) & (vy > 0), (_d(n) * _d(sxy) - _d(sx) * _d(sy)) / (F.sqrt(vx) * F.sqrt(vy)))


def exact_avg(c: Column) -> Column:
    """Aggregate: mean of an exact column."""
    return mean_of(F.sum(c), F.count(c))


def exact_std(c: Column, ddof: int = 1) -> Column:
    """Aggregate: spread of an exact column."""
    return std_of(F.count(c), F.sum(c), F.sum(c * c), ddof)


def is_close(a: Column, b: Column, rtol: float, atol: float) -> Column:
    """Asymmetric tolerance: ``|a-b| <= atol + rtol*|b|``; NULL inputs count as not close."""
    a, b = _d(a), _d(b)
    return F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False))
