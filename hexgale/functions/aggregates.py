"""Aggregate expressions that skip missing values and invalid weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hexgale.operators.ordered import finite


def _ok(value: Column, weight: Column) -> Column:
    return finite(value) & finite(weight) & (weight > 0)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean over rows with finite value and positive weight."""
    ok = _ok(value, weight)
    return F.try_divide(F.sum(F.when(ok, value * weight)), F.sum(F.when(ok, weight)))


def weighted_sum(value: Column, weight: Column) -> Column:
    return F.sum(F.when(_ok(value, weight), value * weight))


def sum_if(value: Column, condition: Column) -> Column:
    """Sum over rows that meet a condition, 0 where none does."""
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))


def weighted_pearson(x: Column, y: Column, weight: Column, centre: tuple[Column, Column] | None = None) -> Column:
    """Weighted correlation; NULL below three rows or without variance (L3).

    ``centre``: values near the means, taken off first, so that digits do not cancel where means are large.
    """
    ok = finite(x) & finite(y) & finite(weight) & (weight > 0)
    if centre:
        x, y = x - centre[0], y - centre[1]
    w = F.when(ok, weight)
    sw = F.sum(w)
    mx, my = F.sum(w * x) / sw, F.sum(w * y) / sw
    cov = F.sum(w * x * y) / sw - mx * my
    vx = F.sum(w * x * x) / sw - mx * mx
    vy = F.sum(w * y * y) / sw - my * my
    varies = (F.min(F.when(ok, x)) < F.max(F.when(ok, x))) & (F.min(F.when(ok, y)) < F.max(F.when(ok, y)))
    return F.when((F.count(w) >= 3) & varies, F.try_divide(cov, F.sqrt(vx * vy)))
