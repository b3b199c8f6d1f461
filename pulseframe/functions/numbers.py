"""Rounding and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .time import as_col


def half_up(c: Column | str, digits: int) -> Column:
    """Round half up to `digits` decimals, as DOUBLE.

    The value is first snapped to eight decimals.  A double sum depends on the
    order partitions are merged in; snapping keeps that noise from deciding
    which way a tie rounds, so the same data gives the same result on any
    number of executors.  Values a 38-digit decimal cannot hold are rounded as
    they are.
    """
    x = as_col(c).cast("double")
    snapped = F.round(x.try_cast("decimal(38,8)"), digits).cast("double")
    return F.coalesce(snapped, F.round(x, digits))


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL where the denominator is zero or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def number_or_null(c: Column | str) -> Column:
    return as_col(c).try_cast("double")
