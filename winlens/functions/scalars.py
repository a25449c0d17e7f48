"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shifted(ts: Column, micros: int | Column) -> Column:
    """The instant moved by a number of microseconds."""
    return F.timestamp_micros(F.unix_micros(ts) + micros)


def finite(value: Column) -> Column:
    """Null where the value is not finite."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
