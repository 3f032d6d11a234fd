"""Time and level expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1_000_000.0)


def trunc(unit: str, ts: Column) -> Column:
    """``date_trunc`` that stays free of a time zone."""
    return F.date_trunc(unit, ts.cast("timestamp")).cast("timestamp_ntz")


def decibel(amplitude: Column) -> Column:
    """20·log10 of an amplitude; null at silence."""
    return F.when(amplitude > 0, 20 * F.log10(amplitude))


def loudness(mean_square: Column) -> Column:
    """Published loudness of a frequency-weighted mean square; null at silence."""
    return F.when(mean_square > 0, F.lit(-0.691) + 10 * F.log10(mean_square))
