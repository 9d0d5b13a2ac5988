"""Columns applied to a raw forecast before it leaves a scoring job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The demand level thresholds, both strict.
LOW_BELOW = 0.8
HIGH_ABOVE = 1.2


def clip_at_zero(forecast: Column) -> Column:
    return F.greatest(forecast, F.lit(0.0))


def round_units(forecast: Column) -> Column:
    """Two decimals, ties to even."""
    return F.bround(forecast, 2)


def demand_level(forecast: Column, baseline: Column) -> Column:
    """Compare a clipped, unrounded forecast with the series' learned mean."""
    usable = (baseline > 0) & ~F.isnan(baseline) & ~F.isnan(forecast)
    ratio = F.try_divide(forecast, baseline)
    return (
        F.when(~F.coalesce(usable, F.lit(False)), "Unknown")
        .when(ratio < LOW_BELOW, "Low")
        .when(ratio > HIGH_ABOVE, "High")
        .otherwise("Normal")
    )


def iso_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def map_key(*parts: str) -> Column:
    """Composite text key such as ``store|item|weekday``."""
    return F.concat_ws("|", *[F.col(p).cast("string") for p in parts])
