"""Future rows to score: series times days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_range(start: Column, periods: Column) -> Column:
    """The days start .. start + periods - 1, however many; NULL when periods is below 1."""
    return F.when(periods >= 1, F.sequence(start, F.date_add(start, periods - 1)))


def future_grid(series: DataFrame, start: dt.date | Column, periods: int) -> DataFrame:
    """Every series on each of the next ``periods`` days, generated map-side."""
    first = start if isinstance(start, Column) else F.lit(start)
    return series.select(
        F.explode(day_range(first.cast("date"), F.lit(periods))).alias("date"), "store", "item"
    )


def next_day(panel: DataFrame) -> Column:
    """The day after the panel's last date, as a scalar subquery."""
    return panel.agg(F.date_add(F.max("date"), 1)).scalar()


def plan_grid(panel: DataFrame, periods: int = 90) -> DataFrame:
    """All series of the panel for the days after it ends."""
    series = panel.select("store", "item").distinct()
    return future_grid(series, next_day(panel), periods)


def history_plus_forecast(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """One labelled line set: observed units and forecast units per series and day."""
    return history.select(
        "date", "store", "item", F.col("sales").cast("double").alias("units"),
        F.lit("history").alias("series"),
    ).unionByName(
        forecast.select(
            "date", "store", "item", F.col("forecast").alias("units"), F.lit("forecast").alias("series")
        )
    )


def forecast_arrays(scored: DataFrame) -> DataFrame:
    """One row per series with its forecast in date order; length is bounded by the horizon."""
    return scored.groupBy("store", "item").agg(
        F.array_sort(F.collect_list(F.struct("date", "forecast"))).alias("forecast")
    )


def explode_arrays(arrays: DataFrame) -> DataFrame:
    return arrays.select("store", "item", F.inline("forecast")).select(
        "date", "store", "item", "forecast"
    )
