"""Accuracy reports over rows that carry actual sales and a forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfweave.functions import metrics
from shelfweave.functions.calendar import report_labels
from shelfweave.operators.explore import histogram


def actual_vs_forecast_daily(scored: DataFrame) -> DataFrame:
    return scored.groupBy("date").agg(
        F.sum("sales").alias("actual"), F.sum("forecast").alias("forecast")
    )


def align(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """Pair separate actual and forecast frames on their keys."""
    return actual.select("date", "store", "item", "sales").join(
        forecast.select("date", "store", "item", "forecast"), ["date", "store", "item"]
    )


def smape_by(scored: DataFrame, key: str) -> DataFrame:
    return scored.groupBy(key).agg(
        metrics.smape(F.col("sales"), F.col("forecast")).alias("smape")
    )


def smape_spread(scored: DataFrame, key: str = "store") -> DataFrame:
    """Best and worst group and the distance between them."""
    return smape_by(scored, key).agg(
        F.min("smape").alias("best"), F.max("smape").alias("worst"),
        (F.max("smape") - F.min("smape")).alias("spread"),
    )


def residual_histogram(scored: DataFrame, bins: int = 60) -> DataFrame:
    residuals = scored.select((F.col("forecast") - F.col("sales")).alias("residual"))
    return histogram(residuals, "residual", bins)


def fact_sales(panel: DataFrame) -> DataFrame:
    return panel.select(
        "date", F.col("store").cast("bigint").alias("Store"),
        F.col("item").cast("bigint").alias("Item"), F.col("sales").alias("Sales"),
        *[c.alias(n) for n, c in report_labels(F.col("date")).items()],
    )


def fact_forecast(scored: DataFrame) -> DataFrame:
    return scored.select(
        "date", F.col("store").cast("bigint").alias("Store"),
        F.col("item").cast("bigint").alias("Item"), F.col("forecast").alias("Forecast"),
        *[c.alias(n) for n, c in report_labels(F.col("date")).items()],
    )


def fact_test_forecast(scored: DataFrame) -> DataFrame:
    y, f = F.col("sales").cast("double"), F.col("forecast")
    return scored.select(
        "date", F.col("store").cast("bigint").alias("Store"),
        F.col("item").cast("bigint").alias("Item"), F.col("sales").alias("Actual"),
        f.alias("Forecast"), metrics.abs_error(y, f).alias("AbsError"),
        metrics.smape_term(y, f).alias("SmapePct"),
        *[c.alias(n) for n, c in report_labels(F.col("date")).items()],
    )
