"""Scoring jobs: batches, horizons and the all-series plan."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfweave.functions.scoring import clip_at_zero, demand_level, round_units
from shelfweave.operators.grid import plan_grid
from shelfweave.plans.training import predict
from shelfweave.schemas import require_columns


def finish(scored: DataFrame, keep: list[str]) -> DataFrame:
    """Clip, round and label a raw forecast; the level uses the unrounded value."""
    clipped = clip_at_zero(F.col("forecast"))
    return scored.select(
        *keep, clipped.alias("forecast"), round_units(clipped).alias("predicted_sales"),
        demand_level(clipped, F.col("store_item_mean")).alias("demand_level"),
    )


def score(model: PipelineModel, requests: DataFrame) -> DataFrame:
    """Forecast and demand level per request; the request's other columns stay."""
    require_columns(requests, ["date", "store", "item"], "request table")
    return finish(predict(model, requests), requests.columns)


def score_all(model: PipelineModel, checked: DataFrame) -> DataFrame:
    """One row per checked request: scored, or with its ``reject_reason``."""
    from shelfweave.sources.requests import rejected_requests, valid_requests

    scored = score(model, valid_requests(checked))
    return scored.unionByName(rejected_requests(checked).drop("raw"), allowMissingColumns=True)


def score_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("forecast").alias("total_units"),
        F.avg("forecast").alias("mean_units"),
    )


def plan_forecast(model: PipelineModel, panel: DataFrame, periods: int = 90) -> DataFrame:
    """Score every series for the days after the panel ends."""
    return score(model, plan_grid(panel, periods))


def seasonal_check(scored: DataFrame, summer: Column, winter: Column) -> DataFrame:
    """Whether the mean forecast of summer rows lies above that of winter rows."""
    means = scored.agg(
        F.avg(F.when(summer, F.col("forecast"))).alias("summer"),
        F.avg(F.when(winter, F.col("forecast"))).alias("winter"),
    )
    return means.withColumn("summer_above_winter", F.col("summer") > F.col("winter"))
