"""Forecast error terms and aggregates, as plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["smape", "rmse", "mae", "r2", "bias_pct"]


def abs_error(actual: Column, forecast: Column) -> Column:
    return F.abs(actual - forecast)


def smape_term(actual: Column, forecast: Column) -> Column:
    """Row term in percent, 0 when both sides are 0, never above 200."""
    size = F.abs(actual) + F.abs(forecast)
    return F.when(size == 0, F.lit(0.0)).otherwise(
        F.lit(200.0) * F.abs(forecast - actual) / F.nullif(size, F.lit(0.0))
    )


def smape(actual: Column, forecast: Column) -> Column:
    return F.avg(smape_term(actual.cast("double"), forecast.cast("double")))


def metric_columns(actual: Column, forecast: Column) -> dict[str, Column]:
    """All five metrics as aggregates that share one pass."""
    y, f = actual.cast("double"), forecast.cast("double")
    squared = F.pow(f - y, F.lit(2.0))
    return {
        "smape": smape(y, f),
        "rmse": F.sqrt(F.avg(squared)),
        "mae": F.avg(F.abs(f - y)),
        # var_pop keeps the total sum of squares free of cancellation
        "r2": F.lit(1.0) - F.try_divide(F.avg(squared), F.var_pop(y)),
        "bias_pct": F.try_divide(F.avg(f) - F.avg(y), F.avg(y)) * 100.0,
    }


def evaluate(df: DataFrame, by=(), actual: str = "sales", forecast: str = "forecast") -> DataFrame:
    exprs = metric_columns(F.col(actual), F.col(forecast))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), *[e.alias(n) for n, e in exprs.items()]
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, for results that are compared or published."""
    doubles = {n: F.round(F.col(f"`{n}`"), digits) for n, t in df.dtypes if t == "double"}
    return df.withColumns(doubles) if doubles else df
