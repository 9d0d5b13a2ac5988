"""Exploration aggregates of a panel: totals, seasonality, rankings, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfweave.functions.calendar import report_labels, weekend_label

ROLLING_ROWS = 30


def daily_total(panel: DataFrame) -> DataFrame:
    return panel.groupBy("date").agg(F.sum("sales").alias("units"))


def in_year(year: int, date: str = "date") -> Column:
    """A whole year as a date range, which reaches the scan (``year(date) = y`` does not)."""
    return F.col(date).between(F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date"))


def daily_history_of_year(panel: DataFrame, year: int) -> DataFrame:
    return daily_total(panel.filter(in_year(year)))


def _rolling_mean(value: str, window) -> Column:
    frame = window.rowsBetween(-(ROLLING_ROWS - 1), 0)
    return F.when(F.count(value).over(frame) >= ROLLING_ROWS, F.avg(value).over(frame))


def rolling_daily_mean(panel: DataFrame) -> DataFrame:
    """30-row rolling mean of the daily total; the window sees one row per calendar day."""
    return daily_total(panel).withColumn(
        "rolling_mean", _rolling_mean("units", Window.orderBy("date"))
    )


def rolling_series_mean(panel: DataFrame) -> DataFrame:
    """The same per series. Panel keys are unique, so a window never exceeds the calendar."""
    return panel.withColumn(
        "rolling_mean", _rolling_mean("sales", Window.partitionBy("store", "item").orderBy("date"))
    )


def yearly_total(panel: DataFrame) -> DataFrame:
    return (
        panel.groupBy(F.year("date").alias("year")).agg(F.sum("sales").alias("units"))
        .withColumn("units_millions", F.round(F.col("units") / 1e6, 2))
    )


def yearly_growth(panel: DataFrame) -> DataFrame:
    """Compound growth per year from the first to the last year present."""
    return (
        yearly_total(panel)
        .agg(
            F.min("year").alias("first_year"), F.max("year").alias("last_year"),
            F.count(F.lit(1)).alias("n_years"),
            F.min_by("units", "year").alias("_first"), F.max_by("units", "year").alias("_last"),
        )
        .select(
            "first_year", "last_year", "n_years",
            F.when(
                F.col("n_years") > 1,
                F.pow(F.try_divide("_last", "_first"), F.try_divide(F.lit(1.0), F.col("n_years") - 1)) - 1,
            ).alias("growth"),
        )
    )


def yearly_mean(panel: DataFrame) -> DataFrame:
    return panel.groupBy(F.year("date").alias("year")).agg(F.avg("sales").alias("mean_units"))


def _mean_by_label(panel: DataFrame, number: str, label: str) -> DataFrame:
    labels = report_labels(F.col("date"))
    return (
        panel.groupBy(labels[number].alias(number), labels[label].alias(label))
        .agg(F.avg("sales").alias("mean_units")).orderBy(number)
    )


def monthly_seasonality(panel: DataFrame) -> DataFrame:
    return _mean_by_label(panel, "MonthNum", "Month")


def weekday_seasonality(panel: DataFrame) -> DataFrame:
    return _mean_by_label(panel, "DayNum", "Day")


def weekend_by_month(panel: DataFrame) -> DataFrame:
    labels = report_labels(F.col("date"))
    return (
        panel.groupBy(
            labels["MonthNum"].alias("MonthNum"), labels["Month"].alias("Month"),
            weekend_label(F.col("date")).alias("IsWeekend"),
        )
        .agg(F.avg("sales").alias("mean_units")).orderBy("MonthNum", "IsWeekend")
    )


def ranking(panel: DataFrame, key: str) -> DataFrame:
    """Total units per store or item, largest first, ties by key."""
    return (
        panel.groupBy(key).agg(F.sum("sales").alias("units")).orderBy(F.desc("units"), key)
    )


def series_mean(panel: DataFrame) -> DataFrame:
    return panel.groupBy("store", "item").agg(F.avg("sales").alias("mean_units"))


def peak_trough_ratios(panel: DataFrame) -> DataFrame:
    """Highest over lowest mean by month, weekday and series, from one scan."""
    means = panel.select(
        "store", "item", "sales", F.month("date").alias("month"), F.weekday("date").alias("weekday")
    ).groupingSets(
        [["month"], ["weekday"], ["store", "item"]], "store", "item", "month", "weekday"
    ).agg(
        F.when(F.grouping("month") == 0, "month").when(F.grouping("weekday") == 0, "weekday")
        .otherwise("series").alias("view"),
        F.avg("sales").alias("m"),
    )
    return means.groupBy("view").agg(
        F.min("m").alias("trough"), F.max("m").alias("peak"),
        F.try_divide(F.max("m"), F.min("m")).alias("ratio"),
    )


def store_month_pivot(panel: DataFrame, stores: list[int], totals: bool = False) -> DataFrame:
    """Mean units, month rows by store columns; ``totals`` adds the row and column means."""
    base = panel.withColumn("month", F.month("date"))
    cells = base.groupBy("month", "store").agg(
        F.sum("sales").alias("_total"), F.count("sales").alias("_n")
    )
    mean = F.try_divide(F.sum("_total"), F.sum("_n"))
    columns = [
        F.try_divide(
            F.sum(F.when(F.col("store") == s, F.col("_total"))),
            F.sum(F.when(F.col("store") == s, F.col("_n"))),
        ).alias(f"store_{s}")
        for s in stores
    ]
    if not totals:
        return (
            base.groupBy("month").pivot("store", stores).agg(F.avg("sales"))
            .select("month", *[F.col(str(s)).alias(f"store_{s}") for s in stores])
        )
    return cells.rollup("month").agg(
        F.grouping("month").cast("int").alias("is_total"), *columns, mean.alias("all_stores")
    )


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal bins over [min, max], the maximum in the last bin, empty bins kept."""
    bounds = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).dropna()
    flat = F.col("lo") == F.col("hi")  # a single value gets a range of one unit around it
    edges = bounds.select(
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo").cast("double")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi").cast("double")).alias("hi"),
    ).withColumn("step", (F.col("hi") - F.col("lo")) / bins)

    def edge(i: Column) -> Column:
        return F.when(i >= bins, F.col("hi")).otherwise(F.col("lo") + i * F.col("step"))

    record = edges.select(F.struct("lo", "hi", "step").alias("e"))
    placed = (
        values.select(F.col(column).cast("double").alias("x")).dropna()
        .withColumn("e", record.scalar()).select("x", "e.*")
        .withColumn("bin", F.least(F.floor((F.col("x") - F.col("lo")) / F.col("step")), F.lit(bins - 1)))
    )
    # a division may land one off when x sits on an edge: settle it against the edges themselves
    last = F.lit(bins - 1)
    settled = placed.withColumn(
        "bin",
        F.when(F.col("x") < edge(F.col("bin")), F.col("bin") - 1)
        .when((F.col("bin") < last) & (F.col("x") >= edge(F.col("bin") + 1)), F.col("bin") + 1)
        .otherwise(F.col("bin")).cast("int"),
    )
    filled = settled.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = edges.select(
        "lo", "hi", "step", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    return every.join(filled, "bin", "left").select(
        "bin", edge(F.col("bin")).alias("bin_from"), edge(F.col("bin") + 1).alias("bin_to"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def recent_history(panel: DataFrame, rows: int = 365) -> DataFrame:
    """The last ``rows`` rows of every series; the rank limit is applied before the shuffle too."""
    newest = Window.partitionBy("store", "item").orderBy(F.desc("date"))
    return (
        panel.withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= rows).drop("_rank")
    )
