"""Quality profile of a panel."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfweave.operators.quantiles import exact_quantiles
from shelfweave.schemas import PANEL_KEYS
from shelfweave.session import fresh_path, store_table


def _distinct(approximate: bool, *columns: str) -> Column:
    if not approximate:
        return F.count_distinct(*columns)
    whole = reduce(and_, [F.col(c).isNotNull() for c in columns])
    return F.approx_count_distinct(F.when(whole, F.struct(*columns)))


def panel_profile(panel: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: size, date range, distinct entities, missing cells, duplicates, completeness.

    Rows are first reduced to their keys, which finds the duplicates; the distinct counts
    then run over keys, with a map-side combine that leaves few values per task.
    ``approximate`` replaces the distinct counts by sketches and so saves that last shuffle.
    """
    missing = reduce(add, [F.col(c).isNull().cast("bigint") for c in panel.columns])
    keys = panel.groupBy(*PANEL_KEYS).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(missing).alias("_missing")
    )
    facts = keys.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.lit(len(panel.columns)).cast("bigint").alias("n_columns"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        _distinct(approximate, "store").alias("n_stores"),
        _distinct(approximate, "item").alias("n_items"),
        _distinct(approximate, "date").alias("n_dates"),
        _distinct(approximate, "store", "item").alias("n_series"),
        F.coalesce(F.sum("_missing"), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_keys"),
    )
    expected = F.col("n_stores") * F.col("n_items") * F.col("n_dates")
    return facts.withColumns({
        "expected_rows": expected, "absent_rows": expected - F.col("n_rows"),
    })


def describe_target(panel: DataFrame, target: str = "sales") -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max, two decimals."""
    basics = panel.agg(
        F.count(target).alias("count"), F.avg(target).alias("mean"),
        F.stddev_samp(target).alias("std"), F.min(target).cast("double").alias("min"),
        F.max(target).cast("double").alias("max"),
    )
    quartiles = exact_quantiles(panel, [target], [0.25, 0.5, 0.75])
    # the quartiles are three rows, the basics one: stack both and fold them into a record
    tall = quartiles.select(
        F.element_at(
            F.create_map(*[F.lit(x) for x in (0.25, "q25", 0.5, "q50", 0.75, "q75")]), F.col("prob")
        ).alias("stat"), F.col("quantile").alias("value"),
    ).unionByName(
        basics.select(F.col("count").cast("double").alias("count"), "mean", "std", "min", "max")
        .unpivot([], ["count", "mean", "std", "min", "max"], "stat", "value")
    )
    order = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    return tall.groupBy().pivot("stat", ["count", *order]).agg(F.first("value")).select(
        F.col("count").cast("bigint").alias("count"), *[F.round(c, 2).alias(c) for c in order]
    )


def absent_ranges(panel: DataFrame) -> DataFrame:
    """store, item, first_date, last_date, n_days: each series' runs of days on which it has no row.

    The days are those on which any series has a row, so neighbours in a run need not be neighbours in the
    year. Repeated keys count once, rows with a missing key part not at all, and a pair of store and item without
    any row is no series: with unique keys, ``absent_rows`` of the profile is the sum of ``n_days`` plus
    ``n_dates`` for each such pair. A full series, or an empty panel, gives no row.

    Days become positions in the calendar (one row a day, windowed once). A series gathers the set of its
    positions, combined map-side and no longer than the calendar, and the gaps are read off that array.
    """
    keys = panel.select(*PANEL_KEYS).dropna()
    days = keys.select("date").distinct()
    calendar = store_table(
        days.select("date", F.row_number().over(Window.orderBy("date")).alias("_at")), fresh_path(panel.sparkSession, "calendar"))
    held = (
        keys.join(calendar, "date").groupBy("store", "item").agg(F.array_sort(F.collect_set("_at")).alias("_held"))
        .withColumn("_edges", F.concat(F.array(F.lit(0)), "_held", F.array(calendar.agg(F.max("_at")).scalar() + 1)))
    )
    before = F.slice("_edges", F.lit(1), F.size("_edges") - 1)
    after = F.slice("_edges", F.lit(2), F.size("_edges") - 1)
    gaps = F.filter(
        F.zip_with(before, after, lambda a, b: F.struct((a + 1).alias("first"), (b - 1).alias("last"))),
        lambda g: g["first"] <= g["last"])
    first = calendar.select(F.col("date").alias("first_date"), F.col("_at").alias("first"))
    last = calendar.select(F.col("date").alias("last_date"), F.col("_at").alias("last"))
    ranges = held.select("store", "item", F.explode(gaps).alias("_gap")).select("store", "item", "_gap.first", "_gap.last")
    return ranges.join(first, "first").join(last, "last").select(
        "store", "item", "first_date", "last_date", (F.col("last") - F.col("first") + 1).cast("bigint").alias("n_days"))
