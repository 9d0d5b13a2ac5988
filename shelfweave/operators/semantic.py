"""Star schema, named measures and slicer context for report queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfweave.operators.explore import in_year

DIM_KEYS = {"Stores": "Store", "Items": "Item"}


@dataclass(frozen=True)
class FilterContext:
    """Slicer selections; an empty tuple selects everything.

    Store and item selections reach every fact through the dimensions. A selection on a
    column of one fact (year of Sales, month of Forecast) reaches that fact only.
    """

    stores: tuple[int, ...] = ()
    items: tuple[int, ...] = ()
    sales_years: tuple[int, ...] = ()
    forecast_months: tuple[int, ...] = ()

    def on_dims(self, fact: DataFrame) -> DataFrame:
        for column, chosen in (("Store", self.stores), ("Item", self.items)):
            if chosen:
                fact = fact.filter(F.col(column).isin(*chosen))
        return fact

    def on_fact(self, fact_name: str) -> Column | None:
        if fact_name == "Sales" and self.sales_years:
            return any_year(self.sales_years)
        if fact_name == "Forecast" and self.forecast_months:
            return F.col("MonthNum").isin(*self.forecast_months)
        return None


def any_year(years) -> Column:
    """Selected years as date ranges, so that they can be pushed into the scan."""
    return reduce(or_, [in_year(y) for y in sorted(set(years))])


@dataclass(frozen=True)
class Measure:
    """``parts`` are the sums or averages taken under the context, ``combine`` joins them.

    A part is (aggregate, column, own_year). A part with its own year replaces any year
    selection, from a slicer or from the grouping, by that year.
    """

    fact: str
    parts: tuple[tuple[str, str, int | None], ...]
    combine: Callable[..., Column] = lambda a: a


def _share(new: Column, old: Column) -> Column:
    return F.try_divide((new - old).cast("double"), old.cast("double"))


def measures(year: int) -> dict[str, Measure]:
    """The named measures; ``year`` is the fixed year compared with the one before it."""
    return {
        "total_units": Measure("Sales", (("sum", "Sales", None),)),
        "avg_daily_units": Measure("Sales", (("avg", "Sales", None),)),
        "units_year": Measure("Sales", (("sum", "Sales", year),)),
        "units_prior_year": Measure("Sales", (("sum", "Sales", year - 1),)),
        "yoy_growth": Measure(
            "Sales", (("sum", "Sales", year), ("sum", "Sales", year - 1)), _share
        ),
        "forecast_units": Measure("Forecast", (("sum", "Forecast", None),)),
        "avg_daily_forecast": Measure("Forecast", (("avg", "Forecast", None),)),
        "actual_units": Measure("TestForecast", (("sum", "Actual", None),)),
        "forecast_units_test": Measure("TestForecast", (("sum", "Forecast", None),)),
        "smape_pct": Measure("TestForecast", (("avg", "SmapePct", None),)),
        "mae_units": Measure("TestForecast", (("avg", "AbsError", None),)),
        "forecast_bias": Measure(
            "TestForecast", (("sum", "Forecast", None), ("sum", "Actual", None)), _share
        ),
        "impact": Measure("DemandDrivers", (("sum", "MeanAbsShap", None),)),
    }


def _alias(part) -> str:
    return "_" + "_".join(str(p) for p in part)


def evaluate(
    facts: dict[str, DataFrame], names: list[str], year: int,
    ctx: FilterContext = FilterContext(), by: tuple[str, ...] = (),
) -> DataFrame:
    """Measures of one fact under a context, grouped by ``by``, in one pass over the fact."""
    catalog = measures(year)
    wanted = {n: catalog[n] for n in names}
    fact_names = {m.fact for m in wanted.values()}
    if len(fact_names) != 1:
        raise ValueError(f"measures of one query must share a fact, got {sorted(fact_names)}")
    fact_name = fact_names.pop()
    parts = sorted({p for m in wanted.values() for p in m.parts}, key=str)

    fact = facts[fact_name]
    if fact_name != "DemandDrivers":
        fact = ctx.on_dims(fact)
    slicer = ctx.on_fact(fact_name)
    own_years = {p[2] for p in parts if p[2] is not None}
    if slicer is not None:
        # keep only rows some part can use; the ranges stay visible to the scan
        fact = fact.filter(slicer | any_year(own_years) if own_years else slicer)

    def aggregate(part) -> Column:
        kind, column, own_year = part
        rows = in_year(own_year) if own_year is not None else slicer
        value = F.col(column) if rows is None else F.when(rows, F.col(column))
        return getattr(F, kind)(value).alias(_alias(part))

    kept = [] if slicer is None else [F.coalesce(F.max(slicer), F.lit(False)).alias("_kept")]
    grouped = fact.groupBy(*by).agg(*[aggregate(p) for p in parts], *kept)
    if by and own_years and "Year" in by:
        # the measure's own year also replaces a year taken from the grouping
        rest = Window.partitionBy(*[c for c in by if c != "Year"])
        grouped = grouped.withColumns({
            _alias(p): F.sum(_alias(p)).over(rest) for p in parts if p[2] is not None
        })
    if by and kept:
        # groups outside the slicer are hidden, unless a measure with its own year has a value there
        own = [F.col(_alias(p)).isNotNull() for p in parts if p[2] is not None and "Year" not in by]
        grouped = grouped.filter(reduce(or_, own, F.col("_kept")))
    return grouped.select(
        *by, *[m.combine(*[F.col(_alias(p)) for p in m.parts]).alias(n) for n, m in wanted.items()]
    )


def orphans(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Fact rows whose key is absent from the dimension."""
    return fact.join(dim.select(key), key, "left_anti")


def star_join(fact: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Join a fact to its dimensions, many to one; rows without a dimension row drop out, see ``orphans``.

    Spark broadcasts a dimension by its size in bytes; stored dimensions have a known one.
    """
    for name, dim in dims.items():
        fact = fact.join(dim, DIM_KEYS[name])
    return fact


def order_plan(forecast: DataFrame) -> DataFrame:
    """Forecast total and daily mean per month with a grand total row."""
    return forecast.rollup("MonthNum").agg(
        F.grouping("MonthNum").cast("int").alias("is_total"),
        F.sum("Forecast").alias("forecast_units"), F.avg("Forecast").alias("avg_daily_forecast"),
    )
